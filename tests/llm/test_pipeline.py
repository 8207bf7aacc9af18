import corpus_pipeline
from tableprofile.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA


def test_stages(spark, tmp_path, documents, prose):
    rows = [(k, prose(k, 60), "en", f"s{k % 12}") for k in range(30)]
    rows += [(50 + k, f"{prose(100 + k, 40)}\nShared footer of many", "en", f"s{k}") for k in range(12)]
    rows += [(70, "1 2 3", "en", "s1"), (71, None, "en", "s1"), (72, prose(1, 60), "de", "s2"), (73, prose(2, 20) + " " + prose(1, 30), "en", "s3")]
    docs = documents(rows).select("doc_id", "text", "lang", "source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        kept.append({r["doc_id"] for r in left.collect()})
    assert {70, 71}.isdisjoint(kept[0]) and 72 in kept[1] and 72 not in kept[2]
    assert {k for k, _, _, _ in rows[:30]} <= kept[3]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept[3]


def test_registered():
    assert len(QUERIES) == 13 and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "substring_dedup", "packing"]


def test_junk_and_unlearnt_languages_go(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    junk = ["x7Gq9zKpL2vWbN4tRj8sYmQ1" * 10, "Привет, как дела? Сегодня хорошая погода.", "今日はとても良い天気ですね。"]
    odd = spark.createDataFrame([(-1 - k, text) for k, text in enumerate(junk)], "doc_id long, text string")
    every = docs.unionByName(odd, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.identified(spark, every, "").select("doc_id").collect()}
    assert kept.isdisjoint({-1, -2, -3})
    assert kept == {r["doc_id"] for r in docs.filter(docs["text"].rlike(r"\p{L}")).select("doc_id").collect()}
