import random
from collections import defaultdict

from pyspark.sql import functions as F

from tableprofile.llm import jaccard, packing, queries


def brute(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fit = [
            (b["room"], b["n"], k)
            for k, b in enumerate(bins)
            if b["room"] >= length and not (source is not None and source in b["s"]) and not (cluster is not None and cluster in b["c"])
        ]
        tightest = min((r for r, _, _ in fit), default=None)
        k = None
        if tightest is not None:
            # Of equal rooms the bin that got there first.
            k = min((bins[k]["since"], k) for r, _, k in fit if r == tightest)[1]
        else:
            bins.append({"room": capacity, "s": set(), "c": set(), "n": 0, "since": 0})
            k = len(bins) - 1
        b = bins[k]
        b["room"] -= length
        b["s"].add(source)
        b["c"].add(cluster)
        b["n"] += 1
        b["since"] = len(out)
        out.append((k, b["n"] - 1))
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(3)
    for n in (1, 5, 60, 300):
        pieces = [(rng.randint(1, 40), rng.choice([None, 0, 1, 1, 1, 2, 3]), rng.choice([None, None, 7, 8])) for _ in range(n)]
        pieces.sort(key=lambda p: -p[0])
        assert packing.pack(pieces, 40) == brute(pieces, 40)


def test_packing_is_whole(documents, prose, odd_rows):
    rows = [(k, prose(k, 1 + 37 * k % 300), "en", f"s{k % 3}") for k in range(10, 90)]
    rows += [(200 + k, prose(5, 50).upper() if k % 2 else prose(5, 50), "en", None) for k in range(6)]
    rows += odd_rows
    out = packing.best_fit_packing(documents(rows), capacity=100, shard=40).collect()
    bins, words = defaultdict(list), defaultdict(int)
    for r in out:
        bins[r["shard"], r["bin"]].append(r)
        words[r["doc_id"]] += r["n_words"]
        assert r["first_word"] == 100 * r["piece"] and 0 < r["n_words"] <= 100
    expected = defaultdict(int)
    for r in rows:
        if (r[1] or "").split():
            expected[r[0]] += len(r[1].split())
    assert words == expected
    for b in bins.values():
        assert sum(r["n_words"] for r in b) <= 100 and sorted(r["position"] for r in b) == list(range(len(b)))
        sources = [r["source"] for r in b if r["source"] is not None]
        assert len(set(sources)) == len(sources) and len({r["cluster"] for r in b}) == len(b)
    assert packing.best_fit_packing(documents(rows).limit(0)).collect() == []


def test_clusters_may_be_given(documents, prose):
    docs = documents([(k, prose(k, 10), "en", f"s{k}") for k in range(6)])
    out = packing.best_fit_packing(docs, capacity=100, cluster=F.lit(1)).collect()
    assert len({(r["shard"], r["bin"]) for r in out}) == 6


def test_near_copies_go_apart(spark, documents, prose):
    """Two texts that differ by a word share no sequence once their component is given."""
    rows = []
    for k in range(20):
        text = prose(k, 60)
        rows += [(2 * k, text, "en", f"a{k}"), (2 * k + 1, text + " more", "en", f"b{k}")]
    rows += [(None, prose(3, 60), "en", "x"), (None, prose(3, 60), "en", "y")]
    docs = documents(rows)
    components = jaccard.jaccard_components(docs)
    out = packing.best_fit_packing(docs, capacity=4000, clusters=components).collect()
    assert len(out) == len(rows)
    held = defaultdict(list)
    for r in out:
        held[r["shard"], r["bin"]].append(r["doc_id"])
    for ids in held.values():
        known = [i // 2 for i in ids if i is not None]
        assert len(set(known)) == len(known) and len(ids) - len(known) <= 1
    assert any(r["cluster"] % 2 == 0 and r["doc_id"] == r["cluster"] + 1 for r in out if r["doc_id"] is not None)
    # Without the components only equal words keep texts apart.
    plain = defaultdict(set)
    for r in packing.best_fit_packing(docs, capacity=4000).collect():
        plain[r["shard"], r["bin"]].add(r["doc_id"])
    assert any({0, 1} <= ids for ids in plain.values())


def test_hot_ids_fill_many_shards(spark):
    """Rows of no id, of one id and repeated rows, all by the thousand, are dealt to all shards."""
    docs = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7L ELSE 8L END AS doc_id",
        "CASE WHEN id % 3 = 2 THEN 'one text' ELSE concat('text ', id) END AS text",
        "CASE WHEN id % 3 = 2 THEN 's' END AS source",
    )
    out = packing.best_fit_packing(docs, capacity=64, shard=500)
    found = out.groupBy("doc_id", "shard").count().collect()
    for i in (None, 7, 8):
        parts = [r["count"] for r in found if r["doc_id"] == i]
        assert sum(parts) == 3000 and len(parts) == 18 and max(parts) < 300
    apart = out.filter("source = 's'").groupBy("shard", "bin").count().agg(F.max("count")).first()[0]
    assert apart == 1


def test_a_long_text_is_cut(documents, prose):
    out = packing.best_fit_packing(documents([(1, "word " * 200_001, "en", None)]), capacity=2048, shard=10).collect()
    assert sorted(r["first_word"] for r in out) == list(range(0, 200_001, 2048)) and sum(r["n_words"] for r in out) == 200_001


def test_words_counted_with_the_components(spark, documents, prose, odd_rows, tmp_path):
    """The query packs what the join counted on its way: the same sequences as from texts read again."""
    rows = [(k, prose(k % 50, 40 + k % 50) + " more" * (k % 3), "en", f"s{k % 4}") for k in range(100, 220)]
    rows += [(None, prose(3, 60), "en", "x"), (None, prose(3, 60).upper(), "en", "y")] + odd_rows
    documents(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.documents(spark, str(tmp_path))
    expected = packing.best_fit_packing(docs, clusters=jaccard.jaccard_components(docs)).collect()
    out = queries.op6_packing(spark, str(tmp_path))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, expected)) and len(expected) == 125
    found = jaccard.jaccard_components(docs, source=F.col("source"))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "n_words", "source"]
    counted = sorted((r["doc_id"] or 0, r["n_words"], r["source"] or "") for r in found.collect())
    assert counted == sorted((r[0] or 0, len((r[1] or "").split()), (r[3] if len(r) > 3 else "s1") or "") for r in rows)
