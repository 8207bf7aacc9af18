import duckdb

from tableprofile.llm import lines


def test_equals_sql(spark, documents):
    rows = []
    for k in range(60):
        common = "Shared footer" if k % 3 else "  Shared footer\t"
        rare = "Rare line" if k < 21 else f"own {k}"
        rows.append((k, f"Line {k}\n{common}\n\n{rare}\nedge{k % 40 // 5}", "en", f"s{k % 20}"))
    rows += [(100, None, "en", "s1"), (101, "", "en", "s2"), (102, "Shared footer\nShared footer", "en", None)]
    docs = documents(rows)
    out = {tuple(r) for r in lines.line_digest(docs).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert out == {tuple(r) for r in con.execute(lines.LINES_SQL).fetchall()}


def test_near_threshold_is_exact(documents):
    rows = [(k, "at", "en", f"s{k}") for k in range(lines.MIN_SITES)]
    rows += [(50 + k, "below", "en", f"s{k}") for k in range(lines.MIN_SITES - 1)]
    rows += [(100 + k, "far above", "en", f"s{k}") for k in range(300)]
    found = {r["first_doc"]: r["spread"] for r in lines.boilerplate_lines(documents(rows)).collect()}
    assert found.keys() == {0, 100} and found[0] == lines.MIN_SITES and abs(found[100] - 300) < 60


def test_odd_rows(documents, odd_rows):
    out = lines.drop_boilerplate(documents(odd_rows))
    assert out.count() == len(odd_rows) and set(documents(odd_rows).columns) < set(out.columns)
    assert lines.drop_boilerplate(documents(odd_rows).limit(0)).collect() == []
