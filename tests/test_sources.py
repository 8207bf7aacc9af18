import pandas as pd
import pytest

import tableprofile as tp
from tableprofile.sources import csv as C
from tableprofile.sources.scratch import SETTING, scratch_path
from tests.conftest import DATA

KINDS = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string", "uint64": "decimal(20,0)"}


def check(spark, tmp_path, text):
    """Types and values must be those of a data frame read from the same file."""
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8", newline="")
    pdf = pd.read_csv(path)
    df = tp.read_csv(spark, str(path))
    assert df.columns == [str(c) for c in pdf.columns]
    assert [t for _, t in df.dtypes] == [KINDS[str(t)] for t in pdf.dtypes]
    got = [tuple(r) for r in df.collect()]
    want = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
    return df


def test_missing_tokens(spark, tmp_path):
    check(
        spark,
        tmp_path,
        "i,f,b,s,gi,gb\n1,1.5,True,x,1,true\n2,NA,FALSE,NULL,,NaN\n-3,nan,true,n/a,3,false\n+4,2e3,False,None,#N/A,<NA>\n",
    )


def test_loose_casts_are_not_taken(spark, tmp_path):
    check(spark, tmp_path, "a,b,c,d,e\nyes,t,1.0d,5f,0x10\nno,f,2.0d,6f,0x11\n")


def test_dates_stay_text(spark, tmp_path):
    check(spark, tmp_path, "d,t\n2020-01-01,10:00\n2020-01-02,11:00\n")


def test_numbers_in_odd_shapes(spark, tmp_path):
    check(spark, tmp_path, "a,b,c,d\n.5,1.,inf, 7\n2,1e3,-Infinity,8 \n")


def test_large_integers(spark, tmp_path):
    check(spark, tmp_path, "a,b,c\n9223372036854775807,18446744073709551615,99999999999999999999999\n-1,1,2\n")


def test_quotes_commas_and_backslashes(spark, tmp_path):
    check(spark, tmp_path, 'a,b\n"x, ""y""",C:\\dir\\n\n  lead,"q\\"\n')


def test_line_breaks_in_quotes(spark, tmp_path):
    df = check(spark, tmp_path, 'a,b\n"one\ntwo",1\n"three",2\n')
    assert df.count() == 2


def test_header_names(spark, tmp_path):
    check(spark, tmp_path, "a,a,,b\n1,2,3,4\n")


def test_all_missing_column(spark, tmp_path):
    check(spark, tmp_path, "a,b\n,1\nNA,2\n")


def test_mixed_column_is_text(spark, tmp_path):
    check(spark, tmp_path, "a\n1\ntwo\n3.0\n")


def test_header_only(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("a,b\n")
    df = tp.read_csv(spark, str(path))
    assert df.columns == ["a", "b"] and df.count() == 0
    with pytest.raises(ValueError):
        tp.require_rows(df)


def test_split_unless_a_field_spans_lines(spark, tmp_path):
    plain, broken = tmp_path / "p.csv", tmp_path / "b.csv"
    plain.write_text('a\n"x ""y"""\n')
    broken.write_text('a\n"x\ny"\n')
    assert not C._headers(spark, str(plain))[0]
    assert C._headers(spark, str(broken))


def test_folder_of_files(spark, tmp_path):
    out = str(tmp_path / "folder")
    spark.range(0, 100, 1, 4).selectExpr("id", "if(id = 77, 'x', CAST(id AS STRING)) AS s").write.csv(out, header=True)
    df = tp.read_csv(spark, out)
    assert df.dtypes == [("id", "bigint"), ("s", "string")] and df.count() == 100


def test_round_trip_of_tables(spark, tmp_path):
    for name in ("nation", "part", "lineitem", "documents"):
        table = spark.read.parquet(tp.registry(DATA)[name])
        out = str(tmp_path / name)
        table.write.csv(out, header=True, escape='"')
        back = tp.read_csv(spark, out)
        assert back.count() == table.count()
        want = {"int": "bigint", "timestamp_ntz": "string"}
        assert back.dtypes == [(n, want.get(t, t)) for n, t in table.dtypes]


def test_registry(spark, tmp_path):
    assert tp.load_table(spark, "nation", tp.registry(DATA)).count() == 25
    with pytest.raises(ValueError):
        tp.load_table(spark, "moon", tp.registry(DATA))
    empty = str(tmp_path / "empty.parquet")
    spark.range(0).write.parquet(empty)
    with pytest.raises(ValueError):
        tp.load_table(spark, "e", {"e": empty})
    csv = tmp_path / "c.csv"
    csv.write_text("a\n1\n")
    assert tp.load_table(spark, "c", {"c": str(csv)}).first()["a"] == 1


def test_scratch_follows_the_session(spark):
    base = spark.conf.get(SETTING, None)
    path = scratch_path(spark, "x")
    assert path.startswith(base) if base else "tableprofile-" in path
    assert path != scratch_path(spark, "x")


def test_surplus_fields_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4,5\n6,7\n")
    with pytest.raises(ValueError, match="1 rows have more fields"):
        C.read_csv(spark, str(tmp_path / "a.csv"))


def test_short_rows_are_filled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n3\n")
    assert sorted(map(tuple, C.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [(1, "x"), (3, None)]


def test_files_are_aligned_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("b,a\ny,2\n")
    rows = C.read_csv(spark, str(tmp_path)).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(1, "x"), (2, "y")]
    (tmp_path / "c.csv").write_text("b,c\ny,2\n")
    with pytest.raises(ValueError, match="different columns"):
        C.read_csv(spark, str(tmp_path))


def test_names_that_differ_by_case(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,A,a\n1,2,3\n")
    assert C.read_csv(spark, str(tmp_path / "a.csv")).columns == ["a", "A.1", "a.2"]
