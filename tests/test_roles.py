import pandas as pd
import pytest

import tableprofile as tp
from tests.conftest import column, dicts


def numbers_with(distinct, rows):
    return [(i % distinct,) for i in range(rows)]


@pytest.mark.parametrize(
    "distinct, rows, role",
    [
        (9, 1000, "categorical"),
        (10, 1000, "numerical"),
        (5, 100, "numerical"),  # exactly 5%
        (5, 101, "categorical"),
        (40, 5000, "numerical"),
        (1, 21, "categorical"),
    ],
)
def test_low_cardinality(spark, distinct, rows, role):
    for kind in ("int", "double", "bigint", "decimal(10,2)"):
        df = spark.createDataFrame(numbers_with(distinct, rows), "v int").selectExpr(
            f"CAST(v AS {kind}) AS v"
        )
        assert dicts(tp.column_roles(df)) == [{"position": 0, "column": "v", "role": role}]


def test_missing_values_count_in_the_share_only(spark):
    rows = [(float(i % 4),) if i < 40 else (None,) if i < 90 else (float("nan"),) for i in range(100)]
    df = spark.createDataFrame(rows, "v double")
    assert tp.split_roles(df) == (["v"], [])


def test_families(spark):
    df = spark.sql(
        "SELECT true AS b, 'x' AS s, DATE'2020-01-01' AS d, array(1) AS a, 1.5D AS f, 1 AS i"
    )
    assert tp.columns_of(df, "number") == ["f", "i"]
    assert tp.columns_of(df, "object", "bool") == ["b", "s"]
    assert tp.columns_of(df, "datetime") == ["d"]
    assert tp.columns_of(df, "nested") == ["a"]
    assert column(tp.column_types(df), "dtype") == [
        "bool",
        "object",
        "datetime64[ns]",
        "nested",
        "float64",
        "int64",
    ]
    assert dicts(tp.overview(df)) == [
        {"n_rows": 1, "n_cols": 6, "n_number": 2, "n_object": 1, "n_datetime": 1}
    ]
    with pytest.raises(ValueError):
        tp.columns_of(df, "numeric")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string")
    assert tp.split_roles(df) == (["s"], ["a"])
    assert dicts(tp.shape(df)) == [{"n_rows": 0, "n_cols": 2}]
    assert column(tp.text_columns(df)) == []


def test_time_names_need_two_numerical_columns(spark):
    two = spark.range(100).selectExpr("id AS order_DATE", "id * 2 AS amount", "'x' AS holiday")
    assert column(tp.time_named_columns(two)) == ["order_DATE", "holiday"]
    assert column(tp.time_named_columns(two.drop("amount"))) == []


@pytest.mark.parametrize(
    "values, found",
    [
        (["a b c d", "a b c"], False),  # half is not more than half
        (["a b c d", " a  b\tc\nd ", "a b c"], True),
        (["a b c d", None, None], False),
        (["a b c d e", None, "one two three four"], True),
        (["", "   ", "word"], False),
    ],
)
def test_text_share(spark, values, found):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    share = pd.Series(values, dtype=object).str.split().str.len().gt(3).mean()
    assert (share > 0.5) == found
    assert column(tp.text_columns(df)) == (["s"] if found else [])


@pytest.mark.parametrize(
    "values, found",
    [
        (["2020-01-31", "1999-12-01"], True),
        (["2020-01-31", "2020-02-30"], False),
        (["2020-01-31 10:11:12", "2020-01-31T10:11:12", "01/31/2020", "Jan 5, 2020"], True),
        (["2020-01-31 10:11:12.123", None], True),
        (["2020-01-31", "soon"], False),
        ([None, None], True),
        (["12", "13"], False),
    ],
)
def test_date_columns(spark, values, found):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert column(tp.date_parseable_columns(df)) == (["s"] if found else [])


def test_late_bad_date_is_found(spark):
    """The bad value lies behind the rows that are looked at first."""
    df = spark.range(0, 5000, 1, 2).selectExpr("if(id = 4999, 'bad', '2020-01-01') AS s")
    assert column(tp.date_parseable_columns(df)) == []


def test_odd_column_names(spark):
    rows = [(float(i), i % 3, f"it's {i}") for i in range(100)]
    df = spark.createDataFrame(rows, ["a.b", "c d", "e'f`\\g"])
    assert tp.split_roles(df) == (["c d", "e'f`\\g"], ["a.b"])
    assert column(tp.missing_values(df)) == df.columns
    assert column(tp.describe(df)) == ["a.b", "c d"]
    assert [r["n_unique"] for r in tp.unique_counts(df).collect()] == [100, 3, 100]
    assert tp.outlier_rows(df, "a.b").count() == 0
    assert tp.insights(df).count() > 0
    assert tp.correlation_matrix(df).count() == 4


def test_the_sketch_never_overrates_few_values(spark):
    """What the roles and the cardinality rule rely on: k values set at most k registers."""
    cols = [f"xxhash64(id % {k}, {seed}) AS c{k}_{seed}" for k in range(1, 11) for seed in range(30)]
    df = spark.range(60).selectExpr(*cols)
    row = df.selectExpr(*[f"approx_count_distinct({c}) AS {c}" for c in df.columns]).first()
    for name, estimate in row.asDict().items():
        distinct = int(name[1:].split("_")[0])
        assert estimate <= 12 if distinct < 10 else estimate <= 13


@pytest.mark.parametrize(
    "values",
    [
        ["31/12/2024", "01/02/2024"],
        ["2024-01-02T03:04:05.123Z"],
        ["2024-01-02T03:04:05.5"],
        ["2024-01-02T03:04:05+01:00", "2024-01-02 03:04:05-10:30"],
        ["31.12.2024", "1.2.2024"],
        ["20241231"],
        ["31/12/2024 10:20", "1/2/2024 03:04"],
        ["31/12/2024 10:20:30"],
    ],
)
def test_more_date_formats(spark, values):
    df = spark.createDataFrame([(v, v + "x") for v in values], "d string, no string")
    assert column(tp.date_parseable_columns(df)) == ["d"]
