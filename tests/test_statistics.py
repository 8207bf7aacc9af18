import numpy as np
import pandas as pd
import pytest

import tableprofile as tp
from tests.conftest import column, dicts

NAN = float("nan")


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    rows = [
        (
            i,
            None if i % 5 == 0 else NAN if i % 7 == 0 else float(v),
            float(np.exp(v)),
            ["x", "y", None][i % 3],
            [True, False, None][i % 3],
        )
        for i, v in enumerate(rng.normal(0, 1, 300))
    ]
    names = ["id", "gaps", "skewed", "s", "b"]
    schema = "id bigint, gaps double, skewed double, s string, b boolean"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=names)


def test_missing(mixed):
    df, pdf = mixed
    got = {r["column"]: r["missing_count"] for r in dicts(tp.missing_values(df))}
    assert got == pdf.isna().sum().to_dict()
    total = int(pdf.isna().sum().sum())
    assert dicts(tp.total_missing(df)) == [{"total_missing": total}]
    assert column(tp.missing_values(df, "present")) == ["gaps", "s", "b"]
    assert [r["column"] for r in tp.missing_values(df, "sorted").collect()] == ["s", "b", "gaps"] or (
        got["gaps"] > got["s"]
    )
    share = pdf.gaps.isna().mean() * 100
    assert dicts(tp.missing_values(df))[1]["missing_pct"] == pytest.approx(round(share, 2))


def test_most_missing_breaks_ties_by_position(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, None)], "a int, b int, c int, d int")
    assert [(r["rank"], r["column"], r["missing_count"]) for r in tp.most_missing(df).collect()] == [
        (1, "b", 2),
        (2, "c", 2),
        (3, "d", 1),
    ]


def test_missing_of_empty_and_all_missing(spark):
    empty = spark.createDataFrame([], "a int, s string")
    assert [r["missing_pct"] for r in tp.missing_values(empty).collect()] == [None, None]
    none = spark.createDataFrame([(None, None), (NAN, None)], "a double, s string")
    assert [r["missing_pct"] for r in tp.missing_values(none).collect()] == [100.0, 100.0]
    row = dicts(tp.describe(none))[0]
    assert row["count"] == 0 and row["mean"] is None and row["p50"] is None


def test_describe(mixed):
    df, pdf = mixed
    want = pdf[["id", "gaps", "skewed"]].describe().T
    for row in dicts(tp.describe(df)):
        w = want.loc[row["column"]]
        got = [row[k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert np.allclose(got, w.to_numpy(dtype=float)), row["column"]


def test_describe_of_one_row_and_no_rows(spark):
    one = dicts(tp.describe(spark.sql("SELECT 3 AS v")))[0]
    assert (one["mean"], one["std"], one["p25"]) == (3.0, None, 3.0)
    none = dicts(tp.describe(spark.createDataFrame([], "v int")))[0]
    assert (none["count"], none["min"], none["p75"]) == (0, None, None)
    assert tp.describe(spark.sql("SELECT 'x' AS s")).count() == 0


def test_describe_text(spark):
    df = spark.createDataFrame([("b", True), ("a", None), ("b", True), ("a", False), (None, True)], "s string, t boolean")
    assert dicts(tp.describe_text(df), "position") == [
        {"position": 0, "column": "s", "count": 4, "unique": 2, "top": "a", "freq": 2},
        {"position": 1, "column": "t", "count": 4, "unique": 2, "top": "true", "freq": 3},
    ]
    nothing = spark.createDataFrame([(None,)], "s string")
    assert dicts(tp.describe_text(nothing))[0] == {
        "position": 0, "column": "s", "count": 0, "unique": 0, "top": None, "freq": None,
    }


def test_skewness(mixed):
    df, pdf = mixed
    for row in dicts(tp.skewness(df)):
        assert row["skewness"] == pytest.approx(pdf[row["column"]].skew())
    assert {r["column"]: r["direction"] for r in dicts(tp.skewness(df))}["skewed"] == "right"


@pytest.mark.parametrize(
    "values", [[1.0, 2.0], [5.0] * 10, [1.0, 2.0, 3.0, 10.0], [-1.0, -2.0, -3.0, -40.0], [0.1] * 7, [1.0, 2.0, 3.0]]
)
def test_skewness_edges(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got, want = dicts(tp.skewness(df))[0], pd.Series(values).skew()
    assert got["skewness"] == (None if np.isnan(want) else pytest.approx(want, abs=1e-9))
    assert got["direction"] == ("right" if want > 1 else "left" if want < -1 else None)


def outlier_rows_of(n_out, n):
    """A table in which exactly ``n_out`` of ``n`` values lie outside the fences."""
    inside = [float(i % 10) for i in range(n - n_out)]
    return [(v,) for v in inside + [1000.0 + i for i in range(n_out)]]


def test_outlier_share_must_exceed_five_percent(spark):
    at = spark.createDataFrame(outlier_rows_of(50, 1000), "v double")
    over = spark.createDataFrame(outlier_rows_of(501, 10_000), "v double")
    assert dicts(tp.outlier_summary(at, "chosen"))[0]["outlier_pct"] == 5.0
    assert dicts(tp.outlier_summary(at, "advice")) == []
    assert dicts(tp.outlier_summary(over, "advice"))[0]["outlier_pct"] == 5.01


def test_value_on_a_fence_is_no_outlier(spark):
    # Quartiles 1 and 3, fences -2 and 6.
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4)] + [(None,)], "v double")
    bounds = dicts(tp.quartiles_iqr(df))[0]
    assert (bounds["q1"], bounds["q3"], bounds["lower"], bounds["upper"]) == (1.0, 3.0, -2.0, 6.0)
    rows = [(float(v),) for v in [0] * 10 + [1] * 30 + [2] * 20 + [3] * 30 + [4] * 10 + [6, -2]]
    edge = spark.createDataFrame(rows, "v double")
    assert tp.outlier_rows(edge, "v").count() == 0
    out = edge.union(spark.createDataFrame([(6.5,)], "v double"))
    assert column(tp.outlier_rows(out, "v"), "v") == [6.5]


def test_insight_outliers_look_at_three_columns(spark):
    df = spark.createDataFrame(outlier_rows_of(3, 100), "v double").selectExpr(
        "1 AS a", "2 AS b", "v AS c", "v AS d"
    )
    assert column(tp.outlier_summary(df, "insight")) == ["c"]


def test_column_summary(mixed):
    df, pdf = mixed
    row = dicts(tp.column_summary(df, "gaps"))[0]
    assert row["median"] == pytest.approx(pdf.gaps.median())
    with pytest.raises(ValueError):
        tp.column_summary(df, "s")


def test_selection(mixed, spark):
    df, _ = mixed
    assert tp.select_columns(df).columns == df.columns
    assert tp.select_columns(df, ["s", "id"]).columns == ["s", "id"]
    with pytest.raises(ValueError):
        tp.select_columns(df, ["nope"])
    assert column(tp.sample_rows(df, ["id"]), "id") == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        tp.sample_rows(df, [])
    for bad in (None, spark.createDataFrame([], "a int")):
        with pytest.raises(ValueError):
            tp.require_rows(bad)
    assert tp.require_rows(df) is df


def test_wide_tables_are_described_in_batches(spark):
    df = spark.range(20).selectExpr(*[f"id + {k} AS c{k}" for k in range(85)])
    got = dicts(tp.describe(df), "position")
    assert [r["column"] for r in got] == df.columns
    assert [r["p50"] for r in got] == [9.5 + k for k in range(85)]
