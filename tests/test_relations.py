import numpy as np
import pandas as pd
import pytest

import tableprofile as tp
from tests.conftest import dicts


def frame_of(spark, pdf):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(4)


def matrix(df, names=None):
    out = {}
    for r in tp.correlation_matrix(df, names).collect():
        out[r["col_x"], r["col_y"]] = r["r"]
    return out


def assert_like_pandas(got, pdf):
    want = pdf.corr()
    assert len(got) == len(pdf.columns) ** 2
    for (x, y), r in got.items():
        w = want.loc[x, y]
        # A column a billion away from zero has few digits left, in pandas too.
        near = 1e-6 if "far" in (x, y) else 1e-9
        assert r is None if np.isnan(w) else r == pytest.approx(w, abs=near), (x, y, r, w)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 400)
    out = pd.DataFrame({"a": a, "b": -2 * a + rng.normal(0, 0.3, 400), "flat": 5.1, "tenth": 0.1})
    out["c"] = np.where(rng.random(400) < 0.3, np.nan, a + rng.normal(0, 1, 400))
    out["d"] = np.where(rng.random(400) < 0.3, np.nan, rng.normal(0, 1, 400))
    out["far"] = 1e9 + a
    return out


def test_matrix(spark, pdf):
    got = matrix(frame_of(spark, pdf))
    assert_like_pandas(got, pdf)
    assert all(got[x, y] == got[y, x] for x, y in got)


def test_many_columns_in_one_scan(spark):
    rng = np.random.default_rng(6)
    wide = pd.DataFrame(rng.normal(0, 1, (200, 40)), columns=[f"c{i}" for i in range(40)])
    assert_like_pandas(matrix(frame_of(spark, wide)), wide)


def test_constant_only_where_both_are_known(spark):
    pdf = pd.DataFrame({"x": [1.0, 1.0, 1.0, 9.0, 4.0], "y": [1.0, 2.0, 3.0, np.nan, np.nan]})
    assert matrix(frame_of(spark, pdf))["x", "y"] is None


def test_tables_without_pairs(spark):
    assert tp.correlation_matrix(spark.sql("SELECT 'x' AS s")).count() == 0
    one = spark.sql("SELECT 1.0D AS v UNION ALL SELECT 2.0D")
    assert matrix(one) == {("v", "v"): 1.0}
    for variant in ("profile", "context", "insight", "heatmap", "table"):
        assert tp.top_correlations(one, variant).count() == 0
    assert tp.most_correlated_pair(one).count() == 0
    empty = spark.createDataFrame([], "a double, b double")
    assert tp.top_correlations(empty, "context").count() == 0


def test_variants(spark, pdf):
    df = frame_of(spark, pdf)
    want = pdf.corr()
    context = dicts(tp.top_correlations(df, "context"))
    assert all(abs(r["r"]) > 0.5 for r in context) and len(context) <= 5
    names = list(pdf.columns)
    assert all(names.index(r["col_x"]) > names.index(r["col_y"]) for r in context)
    assert (context[0]["col_x"], context[0]["col_y"]) == ("far", "a")

    insight = dicts(tp.top_correlations(df, "insight"))
    expected = [
        (names[i], names[j])
        for i in range(len(names))
        for j in range(i)
        if abs(want.iloc[i, j]) > 0.7
    ]
    assert [(r["col_x"], r["col_y"]) for r in insight] == expected

    profile = dicts(tp.top_correlations(df, "profile"))
    assert all(names.index(r["col_x"]) < names.index(r["col_y"]) for r in profile)
    assert len(profile) == 10 and all(r["r"] is not None for r in profile)

    heatmap = dicts(tp.top_correlations(df, "heatmap", ["a", "b", "c"]))
    assert [r["r"] for r in heatmap] == sorted((r["r"] for r in heatmap), reverse=True)
    assert {(r["col_x"], r["col_y"]) for r in heatmap[:2]} == {("a", "c"), ("c", "a")}
    assert len(heatmap) == 5

    table = dicts(tp.top_correlations(df, "table", ["a", "flat", "b"]))
    assert [r["r"] is None for r in table] == [False, True, True]
    with pytest.raises(ValueError):
        tp.top_correlations(df, "best")


@pytest.mark.parametrize("r, context, insight", [(0.49, 0, 0), (0.51, 1, 0), (0.69, 1, 0), (-0.71, 1, 1)])
def test_thresholds(spark, r, context, insight):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 500)
    noise = rng.normal(0, 1, 500)
    x = (x - x.mean()) / x.std()
    noise -= noise.mean()
    noise -= x * (noise @ x) / (x @ x)
    noise /= noise.std()
    df = frame_of(spark, pd.DataFrame({"x": x, "y": r * x + np.sqrt(1 - r * r) * noise}))
    assert tp.top_correlations(df, "context").count() == context
    assert tp.top_correlations(df, "insight").count() == insight


def test_most_correlated_pair_and_line(spark, pdf):
    df = frame_of(spark, pdf[["a", "b", "c", "d"]])
    best = dicts(tp.most_correlated_pair(df))[0]
    assert (best["col_x"], best["col_y"]) == ("b", "a")
    line = dicts(tp.regression_line(df, "a", "c"))[0]
    known = pdf.dropna(subset=["a", "c"])
    slope, intercept = np.polyfit(known.a, known.c, 1)
    assert line["slope"] == pytest.approx(slope) and line["intercept"] == pytest.approx(intercept)
    assert line["n"] == len(known) and line["r"] == pytest.approx(known.a.corr(known.c))


def test_line_on_constant_columns(spark, pdf):
    df = frame_of(spark, pdf)
    assert dicts(tp.regression_line(df, "flat", "a"))[0]["slope"] is None
    assert dicts(tp.regression_line(df, "a", "flat"))[0]["r"] is None


def test_heatmap_below_the_diagonal(spark, pdf):
    df = frame_of(spark, pdf[["a", "b", "c"]])
    got = {(r["col_x"], r["col_y"]) for r in tp.correlation_heatmap(df, lower_only=True).collect()}
    assert got == {("b", "a"), ("c", "a"), ("c", "b")}
