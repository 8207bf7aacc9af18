import numpy as np
import pytest

import tableprofile as tp
from tests.conftest import column, dicts


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(8).gamma(2.0, 3.0, 3000)


@pytest.fixture(scope="module")
def df(spark, values):
    rows = [(i, float(v), None if i % 4 == 0 else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, v double, w double").repartition(3)


@pytest.mark.parametrize("bins", [5, 30, 100])
def test_histogram(df, values, bins):
    got = tp.histogram(df, "v", bins).collect()
    counts, edges = np.histogram(values, bins)
    assert [r["n"] for r in got] == counts.tolist()
    assert np.allclose([r["lo"] for r in got] + [got[-1]["hi"]], edges)
    assert sum(r["n"] for r in tp.histogram(df, "w", bins).collect()) == 2250


def test_histogram_checks_its_arguments(df):
    for bad in (4, 101):
        with pytest.raises(ValueError):
            tp.histogram(df, "v", bad)
    with pytest.raises(ValueError):
        tp.histogram(df.selectExpr("'x' AS s"), "s")


def test_histogram_auto_has_numpy_bins(df, values):
    got = tp.histogram_auto(df, "v").collect()
    counts, edges = np.histogram(values, "auto")
    assert [r["n"] for r in got] == counts.tolist()
    assert np.allclose([r["lo"] for r in got], edges[:-1])


def test_histogram_auto_without_spread_in_the_middle(spark):
    """The quartiles are equal, so only the number of rows sets the width."""
    data = [5.0] * 90 + [float(i) for i in range(10)]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    counts, _ = np.histogram(data, int(np.ceil(np.log2(100) + 1)))
    assert column(tp.histogram_auto(df, "v"), "n") == counts.tolist()


def test_histogram_of_constant_and_empty_columns(spark):
    flat = spark.createDataFrame([(5.0,)] * 7, "v double")
    assert [(r["lo"], r["hi"], r["n"]) for r in tp.histogram_auto(flat, "v").collect()] == [(4.5, 5.5, 7)]
    assert sum(column(tp.histogram(flat, "v", 5), "n")) == 7
    none = spark.createDataFrame([(None,)], "v double")
    assert tp.histogram(none, "v").count() == 0
    assert tp.histogram_auto(none, "v").count() == 0
    assert tp.kde(none, "v").count() == 0 and tp.kde(flat, "v").count() == 0


def test_histograms_default_to_three_columns(df):
    wide = df.selectExpr("*", "v + 1 AS x")
    assert set(column(tp.histograms(wide))) == {"id", "v", "w"}
    assert tp.histograms(df.selectExpr("'a' AS s")).count() == 0


@pytest.mark.parametrize("cut, grid", [(3.0, 200), (0.0, 50)])
def test_kde_is_the_sum_of_all_kernels(df, values, cut, grid):
    got = tp.kde(df, "v", grid, cut).collect()
    n, h = len(values), values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min() - cut * h, values.max() + cut * h, grid)
    u = (x[:, None] - values[None, :]) / h
    want = np.exp(-0.5 * u * u).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["x"] for r in got], x)
    assert np.allclose([r["density"] for r in got], want, rtol=1e-12, atol=1e-16)
    if cut:
        assert np.trapezoid(want, x) == pytest.approx(1, abs=2e-3)
        assert not got[0]["inside"] and got[grid // 2]["inside"]


def test_kde_with_a_far_value_keeps_empty_points(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(5000)] + [(1e6,)], "v double")
    got = tp.kde(df, "v").collect()
    assert len(got) == 200 and got[100]["density"] == 0.0


def test_box_stats(df, values):
    row = dicts(tp.box_stats(df, "v"))[0]
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = values[(values >= lower) & (values <= upper)]
    assert row["median"] == pytest.approx(q2) and row["iqr"] == pytest.approx(q3 - q1)
    assert (row["whisker_lo"], row["whisker_hi"]) == (inside.min(), inside.max())
    assert row["outlier_count"] == len(values) - len(inside)


def test_scatter(df):
    assert tp.scatter_points(df, "v", "w").count() == 2250
    sample = tp.scatter_points(df, "v", "w", "id", 50, ["id"])
    assert sample.columns == ["x", "y", "color"]
    again = tp.scatter_points(df.orderBy("v"), "v", "w", "id", 50, ["id"])
    assert sorted(column(sample, "color")) == sorted(column(again, "color"))
    with pytest.raises(ValueError):
        tp.scatter_points(df, "v", "w", n=5)
    assert tp.scatter_points(df, "v", "v").count() == 3000
    matrix = tp.scatter_matrix_points(df, color="id")
    assert matrix.columns == ["id", "v", "w", "color"] and matrix.count() == 3000


def test_missingness_map(spark):
    df = spark.range(100).selectExpr("id", "if(id >= 50, NULL, id) AS a", "if(id % 2 = 0, double('nan'), 1D) AS b")
    got = {(r["bucket"], r["column"]): r["missing_share"] for r in tp.missingness_map(df, "id", 2).collect()}
    assert got == {
        (1, "id"): 0.0, (1, "a"): 0.0, (1, "b"): 0.5, (2, "id"): 0.0, (2, "a"): 1.0, (2, "b"): 0.5,
    }
    flat = df.selectExpr("1 AS k", "a")
    assert {r["bucket"] for r in tp.missingness_map(flat, "k", 5).collect()} == {1}
    days = df.selectExpr("date_add(DATE'2024-01-01', int(id)) AS d", "a")
    assert {r["bucket"] for r in tp.missingness_map(days, "d", 4).collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        tp.missingness_map(df.selectExpr("'x' AS s"), "s")


def test_eda_bundle(spark, df):
    table = df.selectExpr("id", "v", "v * 2 + sin(id) AS u", "CAST(id % 3 AS STRING) AS s")
    charts = tp.eda_bundle(table, "id")
    assert list(charts) == [
        "missing_values_heatmap",
        "distribution_id", "density_id",
        "distribution_v", "density_v",
        "distribution_u", "density_u",
        "correlation_heatmap",
        "categorical_s",
        "scatter_plot", "scatter_line",
    ]
    assert charts["scatter_line"].first()["col_x"] == "u"
    assert [r["chart"] for r in tp.bundle_index(spark, {"one": table}).collect()] == ["one"]
    few = tp.eda_bundle(df.selectExpr("id", "'x' AS s"), "id")
    assert "scatter_plot" not in few
