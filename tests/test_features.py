import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprofile.features import categories, dates, missing, numbers, rows, selection, words
from tableprofile.operators import quantiles
from tests.conftest import column

NAN = float("nan")


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a"), (2, NAN, None), (3, None, "b"), (4, 4.0, "a"), (5, 10.0, "b")], "k int, x double, c string"
    )


def values(df, name):
    return [r[name] for r in df.orderBy("k").collect()]


@pytest.mark.parametrize("how,fill", [("mean", 5.0), ("median", 4.0), ("mode", 1.0)])
def test_impute(gaps, how, fill):
    assert values(missing.impute(gaps, ["x"], how), "x") == [1.0, fill, fill, 4.0, 10.0]


def test_impute_text_and_nothing(spark, gaps):
    assert values(missing.impute(gaps, ["c"], "mode"), "c") == ["a", "a", "b", "a", "b"]
    empty = spark.createDataFrame([(1, None)], "k int, x double")
    assert values(missing.impute(empty, ["x"]), "x") == [None]
    with pytest.raises(ValueError):
        missing.impute(gaps, ["x"], "zero")


def test_sparse_rows_and_columns(gaps):
    assert missing.drop_sparse_columns(gaps, 0.3).columns == ["k", "c"]
    assert missing.drop_sparse_rows(gaps, 0.4).count() == 4
    assert values(missing.missing_indicators(gaps, ["x"]), "x_missing") == [0, 1, 1, 0, 0]


def test_scaling(spark, gaps):
    assert np.allclose([v for v in values(numbers.standard_scale(gaps, ["x"]), "x_scaled") if v is not None],
                       (np.array([1, 4, 10]) - 5) / np.std([1, 4, 10]))
    assert values(numbers.min_max_scale(gaps, ["x"]), "x_scaled") == [0.0, None, None, 1 / 3, 1.0]
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double")
    assert values(numbers.standard_scale(flat, ["x"]), "x_scaled") == [None, None]
    assert values(numbers.min_max_scale(flat, ["x"]), "x_scaled") == [None, None]


def test_power_terms_and_box_cox(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 0.0), (3, 3.0)], "k int, x double")
    out = numbers.power_terms(df, ["x"])
    assert values(out, "x_log") == [None, 0.0, math.log(4)] and values(out, "x_sqrt") == [None, 0.0, math.sqrt(3)]
    assert values(out, "x_square") == [4.0, 0.0, 9.0]
    rng = np.random.default_rng(1)
    logs = spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.exp(rng.normal(size=400)))], "k int, x double")
    assert abs(numbers.box_cox_exponents(logs, ["x"]).first()["exponent"]) <= 0.2
    assert numbers.box_cox_exponents(df.where("x <= 0"), ["x"]).first()["exponent"] is None
    assert values(numbers.box_cox(df, ["x"]), "x_boxcox") == [None, None, None]


def test_bins(spark, gaps):
    assert values(numbers.bins(gaps, "x", 3), "x_bin") == [1, None, None, 2, 3]
    flat = spark.createDataFrame([(1, 5.0), (2, None)], "k int, x double")
    assert values(numbers.bins(flat, "x", 3), "x_bin") == [1, None]
    ten = spark.createDataFrame([(k, float(k)) for k in range(10)], "k int, x double")
    assert values(numbers.bins(ten, "x", 2, "count"), "x_bin") == [1] * 5 + [2] * 5


def test_combinations_and_clipping(spark):
    df = spark.createDataFrame([(k, float(v), float(k % 2)) for k, v in enumerate([1, 2, 3, 4, 100])], "k int, x double, z double")
    assert values(numbers.clip_outliers(df, ["x"]), "x") == [1.0, 2.0, 3.0, 4.0, 7.0]
    out = numbers.ratio_and_difference(df, "x", "z")
    assert values(out, "x_per_z") == [None, 2.0, None, 4.0, None] and values(out, "x_minus_z")[1] == 1.0
    assert numbers.polynomial_terms(df, ["x", "z"]).columns[3:] == ["x_x_x", "x_x_z", "z_x_z"]


def test_dates(spark):
    df = spark.sql("SELECT 1 AS k, DATE'2024-12-31' AS d, DATE'2025-01-02' AS e UNION ALL SELECT 2, NULL, NULL")
    out = dates.date_parts(df, "d").orderBy("k").first()
    assert tuple(out[3:]) == (2024, 4, 12, 31, 1)
    assert values(dates.days_between(df, "d", "e"), "days_d_to_e") == [2, None]
    assert values(dates.days_since(df, "d"), "days_since_d") == [0, None]
    assert np.isclose(values(dates.cyclical_parts(df, "d"), "d_weekday_sin")[0], math.sin(2 * math.pi / 7))
    with pytest.raises(ValueError):
        dates.cyclical_parts(df, "d", ["year"])


def test_categories(spark, gaps):
    assert values(categories.label_encode(gaps, "c"), "c_label") == [0, None, 1, 0, 1]
    assert values(categories.one_hot(gaps, "c"), "c_a") == [1, 0, 0, 1, 0]
    assert values(categories.target_encode(gaps, "c", "x"), "c_target") == [2.5, None, 10.0, 2.5, 10.0]
    assert values(categories.fold_rare(gaps, "c", 0.6), "c") == ["Other", None, "Other", "Other", "Other"]
    assert values(categories.interaction(gaps, ["c", "k"]), "c_k") == ["a_1", None, "b_3", "a_4", "b_5"]
    unseen = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "k int, c string")
    made = categories.apply_target_encoding(unseen, "c", gaps.where("c IS NOT NULL"), "x")
    assert values(made, "c_target") == [2.5, 5.0, 5.0]
    many = spark.range(categories.MAX_ONE_HOT + 1)
    with pytest.raises(ValueError):
        categories.one_hot(many, "id")


def test_group_statistics(gaps):
    out = categories.group_statistics(gaps, "c", "x").orderBy("k").collect()
    assert tuple(out[0][3:]) == (2.5, 2.5, 1.0, 4.0, -1.5) and tuple(out[1][3:]) == (None,) * 5


def test_medians_of_large_groups(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=5001), "b": rng.integers(0, 3, 4000), None: np.r_[np.zeros(3000), rng.normal(size=3000)], "c": [1, 4]}
    rows = [(g, float(v)) for g, xs in groups.items() for v in xs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "__value string, x double")
    out = {r["__value"]: r["__median"] for r in quantiles.grouped_medians(df).collect()}
    # Groups, one of them missing and one without a value, lie in several ranges.
    assert out.pop("d") is None and out.keys() == groups.keys()
    assert all(np.isclose(out[g], np.median(xs)) for g, xs in groups.items())


def test_labels_are_numbered_by_ranges(spark):
    df = spark.createDataFrame([(k, f"v{k * 7919 % 500:03}") for k in range(500)], "k int, c string")
    out = categories.label_encode(df, "c")
    assert values(out, "c_label") == [k * 7919 % 500 for k in range(500)]
    assert dict(out.dtypes)["c_label"] == "bigint"
    assert "Python" not in out._jdf.queryExecution().toString()


def test_many_groups_need_no_collect(spark, monkeypatch):
    """Medians of more groups than a driver should list, some over several ranges."""
    df = spark.range(60_000).selectExpr("if(id < 20000, -1, id div 2) AS __value", "double(id * 7919 % 60000) AS x")
    made = quantiles.grouped_medians(df)
    want = df.groupBy("__value").agg(F.median("x").alias("m"))
    assert made.count() == 20_001
    assert made.join(want, "__value").where("abs(__median - m) < 1e-9").count() == 20_001


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None)], "k int, c string")
    assert rows.drop_duplicate_rows(df).count() == 3 and rows.drop_duplicate_rows(df, ["k"]).count() == 2


def test_words(spark):
    df = spark.createDataFrame([(1, " The cat, the DOG!"), (2, None), (3, "cat"), (4, "!?")], "k int, t string")
    assert values(words.normalise_text(df, "t"), "t") == ["the cat the dog", None, "cat", ""]
    assert values(words.text_size(df, "t"), "t_words") == [4, None, 1, 0]
    bag = {(r["k"], r["word"]): r["n"] for r in words.bag_of_words(df, "k", "t").collect()}
    assert bag == {(1, "the"): 2, (1, "cat"): 1, (1, "dog"): 1, (3, "cat"): 1}
    weight = {(r["k"], r["word"]): r["weight"] for r in words.tf_idf(df, "k", "t").collect()}
    assert np.isclose(weight[1, "the"], 2 * (math.log(4 / 2) + 1)) and np.isclose(weight[3, "cat"], math.log(4 / 3) + 1)


def test_selection(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    data = np.c_[x, 2 * x + 0.1 * rng.normal(size=200), rng.normal(size=200)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    assert selection.drop_correlated(df, ["a", "b", "c"]).columns == ["a", "c"]
    found = selection.principal_components(df, ["a", "b", "c"], 3).collect()
    assert np.allclose([r["variance"] for r in found], np.linalg.eigvalsh(np.cov(data.T))[::-1])
    assert column(selection.principal_components(df, ["a", "b"], 1), "component") == [1]
    table = spark.createDataFrame([("p", "q", "y")] * 5 + [("r", "q", "n")] * 5, "u string, v string, t string")
    scores = {r["column"]: (r["information"], r["chi_square"]) for r in selection.feature_scores(table, ["u", "v"], "t").collect()}
    assert np.allclose(scores["u"], (math.log(2), 10.0)) and np.allclose(scores["v"], (0.0, 0.0))
