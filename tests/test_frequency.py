import pandas as pd
import pytest

import tableprofile as tp
from tableprofile.operators.frequency import long_text_columns
from tests.conftest import column, dicts


def of(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_top_values_ties_and_missing(spark):
    df = of(spark, ["b", "b", "a", "a", "c", None, None, None])
    assert [(r["rank"], r["value"], r["n"]) for r in dicts(tp.top_values(df), "rank")] == [
        (1, "a", 2),
        (2, "b", 2),
        (3, "c", 1),
    ]


def test_top_values_keeps_ten(spark):
    df = of(spark, [f"v{i:02d}" for i in range(11) for _ in range(11 - i)])
    assert column(tp.top_values(df), "value") == [f"v{i:02d}" for i in range(10)]


def test_top_values_of_low_cardinality_numbers(spark):
    df = of(spark, [0.0, -0.0, 1.0, float("nan")] * 50, "double")
    assert [(r["value"], r["n"]) for r in dicts(tp.top_values(df), "rank")] == [("0.0", 100), ("1.0", 50)]


def test_unique_counts(spark):
    long = "word " * 40
    values = ["a", "a", None, long + "1", long + "1", long + "2", "b"]
    df = of(spark, values)
    assert dicts(tp.unique_counts(df))[0]["n_unique"] == pd.Series(values).nunique()
    assert dicts(tp.unique_counts(df, mode="approx"))[0]["n_unique"] == 4
    nested = spark.sql("SELECT array(1) AS a")
    assert tp.unique_counts(nested).count() == 0


@pytest.mark.parametrize("n, found", [(10, []), (11, ["v"])])
def test_high_cardinality_edge(spark, n, found):
    df = of(spark, [f"x{i}" for i in range(n)])
    for variant in ("advice", "insight"):
        assert column(tp.high_cardinality(df, variant)) == found


def test_high_cardinality_of_six_columns(spark):
    rows = [tuple(f"{c}{i % (11 + c)}" for c in range(6)) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"c{c} string" for c in range(6)))
    assert column(tp.high_cardinality(df, "advice")) == ["c5", "c4", "c3", "c2", "c1"]
    assert column(tp.high_cardinality(df, "insight")) == ["c0", "c1"]


def bars(df):
    return [(r["rank"], r["value"], r["n"]) for r in tp.category_counts(df, "v").orderBy("rank").collect()]


def test_ten_categories_stay_and_missing_is_dropped(spark):
    df = of(spark, [f"v{i}" for i in range(10)] + ["v3", None, None])
    got = bars(df)
    assert len(got) == 10 and got[0] == (1, "v3", 2)
    assert sum(n for _, _, n in got) == 11


def test_eleven_categories_fold_and_missing_joins_other(spark):
    values = [f"v{i:02d}" for i in range(11) for _ in range(20 - i)] + [None] * 3
    got = bars(of(spark, values))
    assert len(got) == 10
    assert (10, "Other", 11 + 10 + 3) not in got
    assert dict((v, n) for _, v, n in got)["Other"] == 11 + 10 + 3
    assert sum(n for _, _, n in got) == len(values)
    assert [n for _, _, n in got] == sorted((n for _, _, n in got), reverse=True)


def test_a_category_called_other_joins_the_rest(spark):
    values = ["Other"] * 50 + [f"v{i:02d}" for i in range(12) for _ in range(20 - i)]
    got = dict((v, n) for _, v, n in bars(of(spark, values)))
    assert len(got) == 9 and sum(got.values()) == len(values)
    assert got["Other"] == 50 + sum(20 - i for i in range(8, 12))


def test_category_counts_of_nothing(spark):
    assert bars(of(spark, [None, None])) == []


def test_hot_value_is_counted_before_the_shuffle(spark):
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, 'hot', CAST(id AS STRING)) AS v")
    top = dicts(tp.top_values(df, k=1, names=["v"]))[0]
    assert (top["value"], top["n"]) == ("hot", 33_334)
    plan = tp.frequencies(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_long_text_is_counted_by_digest(spark, copies):
    """Ties, short values beside long ones, and missing rows; every value is that frequent or more."""
    values = [f"{i:02d} " + "word " * 30 for i in range(15) for _ in range(copies)]
    values += ["short"] * 3 + ["14 " + "word " * 30] * 2 + [None] * 4
    df = of(spark, values)
    assert long_text_columns(df, ["v"]) == {"v"}
    want = pd.Series(values).value_counts().reset_index()
    want.columns = ["value", "n"]
    want = want.sort_values(["n", "value"], ascending=[False, True]).head(10)
    got = [(r["value"], r["n"]) for r in dicts(tp.top_values(df), "rank")]
    assert got == list(want.itertuples(index=False, name=None))
    text = dicts(tp.describe_text(df))[0]
    assert (text["count"], text["unique"], text["freq"]) == (len(values) - 4, 16, max(copies + 2, 3))
    assert text["top"] == want.value.iloc[0]
    assert sum(n for _, _, n in bars(df)) == len(values)


def test_hot_long_text(spark):
    df = spark.range(3000).selectExpr("repeat(if(id % 3 = 0, 'hot ', concat(id, ' ')), 40) AS v")
    top = dicts(tp.top_values(df, k=1, names=["v"]))[0]
    assert (top["value"], top["n"]) == ("hot " * 40, 1000)
