import numpy as np
import pytest

import tableprofile as tp
from tableprofile.plans import messages as M
from tests.conftest import dicts


def texts(df, section=None):
    rows = [r for r in dicts(df, "section", "seq") if section in (None, r["section"])]
    assert [r["seq"] for r in rows if r["section"] == rows[0]["section"]] == list(
        range(1, 1 + sum(r["section"] == rows[0]["section"] for r in rows))
    )
    return [r["text"] for r in rows]


def with_missing(spark, *missing, rows=100):
    """A table with a column per number, in which that many of the rows are missing."""
    cols = [f"if(id < {m}, NULL, id) AS c{i}" for i, m in enumerate(missing)]
    return spark.range(rows).selectExpr(*cols)


def test_missing_insights(spark):
    assert texts(tp.missing_insights(with_missing(spark, 0, 0))) == [M.MISSING["none"]]
    assert texts(tp.missing_insights(with_missing(spark, 50, 7, 0))) == [
        "Found 2 columns with missing values.",
        "Column 'c0' has 50 missing values (50.00%).",
        "Column 'c1' has 7 missing values (7.00%).",
        M.MISSING["impute"],
    ]
    assert texts(tp.missing_insights(with_missing(spark, 1, 51, 60, 70, 80))) == [
        "Found 5 columns with missing values.",
        "Column 'c0' has 1 missing values (1.00%).",
        "Column 'c1' has 51 missing values (51.00%).",
        "Column 'c2' has 60 missing values (60.00%).",
        "And 2 more columns have missing values.",
        "Consider dropping columns with >50% missing values: c1, c2, c3.",
    ]
    assert len(texts(tp.missing_insights(with_missing(spark, 1, 1, 1)))) == 5


def test_distribution_insights(spark):
    assert texts(tp.distribution_insights(spark.sql("SELECT 'x' AS s"))) == [M.DISTRIBUTION["none"]]
    df = spark.range(100).selectExpr(
        "id", "pow(id, 6) AS p", "-pow(id, 6) AS m", "id AS x", "id AS y"
    )
    got = texts(tp.distribution_insights(df))
    assert got[0].startswith("Column 'p' is right-skewed (skewness: 1.") and "'p' has" in got[1]
    assert got[2].startswith("Column 'm' is left-skewed (skewness: -1.") and "'m' has" in got[3]
    assert got[4:] == ["Additional 2 numerical columns not analyzed here."]
    assert tp.distribution_insights(spark.range(50)).count() == 0
    assert tp.distribution_insights(spark.createDataFrame([(1.0,), (2.0,)], "v double")).count() == 0


def test_correlation_insights(spark):
    one = spark.range(5)
    assert texts(tp.correlation_insights(one)) == [M.CORRELATION["too_few"]]
    none = spark.range(100).selectExpr("id", "sin(id * 37) AS s")
    assert texts(tp.correlation_insights(none)) == [M.CORRELATION["none"]]
    many = spark.range(50).selectExpr("id AS a", "2 * id AS b", "-id AS c", "id + 1 AS d")
    assert texts(tp.correlation_insights(many)) == [
        "Found 6 pairs of highly correlated features.",
        "'b' and 'a' are strongly positively correlated (r=1.00).",
        "'c' and 'a' are strongly negatively correlated (r=-1.00).",
        "'c' and 'b' are strongly negatively correlated (r=-1.00).",
        "And 3 more highly correlated pairs found.",
        M.CORRELATION["advice"],
    ]


@pytest.mark.parametrize("numbers, hint", [(1, False), (2, True), (4, True), (5, False)])
def test_feature_insights(spark, numbers, hint):
    cols = [f"id AS n{i}" for i in range(numbers)]
    df = spark.range(40).selectExpr(
        *cols, "CAST(date_add(DATE'2024-01-01', int(id)) AS STRING) AS d", "concat('v', id % 11) AS s",
        "CAST(id AS STRING) AS t",
    )
    assert texts(tp.feature_insights(df)) == [
        "Found 1 potential date columns: d.",
        M.FEATURES["date_parts"],
        "Found 3 categorical columns.",
        M.FEATURES["encoding"],
        M.FEATURES["high"],
        "Column 'd' has 40 unique values. Consider grouping less common categories.",
        "Column 's' has 11 unique values. Consider grouping less common categories.",
    ] + [M.FEATURES["polynomial"]] * hint


def test_feature_insights_without_text(spark):
    assert tp.feature_insights(spark.range(5)).count() == 0


def test_insights_have_all_sections(spark):
    sections = {r["section"] for r in tp.insights(with_missing(spark, 3, 0)).collect()}
    assert sections == {
        "Missing Values Analysis",
        "Correlation Analysis",
        "Feature Engineering Recommendations",
    }


def test_preprocessing_suggestions(spark):
    df = spark.range(400).selectExpr(
        "if(id >= 370, 100000 + id, id) AS n",
        "concat('k', id % 12) AS s",
        *[f"if(id < 3, NULL, 'x') AS m{i}" for i in range(6)],
    )
    rows = tp.preprocessing_suggestions(df)
    assert texts(rows, "numerical") == ["Found 1 numerical columns.", *M.SUGGEST_NUMERICAL["steps"]]
    assert texts(rows, "outliers") == ["Column 'n' has 30 potential outliers (7.5%)."]
    assert texts(rows, "categorical") == [
        "Found 7 categorical columns.",
        M.SUGGEST_CATEGORICAL["high"],
        "- s: 12 unique values",
        *M.SUGGEST_CATEGORICAL["high_steps"],
        *M.SUGGEST_CATEGORICAL["encoding"],
    ]
    assert texts(rows, "missing_values") == [
        "Found 6 columns with missing values.",
        "Columns with highest missing values: m0, m1, m2, m3, m4...",
        *M.SUGGEST_MISSING["strategies"],
    ]
    assert texts(rows, "general") == M.SUGGEST_GENERAL


def test_suggestions_without_categories(spark):
    sections = {r["section"] for r in tp.preprocessing_suggestions(spark.range(100)).collect()}
    assert sections == {"numerical", "general"}


@pytest.mark.parametrize("numbers", [0, 1, 2, 10, 11])
def test_feature_ideas(spark, numbers):
    cols = [f"id AS n{i}" for i in range(numbers)]
    df = spark.range(50).selectExpr(*cols, "'x' AS birthday", "'a b c d' AS t")
    got = texts(tp.feature_ideas(df))
    want = []
    if numbers >= 2:
        want += M.IDEAS_NUMERICAL + [t.format(columns="birthday") for t in M.IDEAS_TIME]
    want += M.IDEAS_CATEGORICAL
    want += M.IDEAS_MIXED if numbers else []
    want += M.IDEAS_REDUCTION if numbers > 10 else []
    want += [t.format(columns="t") for t in M.IDEAS_TEXT]
    assert got == want


def test_analyze(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(
        [(i, float(v), "ab"[i % 2]) for i, v in enumerate(rng.normal(0, 1, 60))], "id int, v double, s string"
    )
    for mode in ("exact", "approx"):
        parts = tp.analyze(df, ["id"], mode)
        assert [r["column"] for r in parts["numerical_columns"].collect()] == ["id", "v"]
        assert all(t.count() >= 0 for t in parts.values())
    with pytest.raises(ValueError):
        tp.analyze(df.where("id < 0"), ["id"])


@pytest.mark.parametrize("kept", ["s", "v"])
def test_analyze_of_one_kind_of_column(spark, kept):
    df = spark.range(30).selectExpr("CAST(id AS DOUBLE) AS v", "concat('k', id % 3) AS s").select(kept)
    parts = tp.analyze(df, [kept])
    assert all(t.count() >= 0 for t in parts.values())
    assert parts["basic_stats"].count() == 1
