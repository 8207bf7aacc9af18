import math

import numpy as np
import pytest

import tableprofile as tp
from tableprofile.operators import facts as G
from tests.conftest import dicts

NAN = float("nan")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 5000
    x = rng.normal(100, 5, n)
    rows = [
        (
            None if i % 7 == 0 else float(x[i]),
            NAN if i % 5 == 0 else float(2 * x[i] + rng.normal()),
            int(i % 4),
            "2020-01-%02d" % (1 + i % 28) if i % 3 else None,
            "one two three four %d" % i,
            bool(i % 2),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "x double, y double, k int, day string, words string, flag boolean").repartition(6).cache()


def test_facts_equal_plain_aggregates(table):
    facts = G.Facts(table)
    want = table.selectExpr("count(x)", "avg(x)", "stddev_samp(x)", "min(x)", "max(x)", "percentile(x, array(0.25, 0.5, 0.75))").first()
    f = facts.number["x"]
    assert facts.n_rows == 5000 and f.count == want[0] and (f.low, f.high) == (want[3], want[4])
    assert math.isclose(f.mean, want[1], rel_tol=1e-12) and math.isclose(f.std, want[2], rel_tol=1e-10)
    assert np.allclose(facts.quantiles(["x"])["x"], want[5], rtol=1e-12)
    assert facts.number["k"].few == [0, 1, 2, 3] and f.few is None
    assert facts.missing("y") == 1000 and facts.missing("day") == table.where("day IS NULL").count()
    assert facts.other["day"].all_dates and not facts.other["words"].all_dates and facts.other["words"].prose


def test_parts_with_and_without_facts_agree(table):
    facts = G.Facts(table)
    for part in (
        lambda **k: tp.describe(table, **k),
        lambda **k: tp.quartiles_iqr(table, **k),
        lambda **k: tp.skewness(table, **k),
        lambda **k: tp.missing_values(table, **k),
        lambda **k: tp.column_roles(table, **k),
        lambda **k: tp.outlier_summary(table, **k),
        lambda **k: tp.top_correlations(table, "table", **k),
        lambda **k: tp.insights(table, **k),
        lambda **k: tp.preprocessing_suggestions(table, **k),
        lambda **k: tp.feature_ideas(table, **k),
    ):
        alone, shared = dicts(part()), dicts(part(facts=facts))
        assert len(alone) == len(shared)
        for a, b in zip(alone, shared):
            assert a.keys() == b.keys()
            for key in a:
                same = math.isclose(a[key], b[key], rel_tol=1e-9, abs_tol=1e-9) if isinstance(a[key], float) else a[key] == b[key]
                assert same, (key, a, b)


def test_approx_parts(table):
    exact, approx = dicts(tp.describe(table), "position"), dicts(tp.describe(table, mode="approx"), "position")
    for a, b in zip(exact, approx):
        # The sketch gives a value of the column, not one between two.
        assert a["count"] == b["count"] and math.isclose(a["p50"], b["p50"], rel_tol=0.02, abs_tol=0.5)


def test_scans_of_insights(spark, table, monkeypatch):
    """Insights read the number columns once for facts, once for brackets and once for outliers; others once."""
    scans = []
    for name in ("number_facts", "other_facts", "settled"):
        run = getattr(G, name)
        monkeypatch.setattr(G, name, lambda *a, run=run, name=name, **k: scans.append(name) or run(*a, **k))
    parts = tp.analyze(table.drop("flag"), ["x"])
    assert sorted(scans) == ["number_facts", "other_facts", "settled"]
    assert parts["insights"].count() > 4 and parts["shape"].first() == (5000, 5)


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_no_values(spark, rows):
    df = spark.createDataFrame(rows, "x double, y int, t string")
    facts = G.Facts(df)
    assert facts.n_rows == len(rows) and facts.quantiles(["x"]) == {"x": [None] * 3}
    out = dicts(tp.describe(df), "position")
    assert [r["count"] for r in out] == [0, 0] and out[0]["mean"] is None and out[0]["p50"] is None
    assert facts.other["t"].all_dates and facts.outliers(["x"]) == {"x": 0}


def test_no_columns_of_a_kind(spark):
    numbers, texts = spark.range(5), spark.createDataFrame([("a",), ("b",)], "t string")
    assert G.Facts(numbers).n_rows == 5 and G.Facts(numbers).other == {}
    assert G.Facts(texts).n_rows == 2 and G.Facts(texts).number == {}


def test_wide_tables(spark):
    """Described, searched for roles and missing cells in batches, correlated in tiles."""
    k = 300
    df = spark.range(40).selectExpr(*[f"id * {i + 1} % {i % 13 + 2} AS c{i}" for i in range(k)])
    assert tp.describe(df).count() == k
    assert dicts(tp.column_roles(df.select(df.columns[:120]))) == dicts(tp.column_roles(df))[:120]
    assert tp.missing_values(df).count() == k
    assert [r["column"] for r in dicts(tp.skewness(df), "position")] == df.columns
    top = dicts(tp.top_correlations(df, "table"), "rank")
    assert len(top) == 10 and all(abs(abs(r["r"]) - 1) < 1e-12 for r in top)
