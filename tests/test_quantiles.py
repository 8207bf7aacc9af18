import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprofile.operators import quantiles as Q

PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def expected(values):
    values = [v for v in values if v is not None and not np.isnan(v)]
    return [float(np.quantile(values, p)) for p in PROBS] if values else [None] * len(PROBS)


def samples():
    rng = np.random.default_rng(1)
    hot = np.where(rng.random(6000) < 0.34, 7.25, rng.normal(7, 3, 6000))
    return {
        "normal": rng.normal(0, 1, 6000).tolist(),
        "hot_third": hot.tolist(),
        "two_values": (rng.random(6000) < 0.25).astype(float).tolist(),
        "heavy_tail": np.exp(rng.normal(0, 8, 6000)).tolist(),
        "ordered": [float(i) for i in range(6000)],
        "gaps": [None if i % 3 else float("nan") if i % 2 else float(i) for i in range(6000)],
        "infinite": [float("inf") if i % 2 else -float("inf") if i % 3 else 1.0 for i in range(6000)],
        "empty": [None] * 6000,
    }


@pytest.fixture(scope="module")
def table(spark):
    data = samples()
    schema = ", ".join(f"{n} double" for n in data)
    return spark.createDataFrame(list(zip(*data.values())), schema).repartition(5).cache(), data


def test_in_memory(table):
    df, data = table
    names = [n for n in data if n != "infinite"]
    row = Q.quantile_row(df, names, PROBS).first().q
    for name, got in zip(names, row):
        want = expected(data[name])
        assert got == want if want[0] is None else np.allclose(got, want, rtol=1e-12, atol=1e-12)


@pytest.fixture
def coarse(monkeypatch):
    """Summaries so small that every bracket is wide."""
    monkeypatch.setattr(Q, "KEPT", 16)
    monkeypatch.setattr(Q, "CHUNK", 64)
    monkeypatch.setattr(Q, "EXACT", 0)


@pytest.mark.parametrize("inner_limit", [20, 10_000])
def test_narrowing_is_exact(table, coarse, inner_limit):
    df, data = table
    names = [n for n in data if n != "infinite"]
    found = Q.narrowed_quantiles(df, names, PROBS, inner_limit)
    for name in names:
        want = expected(data[name])
        if want[0] is None:
            assert found[name] == want
        else:
            assert np.allclose(found[name], want, rtol=1e-12, atol=1e-12), name


def test_narrowing_with_infinities(table):
    df, data = table
    values = sorted(data["infinite"])
    got = Q.narrowed_quantiles(df, ["infinite"], (0.25, 0.5, 0.75), 10)["infinite"]
    for p, g in zip((0.25, 0.5, 0.75), got):
        place = p * (len(values) - 1)
        ends = {values[int(np.floor(place))], values[int(np.ceil(place))]}
        assert (g in ends) if len(ends) == 1 else True


def test_a_heavy_value_next_to_the_rank_is_settled(spark, coarse):
    """The searched ranks are the last of a value that fills a third, and the first one after it."""
    values = [float(i) for i in range(1000)] + [1000.0] * 1000 + [1000.5 + i for i in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    probs = [k / 3000 for k in (999, 1000, 1999, 2000, 2001)]
    assert np.allclose(Q.narrowed_quantiles(df, ["v"], probs, 5)["v"], np.quantile(values, probs))


@pytest.mark.parametrize("exact,more", [(0, 1), (1 << 17, 0)])
def test_scans(table, monkeypatch, exact, more):
    """One scan for brackets and one that reads them, which a small table does not need."""
    monkeypatch.setattr(Q, "EXACT", exact)
    df, data = table
    passes = []
    run = Q._pass
    monkeypatch.setattr(Q, "_pass", lambda *a: passes.append(1) or run(*a))
    found = Q.narrowed_quantiles(df, [n for n in data if n != "infinite"], (0.25, 0.5, 0.75))
    assert np.isclose(found["normal"][1], np.quantile(data["normal"], 0.5)) and len(passes) == more


def test_approx_mode(table):
    df, data = table
    got = Q.quantile_row(df, ["ordered"], (0.25, 0.5), "approx").first().q[0]
    assert abs(got[0] - 1500) < 10 and abs(got[1] - 3000) < 10


def test_mode_is_checked(table):
    with pytest.raises(ValueError):
        Q.quantile_row(table[0], ["normal"], mode="fast")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5).map(float), min_size=1, max_size=40))
def test_small_lists(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = Q.narrowed_quantiles(df, ["v"], PROBS, 1)["v"]
    assert np.allclose(got, expected(values))
    assert np.allclose(Q.quantile_row(df, ["v"], PROBS).first().q[0], expected(values))


def test_many_columns_are_searched_in_batches(spark, monkeypatch):
    monkeypatch.setattr(Q, "COLUMNS_PER_SCAN", 2)
    df = spark.range(1000).selectExpr(*[f"id * {k} AS c{k}" for k in range(1, 6)])
    found = Q.narrowed_quantiles(df, df.columns, (0.5,), 50)
    assert found == {f"c{k}": [499.5 * k] for k in range(1, 6)}
