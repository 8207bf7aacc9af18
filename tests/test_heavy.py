from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tableprofile as tp
from tableprofile.operators import frequency, heavy
from tests.conftest import dicts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=40), min_size=1, max_size=5), st.integers(1, 6), st.integers(1, 4))
def test_counts_are_bounded(parts, capacity, k):
    total = heavy.FrequentHashes.empty()
    for part in parts:
        own = heavy.FrequentHashes.empty()
        for v in part:
            own = own.merge(heavy.FrequentHashes(np.array([v]), np.array([1])), capacity)
        total = total.merge(own, capacity)
    true = Counter(v for p in parts for v in p)
    kept = dict(zip(total.hashes.tolist(), total.counts.tolist()))
    assert len(kept) <= capacity
    for v, n in true.items():
        assert kept.get(v, 0) <= n <= kept.get(v, 0) + total.err
    top = total.top(k)
    if top is not None:
        best = sorted(true, key=lambda v: (-true[v], v))[:k]
        assert set(best) <= set(top)


def brute(rows, i, k):
    counts = Counter(r[i] for r in rows if r[i] is not None)
    return [(str(v), n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize("capacity", [2, 8, 4096])
def test_top_values_of_any_spread(spark, monkeypatch, capacity):
    """Hot, flat, tied, long and missing values; small summaries leave columns to be grouped."""
    monkeypatch.setattr(heavy, "CAPACITY", capacity)
    rng = np.random.default_rng(3)
    long = ["x" * 80 + str(i) for i in range(30)]
    rows = [
        (
            "hot" if i % 3 == 0 else f"v{int(rng.integers(0, 400))}",
            f"id{i:05}",
            int(rng.integers(0, 5)),
            None,
            long[int(rng.integers(0, 30))] if i % 2 else long[7],
            "y" * 100 + str(i // 2),
            "z" * 90 + str(i if i % 50 else 0),
        )
        for i in range(1500)
    ]
    schema = "hot string, flat string, k int, none string, long string, pairs string, once string"
    df = spark.createDataFrame(rows, schema).repartition(4)
    out = dicts(tp.top_values(df, 5, df.columns), "position", "rank")
    for i, name in enumerate(df.columns):
        assert [(r["value"], r["n"]) for r in out if r["column"] == name] == brute(rows, i, 5), name


def test_long_texts_are_not_sent(spark):
    """A long text that fills a third of a column and long texts that occur once are looked up, not joined."""
    df = spark.range(900).selectExpr("if(id % 3 = 0, repeat('a', 100), repeat('b', 100) || id) AS t")
    plan = frequency._ranked(df, "t", 3, True)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    top = plan.first()["top"]
    assert [(r["value"][:1], r["n"]) for r in top] == [("a", 300), ("b", 1), ("b", 1)]
