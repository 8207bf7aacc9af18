import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprofile.operators import summaries as S


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.integers(-9, 9).map(float), max_size=60), min_size=1, max_size=5),
    st.integers(2, 9),
    st.integers(4, 40),
)
def test_brackets_hold_the_value(parts, kept, chunk):
    """Whatever is pruned and merged, the value at every rank lies in its bracket."""
    states = []
    for part in parts:
        summary = S.RankSummary(kept, chunk, 0)
        for k in range(0, len(part), 7):
            summary.add(np.array(part[k : k + 7]))
        states.append(summary.result())
    values = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    whole = S.merged(states, kept)
    assert whole[1].sum() == pytest.approx(len(values))
    for rank, v in enumerate(values):
        b = S.bracket(whole, rank)
        if b.value is not None:
            assert b.value == v
        else:
            assert (b.lo is None or b.lo < v) and (b.hi is None or v <= b.hi)
            inside = ((values > (-np.inf if b.lo is None else b.lo)) & (values <= (np.inf if b.hi is None else b.hi))).sum()
            assert b.mid is None or b.mid not in (b.lo, b.hi)
            assert inside <= b.rows


def test_error_stays_small():
    rng = np.random.default_rng(0)
    summary = S.RankSummary(256, 1024, 0)
    data = rng.normal(size=200_000)
    for part in np.array_split(data, 300):
        summary.add(part)
    values, weights, err = summary.result()
    assert len(values) <= 256 and err < 0.025 * len(data)
    up_to = np.cumsum(weights)
    true = np.searchsorted(np.sort(data), values, "right")
    assert np.abs(up_to - true).max() <= err + 1


def matrices(seed, k=4, n=700):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 1, (k, n))
    x[1] = x[0] * 2 + rng.normal(size=n)
    x[2] = 7.7
    x[rng.random((k, n)) < 0.2] = np.nan
    x[3, 100:400] = np.nan
    return x


def test_moments_merge():
    x = matrices(3)
    parts = [x[:, a:b] for a, b in ((0, 10), (10, 10), (10, 350), (350, 700))]
    made = [S.Moments.of(p, np.sort(p, axis=1)) for p in parts]
    total = made[0]
    for m in made[1:]:
        total = total.merge(m)
    n = (~np.isnan(x)).sum(axis=1)
    mean = np.nanmean(x, axis=1)
    d = x - mean[:, None]
    assert total.rows == 700 and (total.n == n).all()
    assert np.allclose(total.mean, mean, rtol=1e-14)
    assert np.allclose(total.m2, np.nansum(d**2, axis=1), rtol=1e-9, atol=1e-12)
    assert np.allclose(total.m3, np.nansum(d**3, axis=1), rtol=1e-6, atol=1e-6)
    assert (total.low == np.nanmin(x, axis=1)).all() and (total.high == np.nanmax(x, axis=1)).all()
    assert total.few[0] is None and total.few[2].tolist() == [7.7] and total.m2[2] == 0


def test_infinite_and_missing_values():
    x = np.array([[np.inf, 1.0, np.nan], [np.nan] * 3, [np.inf, -np.inf, 2.0]])
    m = S.Moments.of(x, np.sort(x, axis=1)).merge(S.Moments.of(x[:, 1:], np.sort(x[:, 1:], axis=1)))
    assert m.n.tolist() == [3, 0, 5] and m.mean[0] == np.inf and np.isnan(m.mean[2])
    assert m.low[2] == -np.inf and m.high[0] == np.inf


def test_pair_moments_merge():
    x = matrices(5)
    total = None
    for a, b in ((0, 100), (100, 130), (130, 700)):
        part = S.Shifted(x[:, a:b])
        tile = S.PairMoments.of(part, part, slice(0, 3), slice(1, 4))
        total = tile if total is None else total.merge(tile)
    r = total.correlation()
    for i in range(3):
        for j in range(3):
            a, b = x[i], x[1 + j]
            both = ~np.isnan(a) & ~np.isnan(b)
            if i == 2 or j == 1:
                assert np.isnan(r[i, j])
            else:
                assert np.isclose(r[i, j], np.corrcoef(a[both], b[both])[0, 1], atol=1e-9)
