"""Summaries of number columns that tasks build in numpy and that merge in any order.

``RankSummary`` knows how many values lie at or below any number, within a bound that it carries.
``Moments`` has counts, means, central moments, ends and the first few different values of columns.
``PairMoments`` has the co-moments of every two columns over the rows where both are known.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Values a task sorts at once, and values a summary keeps of any number of rows.
CHUNK = 1 << 16
KEPT = 1 << 12
#: Values up to which a summary keeps all of them.
EXACT = 1 << 17
#: Different values of a column that are told one by one.
FEW = 16
#: Below this share of the sum of squares a variance is rounding noise: the column is constant.
VARIANCE_NOISE = 1e-12

Weighted = tuple[np.ndarray, np.ndarray, float]  # sorted values, rows each stands for, bound of the error


def pruned(values: np.ndarray, weights: np.ndarray, err: float, kept: int) -> Weighted:
    """At most ``kept`` values, each for as many rows.

    Values are taken in the middle of equal shares of the rows, so that the number of rows up to any
    value is wrong by half a share at most.
    """
    if len(values) <= kept:
        return values, weights, err
    up_to = np.cumsum(weights)
    share = up_to[-1] / kept
    at = np.searchsorted(up_to, (np.arange(kept) + 0.5) * share)
    return values[at], np.full(kept, share), err + share / 2


def merged(parts: Iterable[Weighted], kept: int | None, exact: int = 0) -> Weighted:
    """One summary of all rows; errors add up. Without an error, up to ``exact`` values stay as they are."""
    parts = list(parts)
    if not parts:
        return np.zeros(0), np.zeros(0), 0.0
    values, weights = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")
    out = values[order], weights[order], float(sum(p[2] for p in parts))
    return out if kept is None or out[2] == 0 and len(out[0]) <= exact else pruned(*out, kept)


class RankSummary:
    """A summary of values that arrive in any order; ``kept=None`` keeps all of them.

    Beyond ``exact`` values full chunks are pruned, and summaries of equally many chunks are merged in pairs, so that a value
    is pruned as often as the number of chunks can be halved.
    """

    def __init__(self, kept: int | None = KEPT, chunk: int = CHUNK, exact: int = EXACT):
        self.kept, self.chunk, self.exact = kept, chunk, exact
        self._held: list[np.ndarray] = []
        self._size = 0
        self._levels: list[Weighted | None] = []

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self._held.append(values)
            self._size += len(values)
            if self.kept is not None and self._size >= (self.chunk if self._levels else max(self.chunk, self.exact + 1)):
                self._carry()

    def _sorted(self) -> Weighted:
        values = np.sort(np.concatenate(self._held), kind="stable")
        return values, np.ones(len(values)), 0.0

    def _carry(self) -> None:
        part = pruned(*self._sorted(), self.kept)
        self._held, self._size = [], 0
        for k, other in enumerate(self._levels):
            if other is None:
                self._levels[k] = part
                return
            part = merged([other, part], self.kept)
            self._levels[k] = None
        self._levels.append(part)

    def result(self) -> Weighted:
        parts = [p for p in self._levels if p is not None]
        return merged(parts + ([self._sorted()] if self._held else []), self.kept, self.exact)


@dataclass
class Bracket:
    """Where the value at a rank lies: it is ``value``, or above ``lo`` and not above ``hi``.

    ``mid`` is the likeliest value, ``rows`` at most lie in between. An open end is None.
    """

    value: float | None = None
    lo: float | None = None
    mid: float | None = None
    hi: float | None = None
    rows: float = 0.0


def bracket(summary: Weighted, rank: int) -> Bracket:
    """The bracket of the value at a rank (from 0) among the rows of a summary."""
    values, weights, err = summary
    last = np.r_[values[1:] != values[:-1], True]
    up_to = np.cumsum(weights)[last]
    values = values[last]
    if err == 0:
        return Bracket(value=float(values[np.searchsorted(up_to, rank + 1)]))
    err += 1e-9 * up_to[-1] + 1  # sums of shares are rounded
    low = int(np.searchsorted(up_to + err, rank + 1))  # those before have surely fewer rows up to them
    high = int(np.searchsorted(up_to - err, rank + 1))  # this one has surely as many
    likely = min(int(np.searchsorted(up_to, rank + 0.5)), len(values) - 1)
    lo = float(values[low - 1]) if low else None
    hi = float(values[high]) if high < len(values) else None
    mid = float(values[likely])
    rows = (up_to[high] if hi is not None else up_to[-1]) - (up_to[low - 1] if low else 0) + 2 * err
    return Bracket(lo=lo, mid=None if mid == hi or mid == lo else mid, hi=hi, rows=float(rows))


class Moments:
    """Facts of ``k`` columns, from a matrix with a row per column and NaN where a value is missing."""

    def __init__(self, k: int):
        self.rows = 0
        self.n, self.total = np.zeros(k), np.zeros(k)
        self.mean, self.m2, self.m3 = np.zeros(k), np.zeros(k), np.zeros(k)
        self.low, self.high = np.full(k, np.inf), np.full(k, -np.inf)
        self.few: list[np.ndarray | None] = [np.zeros(0)] * k

    @staticmethod
    def of(values: np.ndarray, ordered: np.ndarray) -> Moments:
        """``ordered`` has the values of every column sorted."""
        known = ~np.isnan(values)
        out = Moments(len(values))
        out.rows, out.n = values.shape[1], known.sum(axis=1).astype(float)
        if not values.shape[1]:
            return out
        out.low = np.where(out.n > 0, ordered[:, 0], np.inf)
        out.high = np.where(out.n > 0, ordered[np.arange(len(values)), np.maximum(out.n, 1).astype(int) - 1], -np.inf)
        with np.errstate(all="ignore"):
            out.total = np.where(known, values, 0.0).sum(axis=1)
            mean = np.where(out.low == out.high, out.low, out.total / out.n)
            off = np.where(known, values - mean[:, None], 0.0)
            rest = np.where(np.isfinite(mean), off.sum(axis=1) / out.n, 0.0)
            off = np.where(known, off - rest[:, None], 0.0)
            out.mean = np.where(out.n > 0, mean + rest, 0.0)
            square = off * off
            out.m2, out.m3 = square.sum(axis=1), (square * off).sum(axis=1)
        for i, n in enumerate(out.n.astype(int)):
            own = ordered[i, :n]
            out.few[i] = own[np.r_[True, own[1:] != own[:-1]]] if n else own
            if len(out.few[i]) > FEW:
                out.few[i] = None
        return out

    def column(self, i: int) -> Moments:
        """The facts of one column."""
        out = Moments(1)
        out.rows, out.few = self.rows, [self.few[i]]
        out.n, out.total, out.mean, out.m2, out.m3, out.low, out.high = (
            x[i : i + 1] for x in (self.n, self.total, self.mean, self.m2, self.m3, self.low, self.high)
        )
        return out

    def merge(self, other: Moments) -> Moments:
        out = Moments(len(self.n))
        out.rows, out.n = self.rows + other.rows, self.n + other.n
        with np.errstate(invalid="ignore"):
            out.total = self.total + other.total
        out.low, out.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        a, b, n = self.n, other.n, np.maximum(out.n, 1)
        with np.errstate(all="ignore"):
            d = np.where((a > 0) & (b > 0), other.mean - self.mean, 0.0)
            plain = (a * self.mean + b * other.mean) / n
            start = np.where(a > 0, self.mean, other.mean)
            out.mean = np.where(np.isfinite(d), start + np.where(a > 0, d * b / n, 0.0), plain)
            out.m2 = self.m2 + other.m2 + d * d * a * b / n
            out.m3 = (
                self.m3 + other.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * other.m2 - b * self.m2) / n
            )
        for i, (x, y) in enumerate(zip(self.few, other.few)):
            both = None if x is None or y is None else np.union1d(x, y)
            out.few[i] = None if both is None or len(both) > FEW else both
        return out


class Shifted:
    """Columns less a value near their mean, with zero where a value is missing."""

    def __init__(self, values: np.ndarray):
        known = ~np.isnan(values)
        self.known = known.astype(float)
        with np.errstate(all="ignore"):
            low = np.where(known, values, np.inf).min(axis=1, initial=np.inf)
            high = np.where(known, values, -np.inf).max(axis=1, initial=-np.inf)
            mean = np.where(known, values, 0.0).sum(axis=1) / self.known.sum(axis=1)
            # A column of one value becomes zeros, not rounding noise.
            mean = np.where(low == high, low, mean)
            self.shift = np.where(np.isnan(mean), 0.0, mean)
            self.off = np.where(known, values - self.shift[:, None], 0.0)


class PairMoments:
    """Co-moments of some columns (x) with some columns (y), over the rows where both are known.

    Cell (i, j) has the number of such rows, the means and second central moments of x i and of y j,
    and their mixed moment. The sums are matrix products of the values and of their masks.
    """

    FIELDS = ("n", "mean_x", "mean_y", "m2_x", "m2_y", "mxy")

    def __init__(self, *cells: np.ndarray):
        self.n, self.mean_x, self.mean_y, self.m2_x, self.m2_y, self.mxy = cells

    @staticmethod
    def of(x: Shifted, y: Shifted, rows: slice, columns: slice) -> PairMoments:
        """Of columns ``rows`` of ``x`` and columns ``columns`` of ``y``."""
        kx, ky, ox, oy = x.known[rows], y.known[columns], x.off[rows], y.off[columns]
        with np.errstate(all="ignore"):
            n, sx, sy = kx @ ky.T, ox @ ky.T, kx @ oy.T
            xx, yy = (ox * ox) @ ky.T, kx @ (oy * oy).T
            m2_x, m2_y = xx - sx * sx / n, yy - sy * sy / n
            mean_x, mean_y = x.shift[rows][:, None] + sx / n, y.shift[columns][None, :] + sy / n
            mxy = ox @ oy.T - sx * sy / n
        none = n == 0
        m2_x = np.where(none | (m2_x <= VARIANCE_NOISE * xx), 0.0, m2_x)
        m2_y = np.where(none | (m2_y <= VARIANCE_NOISE * yy), 0.0, m2_y)
        return PairMoments(n, *(np.where(none, 0.0, c) for c in (mean_x, mean_y, m2_x, m2_y, mxy)))

    def merge(self, other: PairMoments) -> PairMoments:
        n = self.n + other.n
        with np.errstate(all="ignore"):
            share = np.where(n > 0, other.n / n, 0.0)
            weight = self.n * share

            def step(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                d = np.where((self.n > 0) & (other.n > 0), b - a, 0.0)
                # Means of one and the same value differ by rounding.
                d = np.where(np.abs(d) <= 4e-15 * (np.abs(a) + np.abs(b)), 0.0, d)
                return d, np.where(self.n > 0, a + d * share, b)

            dx, mean_x = step(self.mean_x, other.mean_x)
            dy, mean_y = step(self.mean_y, other.mean_y)
            m2_x, m2_y = self.m2_x + other.m2_x + dx * dx * weight, self.m2_y + other.m2_y + dy * dy * weight
            return PairMoments(n, mean_x, mean_y, m2_x, m2_y, self.mxy + other.mxy + dx * dy * weight)

    def correlation(self) -> np.ndarray:
        """Pearson's r, NaN where either column is constant."""
        with np.errstate(all="ignore"):
            r = np.clip(self.mxy / (np.sqrt(self.m2_x) * np.sqrt(self.m2_y)), -1.0, 1.0)
            return np.where((self.n > 1) & (self.m2_x > 0) & (self.m2_y > 0) & np.isfinite(r), r, np.nan)
