"""Exact quantiles with linear interpolation, at any table size.

One scan puts every column into a rank summary, whose error bound is known, so each searched rank gets
a bracket that surely holds its value and about a hundredth of the rows. The next scan counts the rows
at and below the bracket's ends and its likeliest value, all exact, and keeps the rows in between: all of
them where they are few, and a summary of them where they are many, which gives a narrower bracket. A value
that fills a large part of a column is settled by its count. A small column is told by the first scan.

All columns and ranks share the scans. Summaries of tasks are merged in two steps, and nothing but
brackets and values at ranks comes to the driver. No row is shuffled but those between brackets.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import array_sql, batches, literal_sql, number_sql, numbered_frame
from tableprofile.operators.ranges import numbered
from tableprofile.operators.summaries import CHUNK, EXACT, KEPT, Bracket, RankSummary, Weighted, bracket, merged

QUARTILES = (0.25, 0.5, 0.75)
FENCE_FACTOR = 1.5

# Rows between brackets that are few enough to be kept as they are, per bracket.
INNER_LIMIT = 250_000
# Columns that share a scan, and tasks whose summaries meet in the first step of merging.
COLUMNS_PER_SCAN = 100
MERGED_TASKS = 64
APPROX_ACCURACY = 10_000

STATE = "key int, salt int, state binary"
STATE_ARROW = pa.schema([("key", pa.int32()), ("salt", pa.int32()), ("state", pa.binary())])


def column_values(batch: pa.RecordBatch) -> np.ndarray:
    """A row per column, NaN where a value is missing."""
    return np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], float).reshape(batch.num_columns, batch.num_rows)


def states(found: dict[int, object]) -> pa.RecordBatch:
    """What a task found, by key, for the tasks that merge."""
    salt = TaskContext.get().partitionId() // MERGED_TASKS
    return pa.RecordBatch.from_pylist(
        [{"key": k, "salt": salt, "state": pickle.dumps(s)} for k, s in found.items()], schema=STATE_ARROW
    )


def tree_merged(partial: DataFrame, merge, finish, schema: str) -> DataFrame:
    """The rows that ``finish(key, state)`` makes of all tasks' states of a key, merged in two steps."""

    def union(table: pa.Table):
        out = None
        for value in table.column("state"):
            state = pickle.loads(value.as_py())
            out = state if out is None else merge(out, state)
        return out

    def first(table: pa.Table) -> pa.Table:
        row = {"key": table["key"][0].as_py(), "salt": 0, "state": pickle.dumps(union(table))}
        return pa.Table.from_pylist([row], schema=STATE_ARROW)

    def last(table: pa.Table) -> pa.Table:
        return finish(table["key"][0].as_py(), union(table))

    return partial.groupBy("key", "salt").applyInArrow(first, STATE).groupBy("key").applyInArrow(last, schema)


#: Sizes of summaries: values kept, values of a chunk, values that are all kept.
Limits = tuple[int, int, int]


def _limits() -> Limits:
    return KEPT, CHUNK, EXACT


@dataclass
class _Search:
    """Ranks (from 0) of one column whose values lie above ``lo`` and not above ``hi``."""

    column: int
    lo: float | None = None
    mid: float | None = None
    hi: float | None = None
    few: bool = False
    ranks: list[int] = field(default_factory=list)

    def parts(self, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of sorted values at or below ``lo``, between, at ``mid``, between and at ``hi``, and what is between."""
        low = 0 if self.lo is None else np.searchsorted(ordered, self.lo, "right")
        high = (len(ordered),) * 2 if self.hi is None else tuple(np.searchsorted(ordered, self.hi, s) for s in ("left", "right"))
        mid = (high[0], high[0]) if self.mid is None else tuple(np.searchsorted(ordered, self.mid, s) for s in ("left", "right"))
        counts = np.array([low, mid[0] - low, mid[1] - mid[0], high[0] - mid[1], high[1] - high[0]])
        return counts, ordered[low : mid[0]], ordered[mid[1] : high[0]]


class SearchState:
    """What a task has seen of a search: counts, and summaries of the rows on both sides of ``mid``."""

    def __init__(self, few: bool, limits: Limits):
        self.counts = np.zeros(5, np.int64)
        self.few = few
        kept, chunk, exact = limits
        self._sides = [RankSummary(None if few else kept, chunk, exact) for _ in range(2)]

    def add(self, search: _Search, ordered: np.ndarray) -> None:
        counts, *sides = search.parts(ordered)
        self.counts += counts
        for summary, own in zip(self._sides, sides):
            summary.add(own)

    def result(self) -> SearchResult:
        return self.few, self.counts, [s.result() for s in self._sides]


#: Whether all rows between are kept, the counts, and the summaries of both sides.
SearchResult = tuple[bool, np.ndarray, list[Weighted]]


def _merging(limits: Limits):
    def merge(a: SearchResult, b: SearchResult) -> SearchResult:
        kept = None if a[0] else limits[0]
        return a[0], a[1] + b[1], [merged([x, y], kept, limits[2]) for x, y in zip(a[2], b[2])]

    return merge


def located(search: _Search, result: SearchResult, rank: int) -> Bracket:
    """The value at a rank of the column, or a narrower bracket."""
    _, counts, sides = result
    below = np.concatenate([[0], np.cumsum(counts)])
    place = int(np.searchsorted(below, rank, "right")) - 1
    if place in (2, 4):
        return Bracket(value=search.mid if place == 2 else search.hi)
    out = bracket(sides[place // 2], rank - int(below[place]))
    if out.value is None:
        ends = (search.lo, search.hi if search.mid is None else search.mid) if place == 1 else (search.mid, search.hi)
        out.lo = ends[0] if out.lo is None else out.lo
        out.hi = ends[1] if out.hi is None else out.hi
        out.mid = None if out.mid in (out.lo, out.hi) else out.mid
    return out


_FOUND = "key int, rank long, value double, lo double, mid double, hi double, rows double"
_FOUND_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}.get(t, pa.float64())) for n, t in (x.split(" ") for x in _FOUND.split(", "))])


def _looking(searches: Sequence[_Search]):
    """For a task: what it sees of the searches."""
    limits = _limits()

    def look(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [SearchState(s.few, limits) for s in searches]
        for batch in given:
            ordered = np.sort(column_values(batch), axis=1)
            n = (~np.isnan(ordered)).sum(axis=1)
            for search, state in zip(searches, own):
                state.add(search, ordered[search.column, : n[search.column]])
        yield states({i: s.result() for i, s in enumerate(own)})

    return look


def _pass(cols: DataFrame, searches: Sequence[_Search]) -> list[tuple[int, int, Bracket]]:
    """One scan: number of the search, rank and bracket of every searched rank."""

    def finish(key: int, result: SearchResult) -> pa.Table:
        rows = [{"key": key, "rank": r, **vars(located(searches[key], result, r))} for r in searches[key].ranks]
        return pa.Table.from_pylist(rows, schema=_FOUND_ARROW)

    found = tree_merged(cols.mapInArrow(_looking(searches), STATE), _merging(_limits()), finish, _FOUND).collect()
    return [(r["key"], r["rank"], Bracket(*r[2:])) for r in found]


def settled(cols: DataFrame, open_: dict[tuple[int, int], Bracket], inner_limit: int | None = None) -> dict[tuple[int, int], float]:
    """The values at (column, rank), from brackets; each further scan narrows those that are open."""
    inner_limit = INNER_LIMIT if inner_limit is None else inner_limit
    values: dict[tuple[int, int], float] = {}
    while True:
        searches: dict[tuple, _Search] = {}
        for (column, rank), b in open_.items():
            if b.value is not None:
                values[column, rank] = b.value
            else:
                key = (column, b.lo, b.mid, b.hi)
                searches.setdefault(key, _Search(*key, few=b.rows <= inner_limit)).ranks.append(rank)
        if not searches:
            return values
        found = list(searches.values())
        open_ = {(found[k].column, rank): b for k, rank, b in _pass(cols, found)}


def spots(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    """The two ranks between which each quantile of ``n`` values lies, and the weight of the upper one."""
    out = []
    for p in probs:
        at = p * (n - 1)
        out.append((math.floor(at), math.ceil(at), at - math.floor(at)))
    return out


def between(lo: float, hi: float, weight: float) -> float:
    # Equal ends also cover infinities, whose weighted sum may be undefined.
    return lo if lo == hi else lo * (1.0 - weight) + hi * weight


def narrowed_quantiles(
    df: DataFrame, names: Sequence[str], probs: Sequence[float], inner_limit: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles; columns are searched in batches, each reading its own columns only."""
    found = {}
    for batch in batches(names, COLUMNS_PER_SCAN):
        found.update(_narrowed(df, batch, probs, inner_limit))
    return found


def first_brackets(n: int, summary: Weighted, probs: Sequence[float]) -> dict[int, Bracket]:
    """Brackets of the ranks that the quantiles of a column lie between, by rank."""
    return {r: bracket(summary, r) for lo, hi, _ in (spots(n, probs) if n else []) for r in (lo, hi)}


def _narrowed(df: DataFrame, names: Sequence[str], probs: Sequence[float], inner_limit: int | None) -> dict[str, list[float | None]]:
    cols = numbered_frame(df, names)

    def finish(key: int, result: SearchResult) -> pa.Table:
        n = int(result[1].sum())
        rows = [{"key": key, "rank": r, **vars(b)} for r, b in first_brackets(n, result[2][0], probs).items()]
        return pa.Table.from_pylist([*rows, {"key": key, "rank": -1, "rows": float(n)}], schema=_FOUND_ARROW)

    whole = [_Search(i) for i in range(len(names))]
    first = tree_merged(cols.mapInArrow(_looking(whole), STATE), _merging(_limits()), finish, _FOUND).collect()
    n = {r["key"]: int(r["rows"]) for r in first if r["rank"] < 0}
    values = settled(cols, {(r["key"], r["rank"]): Bracket(*r[2:]) for r in first if r["rank"] >= 0}, inner_limit)
    return {name: interpolated(values, i, n.get(i, 0), probs) for i, name in enumerate(names)}


def interpolated(values: dict[tuple[int, int], float], column: int, n: int, probs: Sequence[float]) -> list[float | None]:
    if not n:
        return [None] * len(probs)
    return [between(values[column, lo], values[column, hi], w) for lo, hi, w in spots(n, probs)]


def grouped_medians(df: DataFrame) -> DataFrame:
    """``(__value, __median)``: exact median of the column ``x`` for every value of the column ``__value``.

    Equal values of a group are counted first, so ties are one row. The counts are put in order by
    ranges of (group, value), and running sums give each its ranks: a group of any size lies in as
    many ranges as it needs, and nothing about groups comes to the driver. Groups without a known
    value have a missing median.
    """
    # Negative zero equals zero, and sorts as it.
    counts = df.where("x IS NOT NULL").groupBy("__value", F.expr("x + 0D").alias("x")).agg(F.count("*").alias("n"))
    ranked = numbered(counts, ["x"], "n", within=["__value"])
    total = F.col("__total")
    middle = ((F.col("__before") <= F.floor((total - 1) / 2)) & (F.floor((total - 1) / 2) < F.col("__before") + F.col("n"))) | (
        (F.col("__before") <= F.floor(total / 2)) & (F.floor(total / 2) < F.col("__before") + F.col("n"))
    )
    ends = ranked.where(middle).groupBy("__value").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    medians = ends.selectExpr("__value AS __of", "if(lo = hi, lo, lo * 0.5D + hi * 0.5D) AS __median")
    groups = df.select("__value").distinct()
    return groups.join(medians, F.col("__value").eqNullSafe(F.col("__of")), "left").select("__value", "__median")


def quantile_row(
    df: DataFrame, names: Sequence[str], probs: Sequence[float] = QUARTILES, mode: str = "exact", facts=None
) -> DataFrame:
    """One row ``(q)``: per column an array of its quantiles.

    ``mode="exact"`` interpolates linearly; ``mode="approx"`` uses a mergeable sketch and returns
    values that occur in the column. With ``facts`` the first scan is not repeated.
    """
    if mode not in ("exact", "approx"):
        raise ValueError("mode must be 'exact' or 'approx'")
    if mode == "approx":
        values = [number_sql(df, n) for n in names]
        points = array_sql(f"{float(p)!r}D" for p in probs)
        return df.selectExpr(
            array_sql(f"percentile_approx({v}, {points}, {APPROX_ACCURACY})" for v in values) + " AS q"
        )
    found = narrowed_quantiles(df, names, probs) if facts is None else facts.quantiles(names, probs)
    cells = [array_sql("CAST(NULL AS DOUBLE)" if v is None else literal_sql(v) for v in found[n]) for n in names]
    return df.sparkSession.sql(f"SELECT {array_sql(cells)} AS q")


def fence_row(df: DataFrame, names: Sequence[str], mode: str = "exact", facts=None) -> DataFrame:
    """One row ``(f)``: per column a struct of its quartiles, interquartile range and fences."""
    iqr = "(q[2] - q[0])"
    fields = {
        "q1": "q[0]",
        "median": "q[1]",
        "q3": "q[2]",
        "iqr": iqr,
        "lower": f"q[0] - {FENCE_FACTOR}D * {iqr}",
        "upper": f"q[2] + {FENCE_FACTOR}D * {iqr}",
    }
    struct = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return quantile_row(df, names, QUARTILES, mode, facts).selectExpr(
        f"transform(q, q -> named_struct({struct})) AS f"
    )
