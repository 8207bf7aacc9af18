"""Facts about all columns of a table, gathered once and used by every part of a profile.

Number columns take one Arrow scan: each task builds for every column its counts, ends, central
moments, first different values and a rank summary, and for every two columns their co-moments. These
states merge in any order, and are merged in two steps. The other columns take one scan of plain
aggregates. A columnar source so reads each column once. Quartiles follow from the summaries by reading
the rows in their brackets, and outliers by counting beyond the fences, each once for all columns.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableprofile.functions.columns import (
    batches,
    columns_of,
    family_of,
    known_sql,
    literal_sql,
    missing_sql,
    numbered_frame,
    numeric_frame,
    quoted,
)
from tableprofile.operators.quantiles import (
    FENCE_FACTOR,
    QUARTILES,
    STATE,
    column_values,
    first_brackets,
    interpolated,
    narrowed_quantiles,
    settled,
    states,
    tree_merged,
)
from tableprofile.operators.shapes import date_shaped_sql, parsed_as_dates, prose_sql
from tableprofile.operators.summaries import EXACT, KEPT, Bracket, Moments, PairMoments, RankSummary, Shifted, merged

#: Number columns up to which pairs are part of the facts; of more, correlations take a scan of their own.
PAIRED_COLUMNS = 64
#: Columns that share a scan.
COLUMNS_PER_SCAN = 100
#: Central moments below this are rounding noise of the sum and count as zero.
MOMENT_NOISE = 1e-14

_PAIRS = -1


@dataclass
class NumberFacts:
    """Facts of one number column. ``few`` has its different values if they are few, else None."""

    rows: int
    count: int
    mean: float | None
    m2: float | None
    m3: float | None
    low: float | None
    high: float | None
    few: list[float] | None
    brackets: dict[int, Bracket]

    @property
    def std(self) -> float | None:
        return math.sqrt(self.m2 / (self.count - 1)) if self.count > 1 else None

    @property
    def skewness(self) -> float | None:
        """Bias-corrected; None below three values, 0 for a constant column."""
        n = self.count
        if n < 3:
            return None
        if self.m2 < MOMENT_NOISE:
            return 0.0
        g = math.sqrt(n) * self.m3 / self.m2**1.5
        return g * math.sqrt(n * (n - 1.0)) / (n - 2.0)


@dataclass
class OtherFacts:
    """Facts of a column that is not a number; the last three of text columns only."""

    missing: int
    estimate: int | None = None
    all_dates: bool | None = None
    prose: bool | None = None


class Facts:
    """The facts of ``df``. Each kind is gathered when it is first asked for, and then kept.

    Without ``ranks`` quartiles take a scan more, without ``paired`` there are no co-moments.
    """

    def __init__(self, df: DataFrame, ranks: bool = True, paired: bool = True):
        self.df = df
        self.numbers = columns_of(df, "number")
        self.ranks = ranks
        self.paired = paired and 1 < len(self.numbers) <= PAIRED_COLUMNS

    @cached_property
    def _gathered(self) -> tuple[dict[str, NumberFacts], PairMoments | None]:
        return number_facts(self.df, self.numbers, self.ranks, self.paired)

    @property
    def number(self) -> dict[str, NumberFacts]:
        return self._gathered[0]

    @property
    def pairs(self) -> PairMoments | None:
        """Co-moments of all number columns, None beyond ``PAIRED_COLUMNS``."""
        return self._gathered[1]

    @cached_property
    def _others(self) -> tuple[int, dict[str, OtherFacts]]:
        return other_facts(self.df)

    @property
    def other(self) -> dict[str, OtherFacts]:
        return self._others[1]

    @property
    def n_rows(self) -> int:
        return self.number[self.numbers[0]].rows if self.numbers else self._others[0]

    def missing(self, name: str) -> int:
        found = self.number.get(name) if name in self.numbers else None
        return found.rows - found.count if found else self.other[name].missing

    @cached_property
    def _values(self) -> dict[str, list[float | None]]:
        if not self.ranks:
            return narrowed_quantiles(self.df, self.numbers, QUARTILES)
        open_ = {(i, r): b for i, n in enumerate(self.numbers) for r, b in self.number[n].brackets.items()}
        values = {}
        for part in batches(self.numbers, COLUMNS_PER_SCAN):
            at = {self.numbers.index(n): i for i, n in enumerate(part)}
            own = {(at[c], r): b for (c, r), b in open_.items() if c in at}
            found = settled(numbered_frame(self.df, part), own)
            values |= {n: interpolated(found, i, self.number[n].count, QUARTILES) for i, n in enumerate(part)}
        return values

    def quantiles(self, names: Sequence[str], probs: Sequence[float] = QUARTILES) -> dict[str, list[float | None]]:
        """Exact quantiles; quartiles need no first scan."""
        if tuple(probs) != QUARTILES:
            return narrowed_quantiles(self.df, names, probs)
        return {n: self._values[n] for n in names}

    @cached_property
    def _outliers(self) -> dict[str, int]:
        found = {}
        for part in batches(self.numbers, COLUMNS_PER_SCAN):
            cols = numeric_frame(self.df, part)
            counts = []
            for n in part:
                q1, _, q3 = self._values[n]
                if q1 is None:
                    counts.append("count_if(false)")
                else:
                    reach = FENCE_FACTOR * (q3 - q1)
                    lower, upper = literal_sql(q1 - reach), literal_sql(q3 + reach)
                    counts.append(f"count_if({quoted(n)} < {lower} OR {quoted(n)} > {upper})")
            found |= dict(zip(part, cols.selectExpr(*counts).first()))
        return found

    def outliers(self, names: Sequence[str]) -> dict[str, int]:
        """Number of values outside the fences; one scan for all columns."""
        return {n: self._outliers[n] for n in names}


def _number_states(k: int, ranked: bool, paired: bool):
    """For a task: the facts of its rows by column, and of the pairs."""

    def gather(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = [RankSummary() for _ in range(k)]
        moments, pairs = Moments(k), None
        for batch in given:
            values = column_values(batch)
            ordered = np.sort(values, axis=1)
            part = Moments.of(values, ordered)
            moments = moments.merge(part)
            if ranked:
                for summary, own, n in zip(ranks, ordered, part.n.astype(int)):
                    summary.add(own[:n])
            if paired:
                shifted = Shifted(values)
                cells = PairMoments.of(shifted, shifted, slice(None), slice(None))
                pairs = cells if pairs is None else pairs.merge(cells)
        found = {i: (moments.column(i), summary.result()) for i, summary in enumerate(ranks)}
        yield states(found if pairs is None else found | {_PAIRS: pairs})

    return gather


def _merge(a, b):
    if isinstance(a, PairMoments):
        return a.merge(b)
    return a[0].merge(b[0]), merged([a[1], b[1]], KEPT, EXACT)


def _finishing(ranked: bool):
    def finish(key: int, state) -> pa.Table:
        found = state
        if not isinstance(state, PairMoments):
            m, summary = state
            n = int(m.n[0])
            # The plain sum is exact for whole numbers.
            mean = m.total / n if n and m.low[0] < m.high[0] else m.mean
            facts = [float(x[0]) if n else None for x in (mean, m.m2, m.m3, m.low, m.high)]
            few = None if m.few[0] is None else m.few[0].tolist()
            found = NumberFacts(m.rows, n, *facts, few, first_brackets(n, summary, QUARTILES) if ranked else {})
        return pa.table({"key": pa.array([key], pa.int32()), "found": pa.array([pickle.dumps(found)], pa.binary())})

    return finish


def number_facts(
    df: DataFrame, names: Sequence[str], ranked: bool = True, paired: bool = False
) -> tuple[dict[str, NumberFacts], PairMoments | None]:
    """Facts of number columns, and of their pairs where asked for. A row per column comes to the driver."""
    found: dict[str, NumberFacts] = {}
    pairs = None
    for part in batches(names, COLUMNS_PER_SCAN):
        gathered = numbered_frame(df, part).mapInArrow(_number_states(len(part), ranked, paired), STATE)
        for row in tree_merged(gathered, _merge, _finishing(ranked), "key int, found binary").collect():
            if row["key"] == _PAIRS:
                pairs = pickle.loads(row["found"])
            else:
                found[part[row["key"]]] = pickle.loads(row["found"])
    empty = NumberFacts(0, 0, None, None, None, None, None, [], {})  # a table without partitions has no tasks
    return {n: found.get(n, empty) for n in names}, pairs


def other_facts(df: DataFrame) -> tuple[int, dict[str, OtherFacts]]:
    """Number of rows, and facts of the columns that are not numbers, from one scan of them.

    Text columns whose values all look like dates are parsed in a further scan.
    """
    names = [f.name for f in df.schema.fields if family_of(f.dataType) != "number"]
    if not names:
        return df.count(), {}
    found: dict[str, OtherFacts] = {}
    for part in batches(names, COLUMNS_PER_SCAN):
        texts = [n for n in part if family_of(df.schema[n].dataType) == "object"]
        tests = ["count(1)", *[f"count_if({missing_sql(df, n)})" for n in part]]
        for n in texts:
            tests += [f"approx_count_distinct({known_sql(df, n)})", prose_sql(n), date_shaped_sql(n)]
        n_rows, *row = df.selectExpr(*tests).first()
        found |= {n: OtherFacts(m) for n, m in zip(part, row)}
        for i, n in enumerate(texts):
            estimate, prose, shaped = row[len(part) + 3 * i : len(part) + 3 * i + 3]
            found[n].estimate, found[n].prose, found[n].all_dates = estimate, bool(prose), shaped
    shaped = [n for n in names if found[n].all_dates]
    for n, ok in zip(shaped, parsed_as_dates(df, shaped)):
        found[n].all_dates = ok
    return n_rows, found
