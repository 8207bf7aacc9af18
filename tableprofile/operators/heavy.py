"""Frequent values of many columns from one scan, by Misra-Gries summaries of hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableprofile.functions.columns import batches, known_sql
from tableprofile.operators.quantiles import STATE, states, tree_merged

#: Hashes a summary keeps, candidates of a column that are recounted, columns that share a scan.
CAPACITY = 4096
MAX_CANDIDATES = 64
COLUMNS_PER_SCAN = 100


@dataclass
class FrequentHashes:
    """Hashes with counts that are too small by ``err`` at most; any other hash has ``err`` rows at most."""

    hashes: np.ndarray
    counts: np.ndarray
    err: int = 0

    @staticmethod
    def empty() -> FrequentHashes:
        return FrequentHashes(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def merge(self, other: FrequentHashes, capacity: int) -> FrequentHashes:
        """Counts add up; beyond the capacity the largest count that does not fit is taken off all."""
        hashes, place = np.unique(np.concatenate([self.hashes, other.hashes]), return_inverse=True)
        counts = np.zeros(len(hashes), np.int64)
        np.add.at(counts, place, np.concatenate([self.counts, other.counts]))
        err = self.err + other.err
        if len(hashes) > capacity:
            off = int(np.partition(counts, -capacity - 1)[-capacity - 1])
            left = counts > off
            hashes, counts, err = hashes[left], counts[left] - off, err + off
        return FrequentHashes(hashes, counts, err)

    def top(self, k: int) -> list[int] | None:
        """Hashes among which those of the ``k`` most frequent values surely are; None if that cannot be told."""
        if self.err and (len(self.counts) < k or np.partition(self.counts, -k)[-k] <= self.err):
            return None
        least = np.partition(self.counts, -k)[-k] if len(self.counts) >= k else 0
        found = self.hashes[self.counts + self.err >= least]
        return found.tolist() if len(found) <= MAX_CANDIDATES else None


def hash_sql(df: DataFrame, name: str) -> str:
    """SQL: 64 bits of a known value; missing for a missing one."""
    value = known_sql(df, name)
    return f"CASE WHEN {value} IS NOT NULL THEN xxhash64({value}) END"


def candidates(df: DataFrame, names: Sequence[str], k: int, capacity: int | None = None) -> dict[str, list[int] | None]:
    """Per column the hashes that may be of its ``k`` most frequent values; None where values are too evenly spread.

    One scan for a batch of columns. Only hashes leave the scan, and a task sends at most
    ``capacity`` of a column.
    """
    capacity = capacity or CAPACITY
    found: dict[str, list[int] | None] = {}
    for part in batches(names, COLUMNS_PER_SCAN):
        hashes = df.selectExpr(*[f"{hash_sql(df, n)} AS h{i}" for i, n in enumerate(part)])

        def gather(given: Iterator[pa.RecordBatch], n: int = len(part)) -> Iterator[pa.RecordBatch]:
            own = [FrequentHashes.empty() for _ in range(n)]
            for batch in given:
                for i, column in enumerate(batch.columns):
                    values, counts = np.unique(column.drop_null().to_numpy(), return_counts=True)
                    own[i] = own[i].merge(FrequentHashes(values, counts), capacity)
            yield states(dict(enumerate(own)))

        def finish(key: int, state: FrequentHashes) -> pa.Table:
            top = state.top(k)
            return pa.table({"key": pa.array([key], pa.int32()), "top": pa.array([top], pa.list_(pa.int64()))})

        merged = tree_merged(hashes.mapInArrow(gather, STATE), lambda a, b: a.merge(b, capacity), finish, "key int, top array<long>")
        rows = {r["key"]: r["top"] for r in merged.collect()}
        found |= {n: rows.get(i, []) for i, n in enumerate(part)}
    return found
