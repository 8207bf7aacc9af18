"""Correlations between number columns and the line through the strongest pair."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprofile.functions.columns import (
    columns_of,
    literal_rows,
    numbered_frame,
    numeric_frame,
    ref,
    require_columns,
)
from tableprofile.operators.facts import Facts
from tableprofile.operators.quantiles import STATE, column_values, states, tree_merged
from tableprofile.operators.roles import split_roles
from tableprofile.operators.summaries import PairMoments, Shifted

#: Columns of a tile of the correlation matrix.
TILE = 128

MATRIX_DDL = "pos_x int, pos_y int, col_x string, col_y string, r double"

# Fixed values of the five rankings: columns, pair orientation, bound on |r|, order, limit.
RANKINGS = {
    "profile": dict(columns="numerical", earlier_first=True, above=None, order="abs", limit=10),
    "context": dict(columns="number", earlier_first=False, above=0.5, order="abs", limit=5),
    "insight": dict(columns="number", earlier_first=False, above=0.7, order="matrix", limit=None),
    "heatmap": dict(columns="number", earlier_first=None, above=None, order="signed", limit=5),
    "table": dict(columns="number", earlier_first=False, above=None, order="abs", limit=10),
}


def _bounded(r: Column) -> Column:
    """r within [-1, 1]; NULL and NaN are a missing correlation."""
    return F.when(
        r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    )


def pair_correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r over rows where both are known, NULL when either is constant.

    Spark's ``corr`` fails on a constant column in ANSI mode; dividing with ``try_divide`` does not.
    """
    sx = F.stddev_samp(F.when(y.isNotNull(), x))
    sy = F.stddev_samp(F.when(x.isNotNull(), y))
    return _bounded(F.try_divide(F.try_divide(F.covar_samp(x, y), sx), sy))


def column_tiles(k: int) -> list[tuple[slice, slice]]:
    """Blocks of columns against blocks of columns, each two blocks once."""
    blocks = [slice(a, min(a + TILE, k)) for a in range(0, k, TILE)]
    return [(x, y) for i, x in enumerate(blocks) for y in blocks[i:]]


def _tile_states(tiles: list[tuple[slice, slice]]):
    """For a task: the co-moments of every tile of columns."""

    def gather(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, PairMoments] = {}
        for batch in given:
            own = Shifted(column_values(batch))
            for t, (x, y) in enumerate(tiles):
                cells = PairMoments.of(own, own, x, y)
                total[t] = total[t].merge(cells) if t in total else cells
        for t, cells in total.items():
            yield states({t: cells})

    return gather


def pair_tiles(df: DataFrame, names: Sequence[str]) -> list[tuple[int, PairMoments]]:
    """The co-moments of every tile of ``column_tiles``: six numbers per pair of columns come to the driver."""

    def finish(t: int, cells: PairMoments) -> pa.Table:
        return pa.table({"key": pa.array([t], pa.int32()), "cells": pa.array([pickle.dumps(cells)], pa.binary())})

    partial = numbered_frame(df, names).mapInArrow(_tile_states(column_tiles(len(names))), STATE)
    found = tree_merged(partial, PairMoments.merge, finish, "key int, cells binary")
    return [(r["key"], pickle.loads(r["cells"])) for r in found.toLocalIterator()]


def _triangle(df: DataFrame, names: Sequence[str], facts: Facts | None = None) -> DataFrame:
    """``(pos_x, pos_y, col_x, col_y, r)`` for every pair with x not after y, in one Arrow scan.
    Positions are places in ``names``.

    Tasks keep the co-moments of tiles of columns, which merge in two steps tile by tile, so that no
    task ever sorts or sends single pairs; a tile's pairs are made where its last parts meet.
    """
    k = len(names)
    if not k:
        return literal_rows(df.sparkSession, [], MATRIX_DDL)
    if facts and facts.pairs is not None:
        at = [facts.numbers.index(n) for n in names]
        r = facts.pairs.correlation()[np.ix_(at, at)]
        rows = [(i, j, names[i], names[j], _cell(r, i, j)) for i in range(k) for j in range(i, k)]
        return literal_rows(df.sparkSession, rows, MATRIX_DDL)
    tiles = column_tiles(k)

    def finish(t: int, cells: PairMoments) -> pa.Table:
        x, y = tiles[t]
        r = cells.correlation()
        i, j = np.nonzero(np.arange(x.start, x.stop)[:, None] <= np.arange(y.start, y.stop)[None, :])
        values = np.where((i + x.start == j + y.start) & ~np.isnan(r[i, j]), 1.0, r[i, j])
        i, j = i + x.start, j + y.start
        return pa.table(
            {
                "pos_x": pa.array(i, pa.int32()),
                "pos_y": pa.array(j, pa.int32()),
                "col_x": pa.array([names[a] for a in i], pa.string()),
                "col_y": pa.array([names[b] for b in j], pa.string()),
                "r": pa.array(values, pa.float64(), mask=np.isnan(values)),
            }
        )

    return tree_merged(
        numbered_frame(df, names).mapInArrow(_tile_states(tiles), STATE), PairMoments.merge, finish, MATRIX_DDL
    )


def _cell(r: np.ndarray, i: int, j: int) -> float | None:
    if np.isnan(r[i, j]):
        return None
    return 1.0 if i == j else float(r[i, j])


def pair_table(df: DataFrame, names: Sequence[str], facts: Facts | None = None) -> DataFrame:
    """``(pos_x, pos_y, col_x, col_y, r)`` for every pair, the earlier column as x."""
    return _triangle(df, names, facts).where("pos_x < pos_y")


_SWAPPED = ("pos_y AS pos_x", "pos_x AS pos_y", "col_y AS col_x", "col_x AS col_y", "r")


def _swapped(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr(*_SWAPPED)


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Both orientations of every pair, and the diagonal once, from one pass over the table."""
    there = "struct(pos_x, pos_y, col_x, col_y, r)"
    back = f"struct({', '.join(_SWAPPED)})"
    return pairs.selectExpr(f"inline(if(pos_x = pos_y, array({there}), array({there}, {back})))")


def _numbers(df: DataFrame, names: Sequence[str] | None) -> list[str]:
    return columns_of(df, "number") if names is None else require_columns(df, names, "number")


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(pos_x, pos_y, col_x, col_y, r)``: the full square matrix in long form. A constant column
    has no correlation, not even with itself."""
    return _mirrored(_triangle(df, _numbers(df, names)))


def correlation_heatmap(
    df: DataFrame, names: Sequence[str] | None = None, lower_only: bool = False
) -> DataFrame:
    """The matrix for a heatmap; ``lower_only`` keeps the part below the diagonal."""
    if lower_only:
        return _swapped(pair_table(df, _numbers(df, names)))
    return correlation_matrix(df, names)


def top_correlations(
    df: DataFrame,
    variant: str = "profile",
    names: Sequence[str] | None = None,
    roles: tuple[list[str], list[str]] | None = None,
    facts: Facts | None = None,
) -> DataFrame:
    """``(rank, col_x, col_y, r)``; the variants are listed in ``RANKINGS``.

    ``profile``: numerical columns by role, strongest ten; ``context``: |r| > 0.5, strongest five;
    ``insight``: |r| > 0.7, all, in matrix order; ``heatmap``: chosen columns, both orientations,
    highest five by sign; ``table``: strongest ten, pairs without a correlation last.
    """
    if variant not in RANKINGS:
        raise ValueError(f"variant must be one of {tuple(RANKINGS)}")
    rule = RANKINGS[variant]
    if names is None and rule["columns"] == "numerical":
        names = (roles or split_roles(df, facts))[1]
    pairs = pair_table(df, _numbers(df, names), facts)
    if rule["earlier_first"] is None:
        pairs = _mirrored(pairs)
    elif not rule["earlier_first"]:
        pairs = _swapped(pairs)
    if variant != "table":
        pairs = pairs.where("r IS NOT NULL")
    if rule["above"] is not None:
        pairs = pairs.where(F.abs("r") > rule["above"])
    # Correlations that agree to twelve digits are ties, which the column order settles.
    key = {
        "abs": "coalesce(-round(abs(r), 12), 2D)",
        "signed": "-round(r, 12)",
        "matrix": "0D",
    }[rule["order"]]
    keyed = pairs.withColumn("key", F.expr(key))
    if rule["limit"] is None:
        # All strong pairs of columns: their number does not depend on the rows.
        place = F.row_number().over(Window.orderBy("key", "pos_x", "pos_y"))
        return keyed.select(place.alias("rank"), "col_x", "col_y", "r")
    # Each task keeps the best few.
    best = keyed.orderBy("key", "pos_x", "pos_y").limit(rule["limit"])
    return (
        best.selectExpr("array_sort(collect_list(struct(key, pos_x, pos_y, col_x, col_y, r))) AS pairs")
        .selectExpr("posexplode(pairs) AS (pos, p)")
        .selectExpr("pos + 1 AS rank", "p.col_x", "p.col_y", "p.r")
    )


def most_correlated_pair(
    df: DataFrame, roles: tuple[list[str], list[str]] | None = None
) -> DataFrame:
    """``(col_x, col_y, r)``: the pair of numerical columns with the largest |r|, the later column
    as x; empty when no pair has a correlation. Ties go to the first in matrix order."""
    names = (roles or split_roles(df))[1]
    pairs = _swapped(pair_table(df, names)).where("r IS NOT NULL")
    return (
        pairs.selectExpr("min_by(struct(col_x, col_y, r), struct(-round(abs(r), 12), pos_x, pos_y)) AS best")
        .where("best IS NOT NULL")
        .select("best.*")
    )


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(col_x, col_y, n, slope, intercept, r)`` of the least-squares line over complete rows."""
    cols = numeric_frame(df, require_columns(df, dict.fromkeys([x, y]), "number"))
    return cols.agg(
        F.lit(x).alias("col_x"),
        F.lit(y).alias("col_y"),
        F.regr_count(ref(y), ref(x)).alias("n"),
        F.regr_slope(ref(y), ref(x)).alias("slope"),
        F.regr_intercept(ref(y), ref(x)).alias("intercept"),
        pair_correlation(ref(x), ref(y)).alias("r"),
    )
