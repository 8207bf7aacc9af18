"""Which number and category columns to keep: components, scores and correlated pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import known, numeric, numeric_frame, ref, require_columns
from tableprofile.operators.relations import column_tiles, pair_table, pair_tiles

CORRELATED = 0.7


@dataclass
class Components:
    """Components of the columns ``names``: their means, and per component variance, share and loadings."""

    names: list[str]
    means: np.ndarray
    variances: np.ndarray
    shares: np.ndarray
    loadings: np.ndarray


def fit_components(df: DataFrame, names: Sequence[str], k: int) -> Components:
    """The ``k`` first components over rows without a missing value, columns as they are.

    Covariances come from one scan: tasks keep tiles of co-moments, which merge tile by tile. The
    matrix of the columns reaches the driver, never rows. The largest loading of a component is positive.
    """
    names = require_columns(df, names, "number")
    size, tiles = len(names), column_tiles(len(names))
    matrix, means = np.zeros((size, size)), np.zeros(size)
    for t, cells in pair_tiles(numeric_frame(df, names).na.drop(), names):
        x, y = tiles[t]
        with np.errstate(all="ignore"):
            covariance = np.nan_to_num(cells.mxy / (cells.n - 1))
        matrix[x, y], matrix[y, x] = covariance, covariance.T
        means[x], means[y] = cells.mean_x[:, 0], cells.mean_y[0]
    variance, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-variance, kind="stable")[:k]
    total = float(np.trace(matrix))
    loadings = vectors[:, order].T
    loadings = loadings * np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])[:, None]
    shares = variance[order] / total if total else np.full(len(order), np.nan)
    return Components(names, means, variance[order], shares, loadings)


def principal_components(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """``component`` (from 1), ``variance``, ``share`` and ``loadings``, in the order of ``names``; see ``fit_components``."""
    found = fit_components(df, names, k)
    rows = [
        (i + 1, float(v), None if np.isnan(s) else float(s), loading.tolist())
        for i, (v, s, loading) in enumerate(zip(found.variances, found.shares, found.loadings))
    ]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, share double, loadings array<double>")


def component_scores(df: DataFrame, components: Components, prefix: str = "component_") -> DataFrame:
    """All columns and ``<prefix>1`` and on: the rows' places on the components, missing where a column is.

    ``df`` may be another table than the components were fitted on. One matrix product per Arrow batch
    of the fitted columns would move all others through Python, so each score is one fold over the
    row's values in generated code, against an array of loadings.
    """
    require_columns(df, components.names, "number")
    values = F.array(*[numeric(df, n) for n in components.names])
    centre = F.lit([float(m) for m in components.means])
    off = F.zip_with(values, centre, lambda v, m: v - m)
    scores = [
        F.aggregate(
            F.zip_with(F.col("__off"), F.lit([float(x) for x in loading]), lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x
        ).alias(f"{prefix}{i + 1}")
        for i, loading in enumerate(components.loadings)
    ]
    return df.withColumn("__off", off).select(*map(ref, df.columns), *scores)


def feature_scores(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """``column``, ``information`` (mutual information with the target, in nats) and ``chi_square``.

    Columns and target are categories; rows in which either is missing do not count for a column.
    """
    require_columns(df, [*names, target])
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), known(df, n).cast("string").alias("value")) for n in names]
    )
    long = df.select(known(df, target).cast("string").alias("target"), F.explode(cells).alias("c"))
    joint = long.select("c.column", "c.value", "target").where("value IS NOT NULL AND target IS NOT NULL")
    joint = joint.groupBy("column", "value", "target").agg(F.count("*").alias("n"))
    of_value = joint.groupBy("column", "value").agg(F.sum("n").alias("n_value"))
    of_target = joint.groupBy("column", "target").agg(F.sum("n").alias("n_target"))
    total = of_value.groupBy("column").agg(F.sum("n_value").alias("total"))
    rows = joint.join(of_value, ["column", "value"]).join(of_target, ["column", "target"]).join(total, "column")
    n, expected = F.col("n").cast("double"), F.col("n_value") * F.col("n_target") / F.col("total")
    # Cells without rows add their expected number: all expectations add up to the total.
    return rows.groupBy("column").agg(
        F.sum(n / F.col("total") * F.log(n / expected)).alias("information"),
        (F.sum((n - expected) * (n - expected) / expected) + F.first("total") - F.sum(expected)).alias("chi_square"),
    )


def drop_correlated(df: DataFrame, names: Sequence[str], limit: float = CORRELATED) -> DataFrame:
    """All columns but those of ``names`` that correlate beyond ``limit`` with an earlier one that stays."""
    names = require_columns(df, names, "number")
    strong = pair_table(df, names).where(F.abs("r") > limit).select("col_x", "col_y").collect()
    linked = {(r[0], r[1]) for r in strong} | {(r[1], r[0]) for r in strong}
    kept: list[str] = []
    for n in names:
        if not any((n, other) in linked for other in kept):
            kept.append(n)
    return df.select(*[ref(c) for c in df.columns if c not in names or c in kept])
