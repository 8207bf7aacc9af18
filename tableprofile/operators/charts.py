"""The numbers behind the charts: histograms, densities, box plots, point sets, missing maps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprofile.functions.columns import (
    array_sql,
    batches,
    columns_of,
    family_of,
    known,
    literal_rows,
    missing_sql,
    numeric,
    ref,
    require_columns,
    text,
    union_rows,
    with_row,
)
from tableprofile.operators.frequency import category_counts
from tableprofile.operators.missing import missing_values
from tableprofile.operators.quantiles import QUARTILES, fence_row, quantile_row
from tableprofile.operators.relations import (
    correlation_heatmap,
    most_correlated_pair,
    regression_line,
)
from tableprofile.operators.roles import split_roles

HISTOGRAM_COLUMNS = 3
MATRIX_COLUMNS = 4
BUNDLE_COLUMNS = 5
DEFAULT_BINS = 30
BIN_RANGE = (5, 100)
# Columns of the missing map that share a scan.
COLUMNS_PER_SCAN = 100
# Empty bins that one task lists at once.
BINS_PER_TASK = 65_536

KDE_POINTS = 200
KDE_CUT = 3.0
# Beyond this many bandwidths a Gaussian is below 1e-17 of its peak.
KDE_REACH = 9.0
# Values whose kernels a task adds at once.
KDE_VALUES = 512


def _binned(df: DataFrame, name: str, params: DataFrame) -> DataFrame:
    """Counts per equal-width bin. ``params`` is one row with ``lo``, ``hi`` and ``bins``.

    A value belongs to the bin whose printed edges enclose it; the last bin includes its upper
    edge. Counting happens before the shuffle, so a task sends at most one row per bin.
    """
    p = params.selectExpr("struct(lo, hi, bins, (hi - lo) / bins AS width) AS p")
    values = with_row(df.select(numeric(df, name).alias("v")).where("v IS NOT NULL"), p, "p")
    nudge = (
        "i + CASE WHEN v >= p.lo + (i + 1) * p.width THEN 1 WHEN v < p.lo + i * p.width THEN -1"
        " ELSE 0 END"
    )
    counts = (
        values.selectExpr("v", "p", "floor((v - p.lo) / p.width) AS i")
        .selectExpr(f"greatest(0L, least(p.bins - 1, {nudge})) AS i")
        .groupBy("i")
        .agg(F.expr("count(1) AS n"))
    )
    # The empty bins, listed by as many tasks as their number asks for.
    starts = p.selectExpr("p.bins AS bins", f"explode(sequence(0L, p.bins - 1, {BINS_PER_TASK}L)) AS first")
    empty = starts.repartition("first").selectExpr(
        f"explode(sequence(first, least(first + {BINS_PER_TASK - 1}L, bins - 1))) AS i", "0L AS n"
    )
    bins = counts.unionByName(empty).groupBy("i").agg(F.expr("sum(n) AS n"))
    return (
        with_row(bins, p, "p")
        .selectExpr(
            "i + 1 AS bin",
            "p.lo + i * p.width AS lo",
            "if(i = p.bins - 1, p.hi, p.lo + (i + 1) * p.width) AS hi",
            "n",
        )
        .orderBy("bin")
    )


def _widened(stats: DataFrame) -> DataFrame:
    """A constant column gets half a unit on both sides, so its single bin has a width."""
    flat = F.col("lo") == F.col("hi")
    return stats.withColumns(
        {
            "lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
            "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")),
        }
    )


def histogram(df: DataFrame, name: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """``(bin, lo, hi, n)``: ``bins`` equal-width bins from the minimum to the maximum."""
    require_columns(df, [name], "number")
    if not BIN_RANGE[0] <= bins <= BIN_RANGE[1]:
        raise ValueError(f"bins must lie in {BIN_RANGE}")
    value = numeric(df, name)
    stats = df.agg(
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.when(F.count(value) > 0, F.lit(bins).cast("bigint")).alias("bins"),
    )
    return _binned(df, name, _widened(stats))


def histograms(
    df: DataFrame, names: Sequence[str] | None = None, bins: int = DEFAULT_BINS
) -> DataFrame:
    """``(column, bin, lo, hi, n)`` of the chosen columns, by default the first three numbers."""
    names = columns_of(df, "number")[:HISTOGRAM_COLUMNS] if names is None else names
    parts = [histogram(df, n, bins).withColumn("column", F.lit(n)) for n in names]
    if not parts:
        return literal_rows(
            df.sparkSession, [], "bin bigint, lo double, hi double, n bigint, column string"
        )
    return union_rows(parts)


def histogram_auto(df: DataFrame, name: str, mode: str = "exact") -> DataFrame:
    """``(bin, lo, hi, n)`` with the bin width chosen from the data: the smaller of the
    Freedman-Diaconis width ``2 iqr n^(-1/3)`` and the Sturges width ``range / (log2 n + 1)``."""
    require_columns(df, [name], "number")
    value = numeric(df, name)
    stats = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    by_iqr = "2D * (q[0][2] - q[0][0]) / cbrt(n)"
    by_count = "(hi - lo) / (log2(n) + 1D)"
    bins = (
        with_row(stats, quantile_row(df, [name], QUARTILES, mode), "q")
        .selectExpr("*", f"CASE WHEN n > 0 THEN {by_iqr} END AS a", f"CASE WHEN n > 0 THEN {by_count} END AS b")
        .selectExpr("*", "if(a > 0, least(a, b), b) AS width")
        .selectExpr("lo", "hi", "CASE WHEN n > 0 THEN if(width > 0, ceil((hi - lo) / width), 1L) END AS bins")
    )
    return _binned(df, name, _widened(bins))


def _kernel_sums(grid: int):
    """For a task: the sum of its values' kernels at every grid point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grid)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.sort(batch.column("v").to_numpy())
            start, step, h = (batch.column(c)[0].as_py() for c in ("start", "step", "h"))
            for k in range(0, len(v), KDE_VALUES):
                part = v[k : k + KDE_VALUES]
                # Sorted values lie close together, so few points are within reach of any of them.
                first = max(0, math.ceil((part[0] - start - KDE_REACH * h) / step))
                last = min(grid - 1, math.floor((part[-1] - start + KDE_REACH * h) / step))
                if first <= last:
                    x = start + np.arange(first, last + 1) * step
                    u = (x[:, None] - part[None, :]) / h
                    total[first : last + 1] += np.exp(-0.5 * u * u).sum(axis=1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "w"])

    return run


def kde(df: DataFrame, name: str, grid: int = KDE_POINTS, cut: float = KDE_CUT) -> DataFrame:
    """``(point, x, density, inside)``: Gaussian kernel density with bandwidth ``std n^(-1/5)``.

    The grid runs ``cut`` bandwidths past both ends of the data; ``inside`` marks points between
    minimum and maximum. A task sums the kernels of its values at every grid point in numpy and sends
    one row per point. Sorted values touch only the points within nine bandwidths, where all of their
    weight lies. Empty for columns without spread.
    """
    require_columns(df, [name], "number")
    value = numeric(df, name)
    stats = df.agg(
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.count(value).cast("double").alias("n"),
        F.stddev_samp(value).alias("s"),
    )
    p = stats.selectExpr("*", "s * pow(n, -0.2D) AS h").selectExpr(
        f"struct(lo, hi, n, h, lo - {cut}D * h AS start,"
        f" (hi - lo + 2D * {cut}D * h) / {grid - 1} AS step) AS p"
    )
    # Density is undefined without spread. Each task adds its values to a grid of its own.
    rows = with_row(df.select(value.alias("v")), p, "p").where("v IS NOT NULL AND p.h > 0")
    sums = rows.selectExpr("v", "p.start AS start", "p.step AS step", "p.h AS h").mapInArrow(_kernel_sums(grid), "i int, w double")
    points = p.where("p.h > 0").selectExpr(f"explode(sequence(0, {grid - 1})) AS i", "0D AS w")
    density = sums.unionByName(points).groupBy("i").agg(F.expr("sum(w) AS w"))
    return (
        with_row(density, p, "p")
        .selectExpr("*", "p.start + i * p.step AS x")
        .selectExpr(
            "i + 1 AS point",
            "x",
            "w / (p.n * p.h * sqrt(2D * pi())) AS density",
            "x >= p.lo AND x <= p.hi AS inside",
        )
        .orderBy("point")
    )


def box_stats(df: DataFrame, name: str, mode: str = "exact") -> DataFrame:
    """``(column, q1, median, q3, iqr, whisker_lo, whisker_hi, outlier_count, outlier_pct)``.

    Whiskers end at the outermost values inside the fences.
    """
    require_columns(df, [name], "number")
    rows = with_row(df.select(numeric(df, name).alias("v")), fence_row(df, [name], mode), "f")
    return rows.selectExpr("v", "f[0] AS f", "v < f[0].lower OR v > f[0].upper AS out").selectExpr(
        f"{text(name)} AS column",
        *[f"any_value(f.{k}) AS {k}" for k in ("q1", "median", "q3", "iqr")],
        "min(if(NOT out, v, NULL)) AS whisker_lo",
        "max(if(NOT out, v, NULL)) AS whisker_hi",
        "count_if(out) AS outlier_count",
        "round(try_divide(100D * count_if(out), count(1)), 2) AS outlier_pct",
    )


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    n: int | None = None,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """``(x, y[, color])`` of the rows where both are known: all of them, or with ``n`` a sample.

    The sample takes the ``n`` rows whose ``key`` columns hash lowest, so it is the same on every
    run and does not depend on file order.
    """
    return _points(df, {"x": x, "y": y}, color, n, key)


def scatter_matrix_points(
    df: DataFrame,
    names: Sequence[str] | None = None,
    color: str | None = None,
    n: int | None = None,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """The chosen number columns (by default the first four) of all rows or of a sample, with an
    optional colour column. Missing values stay, since every pair of axes drops its own."""
    names = columns_of(df, "number")[:MATRIX_COLUMNS] if names is None else list(names)
    return _points(df, {c: c for c in names}, color, n, key, complete=False)


def _points(df, axes, color, n, key, complete=True) -> DataFrame:
    require_columns(df, dict.fromkeys(axes.values()), "number")
    cols = [numeric(df, c).alias(axis) for axis, c in axes.items()]
    if color is not None:
        cols.append(known(df, color).alias("color"))
    if n is not None:
        if not key:
            raise ValueError("a sample needs key columns")
        digest = F.md5(F.concat_ws("|", *[ref(k).cast("string") for k in key]).cast("binary"))
        cols.append(digest.alias("_digest"))
    points = df.select(*cols)
    if complete:
        points = points.dropna(subset=list(axes))
    return points if n is None else points.orderBy("_digest", *axes).limit(n).drop("_digest")


def missingness_map(df: DataFrame, order_key: str, buckets: int = 100) -> DataFrame:
    """``(bucket, column, missing_share)``: share of missing values of every column along
    equal-width ranges of ``order_key``, a number or a time. Rows without a key form bucket 0."""
    key = _axis(df, order_key)
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).selectExpr("struct(lo, hi) AS p")
    place = f"int(floor(try_divide((k - p.lo) * {buckets}, p.hi - p.lo))) + 1"
    # A table whose keys are all equal is one bucket.
    bucket = f"CASE WHEN k IS NULL THEN 0 ELSE least({buckets}, coalesce({place}, 1)) END"
    parts = []
    for names in batches(df.columns, COLUMNS_PER_SCAN):
        flags = [f"DOUBLE({missing_sql(df, c)}) AS m{i}" for i, c in enumerate(names)]
        cells = array_sql(f"struct({text(c)} AS column, avg(m{i}) AS missing_share)" for i, c in enumerate(names))
        keyed = with_row(df.select(key.alias("k"), *map(F.expr, flags)), ends, "p").withColumn("bucket", F.expr(bucket))
        parts.append(keyed.groupBy("bucket").agg(F.expr(f"{cells} AS cells")).selectExpr("bucket", "inline(cells)"))
    return union_rows(parts)


def _axis(df: DataFrame, name: str) -> Column:
    family = family_of(df.schema[name].dataType)
    if family == "number":
        return numeric(df, name)
    if family == "datetime":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
        return F.timestamp_diff("MICROSECOND", epoch, ref(name).cast("timestamp")).cast("double")
    raise ValueError(f"{name} is neither a number nor a time")


def missing_bars(df: DataFrame) -> DataFrame:
    """``(position, column, missing_count, missing_pct)`` of columns with missing values, longest
    bar first."""
    return missing_values(df, "sorted")


def eda_bundle(
    df: DataFrame,
    order_key: str,
    roles: tuple[list[str], list[str]] | None = None,
    mode: str = "exact",
) -> dict[str, DataFrame]:
    """The standard set of charts as tables: missing map, distributions of the first five numerical
    columns, correlation heatmap, bars of the first five categorical columns, and points and line of
    the most correlated pair when there are at least two numerical columns."""
    categorical, numerical = roles or split_roles(df)
    charts = {"missing_values_heatmap": missingness_map(df, order_key)}
    for name in numerical[:BUNDLE_COLUMNS]:
        charts[f"distribution_{name}"] = histogram_auto(df, name, mode)
        charts[f"density_{name}"] = kde(df, name, cut=0.0)
    charts["correlation_heatmap"] = correlation_heatmap(df, numerical, lower_only=True)
    for name in categorical[:BUNDLE_COLUMNS]:
        charts[f"categorical_{name}"] = category_counts(df, name)
    if len(numerical) >= 2:
        pair = most_correlated_pair(df, (categorical, numerical)).first()
        if pair is not None:
            charts["scatter_plot"] = scatter_points(df, pair["col_x"], pair["col_y"])
            charts["scatter_line"] = regression_line(df, pair["col_x"], pair["col_y"])
    return charts


def bundle_index(spark: SparkSession, charts: dict[str, DataFrame]) -> DataFrame:
    """``(seq, chart, n_rows)``: the charts of a bundle in order, with the size of each table."""
    return literal_rows(
        spark,
        [(i, name, t.count()) for i, (name, t) in enumerate(charts.items(), 1)],
        "seq int, chart string, n_rows bigint",
    )


# What stands for a row of each chart: a label and two numbers.
_POINTS = {
    "missing_values_heatmap": ("column", "bucket", "missing_share"),
    "distribution": ("NULL", "lo", "n"),
    "density": ("NULL", "x", "density"),
    "correlation_heatmap": ("concat(col_x, '|', col_y)", "NULL", "r"),
    "categorical": ("value", "rank", "n"),
    "scatter_plot": ("NULL", "x", "y"),
    "scatter_line": ("concat(col_x, '|', col_y)", "slope", "intercept"),
}


def bundle_points(charts: dict[str, DataFrame]) -> DataFrame:
    """``(chart, label, a, b)``: what the charts of a bundle show, as one table.

    Missing map: column, bucket, share; distribution: lower edge and count; density: place and density;
    heatmap: both columns and r; bars: value, rank and count; points: x and y; line: slope and intercept.
    """
    parts = []
    for name, rows in charts.items():
        label, a, b = _POINTS[name if name in _POINTS else name.split("_")[0]]
        cells = f"CAST({label} AS STRING) AS label", f"CAST({a} AS DOUBLE) AS a", f"CAST({b} AS DOUBLE) AS b"
        parts.append(rows.selectExpr(f"{text(name)} AS chart", *cells))
    return union_rows(parts)
