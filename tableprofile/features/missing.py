"""Treatment of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import (
    array_sql,
    batches,
    is_missing,
    known,
    missing_sql,
    numeric,
    numeric_frame,
    quoted,
    ref,
    require_columns,
    with_row,
)
from tableprofile.operators.quantiles import quantile_row

MAX_SHARE = 0.5
# Columns whose missing values one scan counts.
COLUMNS_PER_SCAN = 100


def most_frequent(df: DataFrame, name: str) -> DataFrame:
    """One row: the most frequent value that is not missing, the smallest of equally frequent ones."""
    counts = df.select(known(df, name).alias("value")).where("value IS NOT NULL").groupBy("value").count()
    return counts.agg(F.min_by("value", F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("value"))


def impute(df: DataFrame, names: Sequence[str], how: str = "mean") -> DataFrame:
    """All columns, missing values of ``names`` filled by their ``mean``, ``median`` or ``mode``.

    Mean and median make the columns doubles; a column without any value stays missing.
    """
    if how not in ("mean", "median", "mode"):
        raise ValueError("how must be 'mean', 'median' or 'mode'")
    names = require_columns(df, names, None if how == "mode" else "number")
    if not names:
        return df
    out = df
    if how == "mode":
        for i, n in enumerate(names):
            out = with_row(out, most_frequent(df, n), f"__fill{i}")
        filled = {n: F.coalesce(known(df, n), F.col(f"__fill{i}")) for i, n in enumerate(names)}
    else:
        row = (
            quantile_row(df, names, (0.5,)).selectExpr("transform(q, v -> v[0]) AS fill")
            if how == "median"
            else numeric_frame(df, names).selectExpr(array_sql(f"avg({quoted(n)})" for n in names) + " AS fill")
        )
        out = with_row(out, row, "__fill")
        filled = {n: F.coalesce(numeric(df, n), F.col("__fill")[i]) for i, n in enumerate(names)}
    return out.select(*[filled[c].alias(c) if c in filled else ref(c) for c in df.columns])


def missing_indicators(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns, and for each of ``names`` ``<name>_missing``, 1 where it is missing."""
    names = require_columns(df, names)
    return df.select("*", *[is_missing(df, n).cast("int").alias(f"{n}_missing") for n in names])


def drop_sparse_columns(df: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """The columns of which no more than ``max_share`` is missing; all of them for an empty table."""
    kept = []
    for names in batches(df.columns, COLUMNS_PER_SCAN):
        n, *missing = df.selectExpr("count(*)", *[f"count_if({missing_sql(df, c)})" for c in names]).first()
        kept += [c for c, m in zip(names, missing) if m <= max_share * n]
    return df.select(*map(ref, kept))


def drop_sparse_rows(df: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """The rows of which no more than ``max_share`` of the values is missing."""
    flags = array_sql(f"int({missing_sql(df, c)})" for c in df.columns)
    return df.where(f"aggregate({flags}, 0, (a, x) -> a + x) <= {max_share * len(df.columns)!r}D")


