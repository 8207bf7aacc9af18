"""Descriptive statistics, outlier counts and skewness of number columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import (
    array_sql,
    batches,
    columns_of,
    head_sql,
    literal_rows,
    number_sql,
    ref,
    require_columns,
    union_rows,
    with_row,
)
from tableprofile.operators.facts import MOMENT_NOISE, Facts
from tableprofile.operators.quantiles import fence_row, quantile_row
from tableprofile.operators.roles import split_roles

SKEW_LIMIT = 1.0
OUTLIER_PCT_LIMIT = 5.0
COLUMNS_PER_SCAN = 40


def _chosen(df: DataFrame, names: Sequence[str] | None) -> list[str]:
    return columns_of(df, "number") if names is None else require_columns(df, names, "number")


_DESCRIBED = (
    "position int, column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
)


def facts_of(df: DataFrame, names: Sequence[str], facts: Facts | None) -> Facts:
    """The given facts, or those of the columns alone."""
    return facts or Facts(df.select(*map(ref, names)), paired=False)


def describe(
    df: DataFrame, names: Sequence[str] | None = None, mode: str = "exact", facts: Facts | None = None
) -> DataFrame:
    """``(position, column, count, mean, std, min, p25, p50, p75, max)`` of the number columns.

    Exact: one scan for moments and brackets of the quartiles, one that reads the brackets.
    """
    names = _chosen(df, names)
    if not names:
        return literal_rows(df.sparkSession, [], _DESCRIBED)
    if mode != "exact":
        return union_rows([_describe(df, part, mode) for part in batches(names, COLUMNS_PER_SCAN)])
    facts = facts_of(df, names, facts)
    quartiles = facts.quantiles(names)
    rows = []
    for n in names:
        f = facts.number[n]
        rows.append((df.columns.index(n), n, f.count, f.mean, f.std, f.low, *quartiles[n], f.high))
    return literal_rows(df.sparkSession, rows, _DESCRIBED)


def _describe(df: DataFrame, names: Sequence[str], mode: str) -> DataFrame:
    moments = []
    for name in names:
        v = number_sql(df, name)
        moments.append(
            f"named_struct({head_sql(df, name)}, 'count', count({v}), 'mean', avg({v}),"
            f" 'std', stddev_samp({v}), 'min', min({v}), 'max', max({v}))"
        )
    rows = df.selectExpr(array_sql(moments) + " AS rows")
    return (
        with_row(rows, quantile_row(df, names, mode=mode), "q")
        .selectExpr("inline(arrays_zip(rows, q))")
        .selectExpr(
            *["rows." + f for f in ("position", "column", "count", "mean", "std", "min")],
            *["q[0] AS p25", "q[1] AS p50", "q[2] AS p75", "rows.max"],
        )
    )


def column_summary(df: DataFrame, name: str, mode: str = "exact") -> DataFrame:
    """``(column, mean, median, std, min, max)`` of one column."""
    return describe(df, [name], mode).select(
        "column", "mean", F.col("p50").alias("median"), "std", "min", "max"
    )


def quartiles_iqr(
    df: DataFrame, names: Sequence[str] | None = None, mode: str = "exact", facts: Facts | None = None
) -> DataFrame:
    """``(position, column, q1, median, q3, iqr, lower, upper)``."""
    names = _chosen(df, names)
    if not names:
        fields = ("q1", "median", "q3", "iqr", "lower", "upper")
        doubles = ", ".join(f"{f} double" for f in fields)
        return literal_rows(df.sparkSession, [], f"position int, column string, {doubles}")
    heads = array_sql(f"named_struct({head_sql(df, n)})" for n in names)
    return (
        fence_row(df, names, mode, facts)
        .selectExpr(f"{heads} AS h", "f")
        .selectExpr("inline(arrays_zip(h, f))")
        .selectExpr("h.position", "h.column", "f.*")
    )


def outlier_counts(
    df: DataFrame, names: Sequence[str], mode: str = "exact", facts: Facts | None = None
) -> DataFrame:
    """One row: ``n_rows`` and ``outliers``, an array with the number of values outside the fences
    per column. With exact fences the counting is one further scan, shared by all columns."""
    if mode == "exact":
        facts = facts_of(df, names, facts)
        found = facts.outliers(names)
        counts = array_sql(f"{found[n]}L" for n in names)
        return df.sparkSession.sql(f"SELECT {facts.n_rows}L AS n_rows, {counts} AS outliers")
    heads = df.selectExpr(*[f"{number_sql(df, n)} AS v{i}" for i, n in enumerate(names)])
    parts = []
    for at in batches(range(len(names)), COLUMNS_PER_SCAN):
        own = with_row(heads.select(*[f"v{i}" for i in at]), fence_row(df, [names[i] for i in at], mode), "f")
        tests = array_sql(f"count_if(v{i} < f[{k}].lower OR v{i} > f[{k}].upper)" for k, i in enumerate(at))
        parts.append(own.selectExpr(f"{tests} AS outliers").scalar())
    return df.selectExpr("count(1) AS n_rows").select(
        "n_rows", (parts[0] if len(parts) == 1 else F.concat(*parts)).alias("outliers")
    )


def outlier_summary(
    df: DataFrame,
    variant: str = "chosen",
    names: Sequence[str] | None = None,
    roles: tuple[list[str], list[str]] | None = None,
    mode: str = "exact",
    facts: Facts | None = None,
) -> DataFrame:
    """``(position, column, outlier_count, outlier_pct)``.

    ``advice``: numerical columns by role, share above 5 after rounding to two decimals;
    ``insight``: first three number columns, count above 0; ``chosen``: the given number columns.
    """
    if variant == "advice":
        names = (roles or split_roles(df, facts))[1]
    elif variant == "insight":
        names = columns_of(df, "number")[:3]
    elif variant != "chosen":
        raise ValueError("variant must be 'advice', 'insight' or 'chosen'")
    names = _chosen(df, names)
    if not names:
        return literal_rows(
            df.sparkSession,
            [],
            "position int, column string, outlier_count bigint, outlier_pct double",
        )
    rows = array_sql(
        f"named_struct({head_sql(df, n)}, 'outlier_count', outliers[{i}],"
        f" 'outlier_pct', round(try_divide(100D * outliers[{i}], n_rows), 2))"
        for i, n in enumerate(names)
    )
    out = outlier_counts(df, names, mode, facts).selectExpr(f"inline({rows})")
    if variant == "advice":
        return out.where((F.col("outlier_count") > 0) & (F.col("outlier_pct") > OUTLIER_PCT_LIMIT))
    if variant == "insight":
        return out.where(F.col("outlier_count") > 0)
    return out


def sample_skewness(v: str) -> str:
    """SQL aggregate: bias-corrected skewness; NULL below three values, 0 for a constant column."""
    n = f"DOUBLE(count({v}))"
    corrected = f"skewness({v}) * try_divide(sqrt({n} * ({n} - 1)), {n} - 2)"
    return (
        f"CASE WHEN {n} >= 3 THEN CASE WHEN var_pop({v}) * {n} < {MOMENT_NOISE!r}D THEN 0D"
        f" ELSE {corrected} END END"
    )


# SQL: ``right`` or ``left`` for columns skewed beyond 1, else NULL.
DIRECTION = f"CASE WHEN abs(skewness) > {SKEW_LIMIT}D THEN if(skewness > 0, 'right', 'left') END"


def skewness(
    df: DataFrame, names: Sequence[str] | None = None, facts: Facts | None = None
) -> DataFrame:
    """``(position, column, skewness, direction)`` of the number columns."""
    names = _chosen(df, names)
    ddl = "position int, column string, skewness double"
    if facts or len(names) > COLUMNS_PER_SCAN or not names:
        facts = facts or Facts(df.select(*map(ref, names)), ranks=False, paired=False)
        out = literal_rows(df.sparkSession, [(df.columns.index(n), n, facts.number[n].skewness) for n in names], ddl)
    else:
        cells = array_sql(f"named_struct({head_sql(df, n)}, 'skewness', {sample_skewness(number_sql(df, n))})" for n in names)
        out = df.selectExpr(f"{cells} AS rows").selectExpr("inline(rows)")
    return out.selectExpr("*", f"{DIRECTION} AS direction")
