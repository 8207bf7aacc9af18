"""Row and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tableprofile.functions.columns import numeric, ref, require_columns
from tableprofile.operators.quantiles import fence_row


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself; raises when it is absent or has no rows (reads one row at most)."""
    if df is None:
        raise ValueError("no table is loaded")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def select_columns(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Only the chosen columns; an empty choice keeps all."""
    return df.select(*[ref(n) for n in require_columns(df, names)]) if names else df


def sample_rows(df: DataFrame, order_by: Sequence[str | Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order. A table has no order of its own."""
    if not order_by:
        raise ValueError("order_by must name at least one column")
    return df.orderBy(*order_by).limit(n)


def outlier_rows(df: DataFrame, name: str, mode: str = "exact") -> DataFrame:
    """Rows whose value lies strictly outside the fences ``q1 - 1.5 iqr`` and ``q3 + 1.5 iqr``.

    The fences enter the filter as scalar subqueries, so nothing is joined.
    """
    require_columns(df, [name], "number")
    fences = fence_row(df, [name], mode)
    value = numeric(df, name)
    lower = fences.selectExpr("f[0].lower").scalar()
    upper = fences.selectExpr("f[0].upper").scalar()
    return df.where((value < lower) | (value > upper))
