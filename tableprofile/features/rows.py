"""Repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableprofile.functions.columns import require_columns


def drop_duplicate_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row of those that are equal in all columns, or in ``names`` (then any one of them)."""
    return df.dropDuplicates(require_columns(df, names) if names is not None else None)
