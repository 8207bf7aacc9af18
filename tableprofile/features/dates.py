"""Features of dates and times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import ref, require_columns

#: Part: its expression, and how many values it has in a cycle, counted from ``first``.
_PARTS = {
    "year": (F.year, None, None),
    "quarter": (F.quarter, 4, 1),
    "month": (F.month, 12, 1),
    "day": (F.dayofmonth, 31, 1),
    "weekday": (F.weekday, 7, 0),
}


def date_parts(df: DataFrame, name: str, parts: Sequence[str] = tuple(_PARTS)) -> DataFrame:
    """All columns and ``<name>_<part>``; the weekday is 0 on Mondays."""
    require_columns(df, [name], "datetime")
    return df.select("*", *[_PARTS[p][0](ref(name)).alias(f"{name}_{p}") for p in parts])


def cyclical_parts(df: DataFrame, name: str, parts: Sequence[str] = ("month", "weekday")) -> DataFrame:
    """All columns, and ``<name>_<part>_sin`` and ``_cos`` of the part's place in its cycle."""
    require_columns(df, [name], "datetime")
    terms = []
    for p in parts:
        of, length, first = _PARTS[p]
        if length is None:
            raise ValueError(f"{p} has no cycle")
        angle = (of(ref(name)) - first) * (2 * math.pi / length)
        terms += [F.sin(angle).alias(f"{name}_{p}_sin"), F.cos(angle).alias(f"{name}_{p}_cos")]
    return df.select("*", *terms)


def days_between(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """All columns and ``days_<earlier>_to_<later>``, full calendar days."""
    require_columns(df, [earlier, later], "datetime")
    return df.select("*", F.datediff(ref(later), ref(earlier)).alias(f"days_{earlier}_to_{later}"))


def days_since(df: DataFrame, name: str, event: Column | None = None) -> DataFrame:
    """All columns and ``days_since_<name>``: calendar days up to ``event``, by default the latest date."""
    require_columns(df, [name], "datetime")
    if event is None:
        event = df.select(F.max(ref(name)).alias("last")).scalar()
    return df.select("*", F.datediff(event, ref(name)).alias(f"days_since_{name}"))
