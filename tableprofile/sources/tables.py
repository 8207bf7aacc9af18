"""Tables by name."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tableprofile.operators.selection import require_rows
from tableprofile.sources.csv import read_csv

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def registry(directory: str) -> dict[str, str]:
    """Name to location of the parquet tables in a folder."""
    return {name: os.path.join(directory, f"{name}.parquet") for name in TABLES}


def read_table(spark: SparkSession, location: str) -> DataFrame:
    """A CSV or parquet location; the ending decides."""
    if location.endswith((".csv", ".csv.gz")):
        return read_csv(spark, location)
    return spark.read.parquet(location)


def load_table(spark: SparkSession, name: str, locations: Mapping[str, str]) -> DataFrame:
    """A registered table that has rows."""
    if name not in locations:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(sorted(locations))}")
    return require_rows(read_table(spark, locations[name]))
