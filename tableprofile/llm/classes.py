"""The first row of those with equal keys, for keys that a large share of the rows may have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt.
SALTS = 64


def with_first(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """All rows with ``first``: the smallest id among the rows of the same keys.

    The smallest ids are found by partial aggregation. Only keys of several rows are sent back, to
    as many parts as the rows of a key are dealt to, so no task holds all rows of a key.
    """
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS))
    firsts = rows.groupBy(*keys).agg(F.min(id_col).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = firsts.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    joined = rows.withColumn("__salt", salt).join(firsts, [*keys, "__salt"], "left")
    return joined.withColumn("first", F.coalesce("first", id_col)).drop("__salt")
