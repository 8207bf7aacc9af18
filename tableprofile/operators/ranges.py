"""Order over a whole table without putting it into one task: running sums over sorted ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprofile.functions.columns import ref
from tableprofile.sources.scratch import written


def numbered(rows: DataFrame, order: Sequence[str], weight: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """All columns with ``__before`` and ``__total``: the sum of ``weight`` (or number) of the rows before, and of all.

    Rows are ordered by ``order``, in any order where it ties, and counted ``within`` equal values, where
    nulls are equal. They are sorted into ranges once, so that the running sums of a range need its own rows
    and one number from each range before it; a group that fills many ranges is in many tasks. Ranges
    are bounded by a sample and written, so that a task that runs again finds the same ones.
    """
    keys = [ref(c) for c in (*within, *order)]
    ranged = rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    n = F.lit(1) if weight is None else ref(weight)
    group = [ref(c) for c in within]
    here = Window.partitionBy(*group, "__range").orderBy(*[ref(c) for c in order])
    sizes = ranged.groupBy(*group, "__range").agg(F.sum(n).cast("bigint").alias("__size"))
    # One row per group and range that has it.
    earlier = Window.partitionBy(*group).orderBy("__range")
    starts = sizes.select(
        *[g.alias(f"__of{i}") for i, g in enumerate(group)],
        F.col("__range").alias("__at"),
        (F.sum("__size").over(earlier) - F.col("__size")).alias("__start"),
        F.sum("__size").over(earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    same = F.col("__range") == F.col("__at")
    for i, g in enumerate(group):
        same = same & g.eqNullSafe(F.col(f"__of{i}"))
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumn("__sum", F.sum(n).over(so_far).cast("bigint") - n)
    return running.join(starts, same).select(
        *map(ref, rows.columns), (F.col("__start") + F.col("__sum")).alias("__before"), "__total"
    )
