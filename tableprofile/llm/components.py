"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.scratch import written


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, of every end of ``links`` (``a``, ``b``).

    In every round each node takes the smallest label around it, and then the label of that label,
    so that chains shorten by half. Labels are written each round. Links may repeat, point either
    way or to their own start; without links there are no rows. Partial sums keep the neighbours of
    a much-linked node apart until they are one row per task.
    """
    both = written(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = written(labels, "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(both["a"].alias("at"))
            .agg(F.min("component").alias("around"))
        )
        step = labels.join(near, labels["node"] == near["at"], "left").select(
            "node",
            F.col("component").alias("old"),
            F.least("component", F.coalesce("around", "component")).alias("component"),
        )
        up = step.select(F.col("node").alias("up"), F.col("component").alias("upper"))
        moved = written(
            step.join(up, step["component"] == up["up"], "left").select(
                "node", "old", F.least("component", F.coalesce("upper", "component")).alias("component")
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.filter("component <> old").limit(1).count() == 0:
            return labels
