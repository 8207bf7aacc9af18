"""Missing-value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import array_sql, batched_array, batches, head_sql, missing_sql, ref, union_rows
from tableprofile.operators.facts import Facts

VARIANTS = ("all", "present", "sorted")
# Bounds the generated code of an aggregate.
COLUMNS_PER_SCAN = 100


def missing_facts(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """One row: ``n_rows`` and ``columns``, an array of ``(position, column, missing_count, share)``
    in schema order. The share is in percent of all rows, not rounded."""
    if facts:
        counts = {n: f"{facts.missing(n)}L" for n in df.columns}
        total, row = f"{facts.n_rows}L", df.sparkSession.sql("SELECT 1")
    else:
        counts = {n: f"count_if({missing_sql(df, n)})" for n in df.columns}
        total, row = "count(1)", df
    cells = [
        f"named_struct({head_sql(df, n)}, 'missing_count', {c}, 'share', try_divide({c} * 100D, {total}))"
        for n, c in counts.items()
    ]
    if facts or len(cells) <= COLUMNS_PER_SCAN:
        return row.selectExpr(f"{total} AS n_rows", array_sql(cells) + " AS columns")
    columns = batched_array(df, cells, COLUMNS_PER_SCAN)
    return df.selectExpr("count(1) AS n_rows").select("n_rows", columns.alias("columns"))


def missing_values(df: DataFrame, variant: str = "all", facts: Facts | None = None) -> DataFrame:
    """``(position, column, missing_count, missing_pct)``.

    ``all``: every column in schema order; ``present``: only columns with missing rows; ``sorted``:
    those, most missing first. The share is over all rows, rounded to two decimals.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    rows = missing_facts(df, facts).select(F.inline("columns")).select(
        "position", "column", "missing_count", F.round("share", 2).alias("missing_pct")
    )
    if variant == "all":
        return rows.orderBy("position")
    rows = rows.where(ref("missing_count") > 0)
    order = ["position"] if variant == "present" else [F.desc("missing_count"), "position"]
    return rows.orderBy(*order)


def total_missing(df: DataFrame) -> DataFrame:
    """``(total_missing)``: missing cells of the whole table."""
    parts = []
    for names in batches(df.columns, COLUMNS_PER_SCAN):
        counts = array_sql(f"count_if({missing_sql(df, n)})" for n in names)
        parts.append(df.selectExpr(f"aggregate({counts}, 0L, (a, x) -> a + x) AS n"))
    return union_rows(parts).agg(F.sum("n").alias("total_missing"))


def most_missing(df: DataFrame, k: int = 3) -> DataFrame:
    """``(rank, column, missing_count)``: the ``k`` columns with the most missing rows."""
    ordered = (
        "array_sort(columns, (a, b) -> CASE WHEN a.missing_count <> b.missing_count"
        " THEN int(sign(b.missing_count - a.missing_count)) ELSE a.position - b.position END)"
    )
    return (
        missing_facts(df)
        .selectExpr(f"posexplode(slice({ordered}, 1, {k})) AS (pos, c)")
        .selectExpr("pos + 1 AS rank", "c.column", "c.missing_count")
    )
