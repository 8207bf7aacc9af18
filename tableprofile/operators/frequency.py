"""Value frequencies and distinct counts.

Candidates for the most frequent values of all columns come from one scan that summarises hashes. Where every value has to be grouped, each column has a plan of its own and the small
results are united: a columnar source then reads each column once, values keep their own type (text
is made only of the few values that are reported), and a value that fills much of a column is
collapsed by map-side counting before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import (
    array_sql,
    columns_of,
    family_of,
    head_sql,
    known_sql,
    literal_rows,
    position_of,
    quoted,
    require_columns,
    text,
    union_rows,
    with_row,
)
from tableprofile.operators.facts import Facts
from tableprofile.operators.heavy import candidates, hash_sql
from tableprofile.operators.roles import split_roles

TOP_VALUES = 10
MAX_BARS = 10
KEPT_BARS = 9
OTHER = "Other"
HIGH_CARDINALITY = 10
HIGH_CARDINALITY_ADVICE = 5
HIGH_CARDINALITY_INSIGHT = 2
# Longest text that is compared as it is; a marked digest is longer by two.
LONG_TEXT = 63
# A column with at most ten distinct values never gets a higher estimate from the sketch.
_SKETCH_CEILING = 13


def groupable_columns(df: DataFrame) -> list[str]:
    """All columns but nested ones."""
    return columns_of(df, "number", "object", "bool", "datetime")


def frequencies(df: DataFrame, name: str) -> DataFrame:
    """``(value, n)`` of the known values of one column, in the column's own type."""
    require_columns(df, [name])
    values = df.selectExpr(f"{known_sql(df, name)} AS value").where("value IS NOT NULL")
    return values.groupBy("value").agg(F.expr("count(1) AS n"))


def distinct_key(df: DataFrame, name: str) -> str:
    """SQL: what to count distinct values by: the value, or for long text its SHA-256 digest, so
    that a column of documents is not shuffled. The mark keeps digests apart from short text."""
    value = known_sql(df, name)
    if family_of(df.schema[name].dataType) != "object":
        return value
    return f"CASE WHEN length({value}) > {LONG_TEXT} THEN concat('#', sha2({value}, 256)) ELSE {value} END"


def _tagged(df: DataFrame, name: str, part: DataFrame, *exprs: str) -> DataFrame:
    return part.selectExpr(f"{position_of(df, name)} AS position", f"{text(name)} AS column", *exprs)


def long_text_columns(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Text columns with a long value in any row. This picks a plan, never a result."""
    texts = [n for n in names if family_of(df.schema[n].dataType) == "object"]
    if not texts:
        return set()
    row = df.selectExpr(*[f"bool_or(length({quoted(n)}) > {LONG_TEXT})" for n in texts]).first()
    return {n for n, long in zip(texts, row) if long}


def _key_counts(df: DataFrame, name: str) -> DataFrame:
    """``(key, n)``: frequencies by ``distinct_key``, so long text is not shuffled."""
    keys = df.selectExpr(f"{distinct_key(df, name)} AS key").where("key IS NOT NULL")
    return keys.groupBy("key").agg(F.expr("count(1) AS n"))


def _frequent(df: DataFrame, name: str, k: int, long: bool) -> DataFrame:
    """``(value, n)`` of values that include the ``k`` most frequent ones.

    Long text is counted by digest, and looked up for the fewer than k values that are more frequent
    than the k-th and for the smallest of those as frequent as it, of which each task sends k at most.
    A text that fills much of a column is one row per task.
    """
    if not long:
        return frequencies(df, name)
    counts = _key_counts(df, name)
    top = counts.orderBy(F.desc("n")).limit(k).collect()  # k digests
    least = top[-1]["n"] if len(top) == k else 0
    above = {r["key"]: r["n"] for r in top if r["n"] > least}
    texts = df.selectExpr(f"{known_sql(df, name)} AS value", f"{distinct_key(df, name)} AS key").where("value IS NOT NULL")
    listed = texts.where(F.col("key").isin(list(above)))
    found = listed.groupBy("key").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
    if least > 1:
        # Each tied text is known by its least one in a task before anything is sent.
        tied = counts.where(F.col("n") == least).select("key")
        smallest = texts.join(tied, "key", "left_semi").select("value").distinct().orderBy("value").limit(k)
        found = found.unionByName(smallest.selectExpr("'' AS key", "value", f"{least}L AS n"))
    elif least == 1:
        # All but the fewer than k listed texts occur once.
        once = texts.where(~F.col("key").isin(list(above))).orderBy("value").limit(k)
        found = found.unionByName(once.selectExpr("key", "value", "1L AS n"))
    return found.select("value", "n")


def _ranked(df: DataFrame, name: str, k: int, long: bool) -> DataFrame:
    """One row: ``top``, the ``k`` most frequent values of a column as an ordered array.

    Only ``k`` rows per task reach the last step; ties go to the smaller value.
    """
    top = _frequent(df, name, k, long).orderBy(F.desc("n"), "value").limit(k)
    return top.selectExpr(
        "array_sort(collect_list(named_struct('neg', -n, 'value', value, 'n', n))) AS top"
    )


def top_values(
    df: DataFrame,
    k: int = TOP_VALUES,
    names: Sequence[str] | None = None,
    roles: tuple[list[str], list[str]] | None = None,
) -> DataFrame:
    """``(position, column, rank, value, n)``: the most frequent known values of each categorical
    column, as text; ties go to the smaller value.

    One scan of all columns finds candidates by hash with a bound of the error; of each column only these
    are counted. Only columns whose values are too evenly spread for that are grouped whole."""
    names = (roles or split_roles(df))[0] if names is None else require_columns(df, names)
    ddl = "position int, column string, rank int, value string, n bigint"
    if not names:
        return literal_rows(df.sparkSession, [], ddl)
    found = candidates(df, names, k)
    long = long_text_columns(df, [n for n in names if found[n] is None])
    parts = []
    for n in names:
        top = _ranked(df, n, k, n in long) if found[n] is None else _recounted(df, n, found[n], k)
        parts.append(
            _tagged(df, n, top, "posexplode(top) AS (pos, v)").selectExpr(
                "position", "column", "pos + 1 AS rank", "CAST(v.value AS STRING) AS value", "v.n AS n"
            )
        )
    return union_rows(parts)


def _recounted(df: DataFrame, name: str, hashes: Sequence[int], k: int) -> DataFrame:
    """One row: ``top``, the ``k`` most frequent values of a column whose candidates are known.

    Only rows of candidates are grouped, by their value: two values of one hash stay apart.
    """
    rows = df.selectExpr(f"{known_sql(df, name)} AS value", f"{hash_sql(df, name)} AS h")
    listed = ", ".join(f"{h}L" for h in hashes) or "NULL"
    counts = rows.where(f"h IN ({listed})").groupBy("value").agg(F.expr("count(1) AS n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.selectExpr("array_sort(collect_list(named_struct('neg', -n, 'value', value, 'n', n))) AS top")


def unique_counts(
    df: DataFrame, names: Sequence[str] | None = None, mode: str = "exact"
) -> DataFrame:
    """``(position, column, n_unique)``: distinct known values per column.

    ``mode="approx"`` is one scan with a sketch per column and no shuffle of values.
    """
    names = groupable_columns(df) if names is None else require_columns(df, names)
    if not names:
        return literal_rows(df.sparkSession, [], "position int, column string, n_unique bigint")
    if mode == "approx":
        rows = array_sql(
            f"named_struct({head_sql(df, n)}, 'n_unique', approx_count_distinct({known_sql(df, n)}))"
            for n in names
        )
        return df.selectExpr(f"{rows} AS rows").selectExpr("inline(rows)")
    if mode != "exact":
        raise ValueError("mode must be 'exact' or 'approx'")
    return union_rows(
        [
            _tagged(
                df, n, df.selectExpr(f"count(DISTINCT {distinct_key(df, n)}) AS n_unique"), "n_unique"
            )
            for n in names
        ]
    )


def high_cardinality(
    df: DataFrame,
    variant: str = "advice",
    roles: tuple[list[str], list[str]] | None = None,
    facts: Facts | None = None,
) -> DataFrame:
    """``(position, column, n_unique)`` of columns with more than ten distinct values.

    ``advice``: categorical columns, most distinct values first, five at most; ``insight``: text
    columns in schema order, two at most.
    """
    if variant == "advice":
        names, k = (roles or split_roles(df, facts))[0], HIGH_CARDINALITY_ADVICE
        # Number columns are categories only with few values, and so are those the sketch says so of.
        names = [n for n in names if n not in columns_of(df, "number")]
        if facts:
            names = [n for n in names if (facts.other[n].estimate or 0) > HIGH_CARDINALITY * 0.9]
        order = [F.desc("n_unique"), "position"]
    elif variant == "insight":
        names, k = _first_high(df, HIGH_CARDINALITY_INSIGHT, facts), HIGH_CARDINALITY_INSIGHT
        order = ["position"]
    else:
        raise ValueError("variant must be 'advice' or 'insight'")
    return (
        unique_counts(df, names).where(F.col("n_unique") > HIGH_CARDINALITY).orderBy(*order).limit(k)
    )


def _first_high(df: DataFrame, k: int, facts: Facts | None = None) -> list[str]:
    """Text columns among which the first ``k`` with more than ten values must be.

    A sketch tells for most columns whether they are; only those in question and the first ``k``
    certain ones are left to be counted exactly.
    """
    names = columns_of(df, "object")
    if not names:
        return []
    if facts:
        row = [facts.other[n].estimate for n in names]
    else:
        row = df.selectExpr(*[f"approx_count_distinct({quoted(n)})" for n in names]).first()
    kept, certain = [], 0
    for name, estimate in zip(names, row):
        if certain == k:
            break
        kept.append(name)
        certain += estimate > _SKETCH_CEILING
    return kept


def describe_text(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(position, column, count, unique, top, freq)`` of columns that are not numbers.

    This is the summary of a table without number columns. Ties for the most frequent value go to
    the smaller one.
    """
    names = (
        columns_of(df, "object", "bool", "datetime") if names is None else require_columns(df, names)
    )
    long = long_text_columns(df, names)
    parts = []
    for n in names:
        totals = ["coalesce(sum(n), 0L) AS count", "count(1) AS unique", "max(n) AS freq"]
        if n in long:
            stats = with_row(_key_counts(df, n).selectExpr(*totals), _ranked(df, n, 1, True), "top")
            stats = stats.withColumn("top", F.expr("get(top, 0).value"))
        else:
            top = "CAST(min_by(value, struct(-n, value)) AS STRING) AS top"
            stats = frequencies(df, n).selectExpr(*totals, top)
        parts.append(_tagged(df, n, stats, "count", "unique", "top", "freq"))
    if not parts:
        return literal_rows(
            df.sparkSession,
            [],
            "position int, column string, count bigint, unique bigint, top string, freq bigint",
        )
    return union_rows(parts)


def category_counts(df: DataFrame, name: str) -> DataFrame:
    """``(rank, value, n)``: the bars of a category chart, largest first.

    Up to ten distinct values: all of them, missing rows dropped. More than ten: the nine most
    frequent; all other rows, missing ones included, are counted as ``Other``.
    """
    if family_of(df.schema[name].dataType) == "nested":
        raise ValueError(f"{name} is a nested column")
    long = bool(long_text_columns(df, [name]))
    bars = "transform(slice(top, 1, {0}), v -> struct(CAST(v.value AS STRING) AS value, v.n AS n))"
    kept = f"aggregate(slice(top, 1, {KEPT_BARS}), 0L, (a, v) -> a + v.n)"
    rest = f"array(struct({text(OTHER)} AS value, n_rows - {kept} AS n))"
    # A category that is itself called Other joins the rest.
    merged = (
        with_row(_ranked(df, name, MAX_BARS + 1, long), df.selectExpr("count(1) AS n_rows"), "n_rows")
        .selectExpr(
            f"inline(if(size(top) <= {MAX_BARS}, {bars.format(MAX_BARS)},"
            f" concat({bars.format(KEPT_BARS)}, {rest})))"
        )
        .groupBy("value")
        .agg(F.expr("sum(n) AS n"))
    )
    # At most ten rows are left here.
    return (
        merged.selectExpr(
            "array_sort(collect_list(named_struct('neg', -n, 'value', value, 'n', n))) AS bars"
        )
        .selectExpr("posexplode(bars) AS (pos, v)")
        .selectExpr("pos + 1 AS rank", "v.value", "v.n")
    )
