"""Encoding and combination of categories, and statistics of their groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import known, numeric, ref, require_columns
from tableprofile.operators.quantiles import grouped_medians
from tableprofile.operators.ranges import numbered

OTHER = "Other"
MIN_SHARE = 0.01
#: Distinct values up to which a column may be made into one column per value.
MAX_ONE_HOT = 200


def interaction(df: DataFrame, names: Sequence[str], separator: str = "_") -> DataFrame:
    """All columns and ``<a>_<b>...`` of the values' text; missing if any of them is."""
    names = require_columns(df, names)
    parts = [known(df, n).cast("string") for n in names]
    return df.select("*", F.concat(*[x for p in parts for x in (F.lit(separator), p)][1:]).alias("_".join(names)))


def _by_value(df: DataFrame, name: str, facts: DataFrame, *made: str) -> DataFrame:
    """All columns and those of ``facts`` of the row's value, which is their ``__value``.

    A join on the value: facts are one row per value, however many there are.
    """
    keyed = df.withColumn("__key", known(df, name))
    joined = keyed.join(facts, F.col("__key").eqNullSafe(F.col("__value")), "left")
    return joined.select(*map(ref, df.columns), *made)


def target_encode(df: DataFrame, name: str, target: str) -> DataFrame:
    """All columns and ``<name>_target``: mean of the target over the rows of the same value.

    Missing values are a group of their own.
    """
    require_columns(df, [name])
    require_columns(df, [target], "number")
    facts = df.groupBy(known(df, name).alias("__value")).agg(F.avg(numeric(df, target)).alias(f"{name}_target"))
    return _by_value(df, name, facts, f"{name}_target")


def apply_target_encoding(df: DataFrame, name: str, fitted_on: DataFrame, target: str) -> DataFrame:
    """``target_encode`` with means of another table; values it lacks have its overall mean."""
    column = f"{name}_target"
    facts = fitted_on.groupBy(known(fitted_on, name).alias("__value")).agg(F.avg(numeric(fitted_on, target)).alias("__mean"))
    overall = fitted_on.select(F.avg(numeric(fitted_on, target)).alias("m")).scalar()
    return _by_value(df, name, facts, "__mean").select(
        *map(ref, df.columns), F.coalesce("__mean", overall).alias(column)
    )


def fold_rare(df: DataFrame, name: str, min_share: float = MIN_SHARE, other: str = OTHER) -> DataFrame:
    """All columns, values of ``name`` with less than ``min_share`` of its known rows set to ``other``."""
    require_columns(df, [name])
    counts = df.select(known(df, name).alias("__value")).where("__value IS NOT NULL").groupBy("__value").agg(F.count("*").alias("__n"))
    total = df.select(F.count(known(df, name)).alias("n")).scalar()
    facts = counts.select("__value", (F.col("__n") >= total * F.lit(min_share)).alias("__frequent"))
    folded = F.when(F.col("__frequent"), ref(name).cast("string")).when(F.col("__key").isNotNull(), F.lit(other))
    joined = df.withColumn("__key", known(df, name)).join(facts, F.col("__key") == F.col("__value"), "left")
    return joined.select(*[folded.alias(c) if c == name else ref(c) for c in df.columns])


def one_hot(df: DataFrame, name: str) -> DataFrame:
    """All columns, and ``<name>_<value>`` for every value: 1 where the row has it, else 0.

    Raises beyond ``MAX_ONE_HOT`` distinct values; ``label_encode`` has no limit.
    """
    require_columns(df, [name])
    values = df.select(known(df, name).alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(MAX_ONE_HOT + 1)
    values = [r["v"] for r in values.collect()]
    if len(values) > MAX_ONE_HOT:
        raise ValueError(f"{name!r} has more than {MAX_ONE_HOT} distinct values")
    return df.select("*", *[known(df, name).eqNullSafe(F.lit(v)).cast("int").alias(f"{name}_{v}") for v in values])


def label_encode(df: DataFrame, name: str) -> DataFrame:
    """All columns and ``<name>_label``: number of the value among the sorted distinct ones, from 0.

    Missing values have no label. Distinct values, not rows, are sorted into ranges, and each range
    counts on from those before it, all in generated code; labels are bigint.
    """
    require_columns(df, [name])
    values = df.select(known(df, name).alias("__value")).where("__value IS NOT NULL").distinct()
    facts = numbered(values, ["__value"]).select("__value", F.col("__before").alias(f"{name}_label"))
    return _by_value(df, name, facts, f"{name}_label")


def group_statistics(df: DataFrame, group: str, name: str) -> DataFrame:
    """All columns and ``<name>_<fact>_by_<group>`` (mean, median, min, max) and ``_minus_mean`` of the row's group.

    Missing group values are a group of their own.
    """
    require_columns(df, [group])
    require_columns(df, [name], "number")
    x, suffix = numeric(df, name), f"by_{group}"
    made = [f"{name}_{f}_{suffix}" for f in ("mean", "median", "min", "max")]
    keyed = df.select(known(df, group).alias("__value"), x.cast("double").alias("x"))
    medians = grouped_medians(keyed).select(F.col("__value").alias("__of"), F.col("__median").alias(made[1]))
    facts = df.groupBy(known(df, group).alias("__value")).agg(*[a(x).alias(m) for a, m in zip((F.avg, F.min, F.max), (made[0], *made[2:]))])
    facts = facts.join(medians, F.col("__value").eqNullSafe(F.col("__of")), "left")
    joined = _by_value(df, group, facts, *made)
    return joined.select("*", (numeric(df, name) - ref(made[0])).alias(f"{name}_minus_mean_{suffix}"))
