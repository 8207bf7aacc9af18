"""Schema facts and column roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import batches, columns_of, family_of, literal_rows, type_label
from tableprofile.operators.facts import Facts
from tableprofile.operators.shapes import all_dates, prose_sql

# Fixed values of the role rules.
LOW_CARDINALITY = 10
LOW_CARDINALITY_SHARE = 0.05
TIME_WORDS = ("date", "time", "year", "month", "day")
COLUMNS_PER_SCAN = 100


def shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))


def column_types(df: DataFrame) -> DataFrame:
    """``(position, column, dtype)``, from the schema alone."""
    return literal_rows(
        df.sparkSession,
        [(i, f.name, type_label(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string",
    )


def overview(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols, n_number, n_object, n_datetime)``."""
    counts = {k: len(columns_of(df, k)) for k in ("number", "object", "datetime")}
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        *[F.lit(v).alias(f"n_{k}") for k, v in counts.items()],
    )


def column_roles(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """``(position, column, role)`` with role ``categorical``, ``numerical`` or ``other``.

    Text and boolean columns are categorical; so are number columns with fewer than ten distinct
    values that make up less than 5% of the rows. Tasks tell the first few different values of all
    number columns in one scan, and none holds more than a handful.
    """
    facts = facts or Facts(df, ranks=False, paired=False)
    fixed = {"object": "categorical", "bool": "categorical", "number": "numerical"}
    rows = []
    for i, f in enumerate(df.schema.fields):
        role = fixed.get(family_of(f.dataType), "other")
        if role == "numerical":
            found = facts.number[f.name]
            if found.rows and found.few is not None and len(found.few) < LOW_CARDINALITY and len(found.few) / found.rows < LOW_CARDINALITY_SHARE:
                role = "categorical"
        rows.append((i, f.name, role))
    return literal_rows(df.sparkSession, rows, "position int, column string, role string")


def split_roles(df: DataFrame, facts: Facts | None = None) -> tuple[list[str], list[str]]:
    """Names of the categorical and of the numerical columns. Later plans depend on them, so this
    one row per column does come to the driver."""
    roles = {r["column"]: r["role"] for r in column_roles(df, facts).collect()}
    return tuple([c for c in df.columns if roles[c] == k] for k in ("categorical", "numerical"))


def categorical_columns(df: DataFrame) -> DataFrame:
    """``(position, column)`` of the categorical columns."""
    return column_roles(df).where("role = 'categorical'").select("position", "column")


def numerical_columns(df: DataFrame) -> DataFrame:
    """``(position, column)`` of the numerical columns."""
    return column_roles(df).where("role = 'numerical'").select("position", "column")


def time_names(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(w in n.lower() for w in TIME_WORDS)]


def time_named_columns(
    df: DataFrame, roles: tuple[list[str], list[str]] | None = None
) -> DataFrame:
    """``(position, column)`` of columns named after dates or times; empty unless the table has at
    least two numerical columns."""
    _, numerical = roles or split_roles(df)
    found = time_names(df.columns) if len(numerical) >= 2 else []
    return literal_rows(
        df.sparkSession,
        [(df.columns.index(n), n) for n in found],
        "position int, column string",
    )


def _listed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return literal_rows(df.sparkSession, [(df.columns.index(n), n) for n in names], "position int, column string")


def date_names(df: DataFrame, facts: Facts | None = None) -> list[str]:
    """Text columns whose every known value is a date; a column without known values counts."""
    names = columns_of(df, "object")
    return [n for n in names if facts.other[n].all_dates] if facts else all_dates(df, names)


def date_parseable_columns(df: DataFrame) -> DataFrame:
    """``(position, column)`` of text columns whose every known value is a date; a column without
    known values counts."""
    return _listed(df, date_names(df))


def prose_names(df: DataFrame, facts: Facts | None = None) -> list[str]:
    """Text columns of which over half of all rows have more than three words."""
    names = columns_of(df, "object")
    if facts or not names:
        return [n for n in names if facts.other[n].prose]
    found = []
    for part in batches(names, COLUMNS_PER_SCAN):
        found += [n for n, ok in zip(part, df.selectExpr(*map(prose_sql, part)).first()) if ok]
    return found


def text_columns(df: DataFrame) -> DataFrame:
    """``(position, column)`` of prose columns: over half of all rows have more than three words.

    The test stops at the fourth word of a value, however long the value is.
    """
    return _listed(df, prose_names(df))
