"""Column helpers shared by every operator: type families, missing values, text formats."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = ("number", "object", "bool", "datetime", "nested")

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType)
_DATETIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    """Column reference that is safe for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def family_of(data_type: T.DataType) -> str:
    if isinstance(data_type, _INTEGERS + _FRACTIONS + (T.DecimalType,)):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "object"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, _DATETIMES):
        return "datetime"
    return "nested"


def type_label(data_type: T.DataType) -> str:
    """Label of a type as a CSV profile shows it."""
    if isinstance(data_type, _INTEGERS):
        return "int64"
    return {
        "number": "float64",
        "object": "object",
        "bool": "bool",
        "datetime": "datetime64[ns]",
        "nested": "nested",
    }[family_of(data_type)]


def columns_of(df: DataFrame, *families: str) -> list[str]:
    """Names of the columns of the given type families, in schema order."""
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown type families: {sorted(unknown)}; choose from {FAMILIES}")
    return [f.name for f in df.schema.fields if family_of(f.dataType) in families]


def require_columns(df: DataFrame, names: Sequence[str], family: str | None = None) -> list[str]:
    """The names as a list; raises when one is absent or not of the family."""
    known = set(df.columns if family is None else columns_of(df, family))
    bad = [n for n in names if n not in known]
    if bad:
        kind = "columns" if family is None else f"{family} columns"
        raise ValueError(f"not {kind} of the table: {bad}")
    return list(names)


def position_of(df: DataFrame, name: str) -> int:
    return df.columns.index(name)


# Expressions that are needed once per column are built as SQL text: one call to the JVM each,
# where the same expression put together from Column operators takes dozens.


def quoted(name: str) -> str:
    """The name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """The value as a SQL string constant."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def missing_sql(df: DataFrame, name: str) -> str:
    """True for NULL and, in float columns, for NaN."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, _FRACTIONS):
        return f"({col} IS NULL OR isnan({col}))"
    return f"({col} IS NULL)"


def known_sql(df: DataFrame, name: str) -> str:
    """The column with NaN turned into NULL, so aggregates skip both."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, _FRACTIONS):
        return f"nanvl({quoted(name)}, CAST(NULL AS {data_type.simpleString()}))"
    return quoted(name)


def number_sql(df: DataFrame, name: str) -> str:
    """A number column as double with NaN turned into NULL."""
    value = known_sql(df, name)
    return value if df.schema[name].dataType == T.DoubleType() else f"CAST({value} AS DOUBLE)"


def head_sql(df: DataFrame, name: str) -> str:
    """The fields every row about a column starts with."""
    return f"'position', {df.columns.index(name)}, 'column', {text(name)}"


def is_missing(df: DataFrame, name: str) -> Column:
    return F.expr(missing_sql(df, name))


def known(df: DataFrame, name: str) -> Column:
    return F.expr(known_sql(df, name))


def numeric(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def array_sql(items: Iterable[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """The table with the single value of a one-row table as a column, by scalar subquery."""
    return df.select("*", row.scalar().alias(name))


def numeric_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the given number columns, as doubles without NaN."""
    return df.selectExpr(*[f"{number_sql(df, n)} AS {quoted(n)}" for n in names])


def numbered_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the given number columns, as doubles without NaN, named by their place."""
    return df.selectExpr(*[f"{number_sql(df, n)} AS c{i}" for i, n in enumerate(names)])


def fixed2(col: Column) -> Column:
    """Text with two decimals."""
    return fixed(col, 2)


def fixed(col: Column, digits: int) -> Column:
    """Text with fixed decimals and no grouping; exact ties go to the even digit."""
    return F.call_function("format_number", col, F.lit("0." + "0" * digits))


def share_pct(part: Column, total: Column) -> Column:
    """100 * part / total, NULL for an empty table."""
    return F.try_divide(part * F.lit(100.0), total)


def one_row(spark: SparkSession, *cols: Column) -> DataFrame:
    """A one-row table of the given values."""
    return spark.sql("SELECT 1 AS one").select(*cols)


def literal_sql(value) -> str:
    """A text, number, truth value, list of such or None as a SQL constant."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return text(value)
    if isinstance(value, (list, tuple)):
        return array_sql(map(literal_sql, value))
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"DOUBLE('{value}')"
    return repr(value)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A table of facts known to the driver (about one row per column), as a local relation."""
    fields = T.StructType.fromDDL(ddl).fields
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {quoted(f.name)}" for f in fields)
        return spark.sql(f"SELECT {nulls} WHERE false")
    values = ", ".join("(" + ", ".join(map(literal_sql, row)) + ")" for row in rows)
    names = [quoted(f.name) for f in fields]
    typed = ", ".join(f"CAST({n} AS {f.dataType.simpleString()}) AS {n}" for n, f in zip(names, fields))
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({', '.join(names)})")


def batches(names: Sequence[str], size: int) -> list[list[str]]:
    """The names in batches. Columns of different batches are read by different scans, so a
    columnar source is still read once; it bounds the size of each aggregate's generated code."""
    return [list(names[i : i + size]) for i in range(0, len(names), size)]


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def batched_array(df: DataFrame, items: Sequence[str], size: int) -> Column:
    """The aggregates as one array, ``size`` to a scan, each scan of the columns its aggregates need.

    One-row results enter as scalar subqueries, so this stands in a select over any one-row table.
    """
    parts = [df.selectExpr(array_sql(part) + " AS a").scalar() for part in batches(items, size)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
