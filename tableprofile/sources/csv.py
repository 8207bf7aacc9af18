"""CSV scan that types columns from the whole file, the way data frames do."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprofile.functions.columns import quoted, text, union_rows
from tableprofile.sources.records import records

# Texts that stand for a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
BOOL_TOKENS = ("True", "TRUE", "true", "False", "FALSE", "false")
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"

UNSIGNED = "DECIMAL(20, 0)"
MAX_UNSIGNED = "18446744073709551615"

# Column for fields beyond the header's.
_SURPLUS = "\x00surplus"
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxColumns": 100_000}


def _headers(spark: SparkSession, path: str | Sequence[str]) -> tuple[bool, list[str]]:
    """Whether a line has an odd number of quotes, as where a quoted field contains a line break, and the
    different first lines of the files, all from one pass."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
    )
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    by_file = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.max(quotes % 2).alias("odd"))
    found = by_file.groupBy(F.rtrim("header", F.lit("\r")).alias("header")).agg(F.max("odd").alias("odd"), F.min("file").alias("file"))
    rows = found.orderBy("file").collect()  # a row per different header
    return any(r["odd"] for r in rows), [r["header"] for r in rows]


def _files_of(spark: SparkSession, path: str | Sequence[str], headers: Sequence[str]) -> dict[str, list[str]]:
    """The files by their first line, where these differ: a name per file comes to the driver."""
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    first = lines.groupBy("file").agg(F.rtrim(F.min_by("value", "place"), F.lit("\r")).alias("header"))
    files: dict[str, list[str]] = {h: [] for h in headers}
    for row in first.orderBy("file").toLocalIterator():
        files[row["header"]].append(row["file"])
    return files


def _names(row: Sequence[str | None]) -> list[str]:
    """Names of the columns; a repeated one, also in another case, gets a number."""
    names: list[str] = []
    taken: set[str] = set()
    for i, name in enumerate(row):
        name = name if name is not None else f"Unnamed: {i}"
        base, k = name, 0
        while name.lower() in taken:
            k += 1
            name = f"{base}.{k}"
        taken.add(name.lower())
        names.append(name)
    return names


def _raw(spark: SparkSession, path: str | Sequence[str], broken: bool) -> tuple[list[str], DataFrame]:
    """Names of the columns of files that begin alike, and all fields as text, with the first one that has
    no name in ``_SURPLUS``; ``broken`` where quoted fields contain line breaks."""
    if broken:
        found = records(spark, path)
        row = [name or None for name in next(csv.reader([found.where("first").first()["value"]]))]
    else:
        row = spark.read.csv(path, header=False, **_OPTIONS).first()
    if row is None:
        raise ValueError("no columns to read from the file")
    names = _names(row)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _SURPLUS)])
    if not broken:
        return names, spark.read.csv(path, schema=schema, header=True, **_OPTIONS)
    options = {k: str(v) for k, v in _OPTIONS.items()}
    return names, found.where("NOT first").select(F.from_csv("value", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{quoted(f.name)} STRING" for f in schema.fields)


def _typed(name: str, kind: str) -> str:
    col = quoted(name)
    if kind == "boolean":
        return f"lower({col}) = 'true' AS {col}"
    if kind == "truth text":
        return f"CASE WHEN lower({col}) = 'true' THEN 'True' WHEN {col} IS NOT NULL THEN 'False' END AS {col}"
    return f"{col}" if kind == "string" else f"CAST(trim({col}) AS {kind}) AS {col}"


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The CSV file or folder with a header row, typed from all of its values.

    Missing tokens become NULL. A column is bigint when every value is a whole number, double when
    every value is a number or when whole numbers have gaps, boolean when every row is a truth
    value, and text otherwise: dates stay text, and so do truth values with gaps. A column without
    values is double.

    Files of one folder may have their columns in different orders; other columns are an error, and
    so are rows with more fields than the header. Names that differ only by case get a number.

    Types come from one scan that collects six flags per column. Files are split among tasks, also where
    quoted fields contain line breaks (see ``records``). A line has 100,000 fields at most.
    """
    broken, headers = _headers(spark, path)
    if len(headers) <= 1:
        names, raw = _raw(spark, path, broken)
    else:
        groups = [_raw(spark, files, broken) for files in _files_of(spark, path, headers).values()]
        names = groups[0][0]
        if any(set(other) != set(names) for other, _ in groups):
            raise ValueError(f"files with different columns: {[other for other, _ in groups]}")
        raw = union_rows([part for _, part in groups])
    tokens = ", ".join(map(text, NA_TOKENS))
    columns = [quoted(n) for n in names]
    raw = raw.selectExpr(
        *[f"CASE WHEN {c} NOT IN ({tokens}) THEN {c} END AS {c}" for c in columns], quoted(_SURPLUS)
    )

    truths = ", ".join(map(text, BOOL_TOKENS))
    tests = []
    for c in columns:
        whole = f"{c} RLIKE {text(INTEGER)}"
        unsigned = f"try_cast(trim({c}) AS {UNSIGNED}) BETWEEN 0 AND {MAX_UNSIGNED}"
        tests += [
            f"bool_and({whole})",
            f"bool_and(if({whole}, try_cast(trim({c}) AS BIGINT) IS NOT NULL, NULL))",
            f"bool_and(if({whole}, coalesce({unsigned}, false), NULL))",
            f"bool_and({c} RLIKE {text(NUMBER)})",
            f"bool_and({c} IN ({truths}))",
            f"bool_or({c} IS NULL)",
        ]
    row = raw.selectExpr(*tests, f"count({quoted(_SURPLUS)})").first()
    if row[-1]:
        raise ValueError(f"{row[-1]} rows have more fields than the header")
    kinds = []
    for i in range(len(names)):
        whole, fits, unsigned, number, truth, gaps = row[6 * i : 6 * i + 6]
        if number is None:
            kinds.append("DOUBLE")
        elif whole and not gaps:
            # Whole numbers beyond both integer ranges stay text.
            kinds.append("BIGINT" if fits else UNSIGNED if unsigned else "string")
        elif number:
            kinds.append("DOUBLE")
        elif truth:
            kinds.append("truth text" if gaps else "boolean")
        else:
            kinds.append("string")
    return raw.selectExpr(*[_typed(n, k) for n, k in zip(names, kinds)])
