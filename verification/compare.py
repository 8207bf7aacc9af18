"""Run registered queries and their SQL side by side: ``python -m verification.compare [name ...]``."""

from __future__ import annotations

import datetime
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from tableprofile.sources.tables import TABLES
from verification.oracle import ORACLE
from verification.queries import QUERIES

DEFAULT_DIR = "/root/testdata/sf0.01"


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(cells, key=repr)


def difference(spark: SparkSession, con, folder: str, name: str) -> str | None:
    """What differs between the two results, or None."""
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return "a cross join in the plan"
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for column, spark_type in df.dtypes:
        if same.get(spark_type, types[column]) != types[column]:
            return f"type of {column}: {spark_type} and {types[column]}"
    left, right = _sorted(rows, df.columns), _sorted(result.fetchall(), names)
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    for a, b in zip(left, right):
        # By representation, which tells -0.0 from 0.0 and 1 from 1.0.
        if repr(a) != repr(b):
            return f"rows\n  {str(a)[:1500]}\n  {str(b)[:1500]}"
    return None


def main() -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = oracle_connection(DEFAULT_DIR)
    wrong = 0
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        if name not in ORACLE:
            found = f"no SQL; {QUERIES[name](spark, DEFAULT_DIR).count()} rows"
        else:
            try:
                found = difference(spark, con, DEFAULT_DIR, name)
            except Exception as error:  # report and go on with the next query
                found = f"{type(error).__name__}: {str(error)[:1500]}"
        wrong += found is not None
        print(f"{name}: {found or 'equal'} ({time.time() - start:.1f} s)", flush=True)
    print(f"{wrong} not equal")


if __name__ == "__main__":
    main()
