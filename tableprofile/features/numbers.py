"""Scaling, transformation, binning and combination of number columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import array_sql, numeric, number_sql, numeric_frame, quoted, ref, require_columns, with_row
from tableprofile.operators.quantiles import fence_row, quantile_row

#: Exponents that the power transform tries.
EXPONENTS = tuple(round(-2 + 0.1 * k, 1) for k in range(41))


def _fitted(df: DataFrame, names: Sequence[str], *aggregates: str) -> DataFrame:
    """All columns and ``__fit``: per name an array of aggregates, where ``{}`` stands for the column."""
    rows = numeric_frame(df, names).selectExpr(
        array_sql(array_sql(a.format(quoted(n)) for a in aggregates) for n in names) + " AS fit"
    )
    return with_row(df, rows, "__fit")


def standard_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns and ``<name>_scaled``: distance from the mean in population standard deviations.

    A constant column is missing throughout.
    """
    names = require_columns(df, names, "number")
    out = _fitted(df, names, "avg({})", "stddev_pop({})")
    scaled = [
        F.try_divide(numeric(df, n) - F.col("__fit")[i][0], F.col("__fit")[i][1]).alias(f"{n}_scaled")
        for i, n in enumerate(names)
    ]
    return out.select(*map(ref, df.columns), *scaled)


def min_max_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns and ``<name>_scaled``: 0 at the minimum and 1 at the maximum; missing if they are equal."""
    names = require_columns(df, names, "number")
    out = _fitted(df, names, "min({})", "max({})")
    low, high = (lambda i: F.col("__fit")[i][0]), (lambda i: F.col("__fit")[i][1])
    scaled = [F.try_divide(numeric(df, n) - low(i), high(i) - low(i)).alias(f"{n}_scaled") for i, n in enumerate(names)]
    return out.select(*map(ref, df.columns), *scaled)


def power_terms(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns and ``<name>_log`` (of 1 + x), ``<name>_sqrt`` and ``<name>_square``; missing where undefined."""
    names = require_columns(df, names, "number")
    terms = []
    for n in names:
        x = numeric(df, n)
        terms += [
            F.when(x > -1, F.log1p(x)).alias(f"{n}_log"),
            F.when(x >= 0, F.sqrt(x)).alias(f"{n}_sqrt"),
            (x * x).alias(f"{n}_square"),
        ]
    return df.select("*", *terms)


def box_cox_exponents(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column`` and ``exponent`` of highest likelihood among ``EXPONENTS``, from one scan.

    Only positive values count; the exponent is missing without two different ones. The smallest of
    equally likely exponents is taken.
    """
    names = require_columns(df, names, "number")
    cells = []
    for n in names:
        log = f"CASE WHEN {quoted(n)} > 0 THEN ln({quoted(n)}) END"
        spread = [f"var_pop({log})" if e == 0 else f"var_pop((exp({e!r}D * ({log})) - 1) / {e!r}D)" for e in EXPONENTS]
        cells.append(f"named_struct('n', count({log}), 's', sum({log}), 'v', {array_sql(spread)})")
    facts = numeric_frame(df, names).selectExpr(*[f"{c} AS c{i}" for i, c in enumerate(cells)]).first()
    rows = []
    for n, f in zip(names, facts):
        chosen = [
            (-0.5 * f["n"] * math.log(v) + (e - 1) * f["s"], -e) for e, v in zip(EXPONENTS, f["v"]) if v is not None and v > 0
        ]
        rows.append((n, -max(chosen)[1] if chosen else None))
    return df.sparkSession.createDataFrame(rows, "column string, exponent double")


def box_cox(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns and ``<name>_boxcox`` by the exponent of highest likelihood; missing unless positive."""
    exponents = {r["column"]: r["exponent"] for r in box_cox_exponents(df, names).collect()}
    terms = []
    for n in names:
        x, e = numeric(df, n), exponents[n]
        value = F.lit(None).cast("double") if e is None else F.log(x) if e == 0 else (F.pow(x, F.lit(e)) - 1) / e
        terms.append(F.when(x > 0, value).alias(f"{n}_boxcox"))
    return df.select("*", *terms)


def bins(df: DataFrame, name: str, n: int = 10, how: str = "width") -> DataFrame:
    """All columns and ``<name>_bin``, from 1 to ``n``: of equal ``width``, or of equal ``count``.

    The maximum is in the last bin. Bins of equal count end at quantiles, which belong to the lower
    bin; values that fill several bins are in the first of them. Missing values have no bin.
    """
    (name,) = require_columns(df, [name], "number")
    if how not in ("width", "count"):
        raise ValueError("how must be 'width' or 'count'")
    x = numeric(df, name)
    if how == "width":
        out = _fitted(df, [name], "min({})", "max({})")
        low, high = F.col("__fit")[0][0], F.col("__fit")[0][1]
        at = F.floor(F.try_divide((x - low) * n, high - low)).cast("int") + 1
        bin_ = F.when(x.isNotNull(), F.least(F.coalesce(at, F.lit(1)), F.lit(n)))
    else:
        edges = quantile_row(df, [name], [k / n for k in range(1, n)])
        out = with_row(df, edges, "__fit")
        bin_ = F.when(x.isNotNull(), F.size(F.filter(F.col("__fit")[0], lambda e: e < x)) + 1)
    return out.select(*map(ref, df.columns), bin_.cast("int").alias(f"{name}_bin"))


def polynomial_terms(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns, and the product of every two of ``names`` (each with itself, too) as ``<a>_x_<b>``."""
    names = require_columns(df, names, "number")
    pairs = combinations_with_replacement(names, 2)
    return df.select("*", *[(numeric(df, a) * numeric(df, b)).alias(f"{a}_x_{b}") for a, b in pairs])


def ratio_and_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """All columns, ``<a>_per_<b>`` (missing where ``b`` is zero) and ``<a>_minus_<b>``."""
    require_columns(df, [a, b], "number")
    x, y = numeric(df, a), numeric(df, b)
    return df.select("*", F.try_divide(x, y).alias(f"{a}_per_{b}"), (x - y).alias(f"{a}_minus_{b}"))


def clip_outliers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns, values of ``names`` beyond a fence set to it; missing ones stay missing."""
    names = require_columns(df, names, "number")
    out = with_row(df, fence_row(df, names), "__fit")
    clipped = {
        n: F.expr(f"CASE WHEN {number_sql(df, n)} IS NOT NULL THEN least(greatest({number_sql(df, n)}, __fit[{i}].lower), __fit[{i}].upper) END")
        for i, n in enumerate(names)
    }
    return out.select(*[clipped[c].alias(c) if c in clipped else ref(c) for c in df.columns])
