"""The whole profile of a table, sharing the role decision among its parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableprofile.operators.describe import describe, quartiles_iqr, skewness
from tableprofile.operators.facts import Facts
from tableprofile.operators.frequency import describe_text, top_values, unique_counts
from tableprofile.operators.missing import missing_values
from tableprofile.operators.relations import top_correlations
from tableprofile.operators.roles import column_types, split_roles
from tableprofile.operators.selection import require_rows, sample_rows
from tableprofile.functions.columns import array_sql, columns_of, literal_rows, union_rows
from tableprofile.plans.report import feature_ideas, insights, preprocessing_suggestions


def analyze(df: DataFrame, order_by: Sequence[str], mode: str = "exact") -> dict[str, DataFrame]:
    """The parts of a profile by name.

    Facts of all columns are gathered once - one scan of the number columns, one of the others, one that
    reads the quartiles' brackets and one that counts outliers - and shared by all parts. Only first rows,
    top values and exact distinct counts read the table again. ``mode="approx"`` replaces exact quantiles
    and distinct counts by one-scan sketches.
    """
    require_rows(df)
    facts = Facts(df)
    roles = split_roles(df, facts)
    categorical, numerical = (
        literal_rows(
            df.sparkSession,
            [(df.columns.index(n), n) for n in names],
            "position int, column string",
        )
        for names in roles
    )
    has_numbers = bool(columns_of(df, "number"))
    return {
        "shape": literal_rows(df.sparkSession, [(facts.n_rows, len(df.columns))], "n_rows bigint, n_cols int"),
        "columns": column_types(df),
        "missing_values": missing_values(df, facts=facts),
        "basic_stats": describe(df, mode=mode, facts=facts) if has_numbers else describe_text(df),
        "quartiles": quartiles_iqr(df, mode=mode, facts=facts),
        "skewness": skewness(df, facts=facts),
        "top_values": top_values(df, roles=roles),
        "correlations": top_correlations(df, "profile", roles=roles, facts=facts),
        "sample_data": sample_rows(df, order_by),
        "categorical_columns": categorical,
        "numerical_columns": numerical,
        "unique_values": unique_counts(df, mode=mode),
        "insights": insights(df, mode, facts),
        "preprocessing": preprocessing_suggestions(df, roles, mode, facts),
        "feature_ideas": feature_ideas(df, roles, facts),
    }


# What of each part stands in the table of all parts: item, its number and text fields.
_ROWS = {
    "shape": ("NULL", ("n_rows", "n_cols"), ()),
    "columns": ("column", (), ("dtype",)),
    "missing_values": ("column", ("missing_count", "missing_pct"), ()),
    "basic_stats": ("column", ("count", "mean", "std", "min", "p25", "p50", "p75", "max"), ()),
    "quartiles": ("column", ("q1", "median", "q3", "iqr", "lower", "upper"), ()),
    "skewness": ("column", ("skewness",), ("direction",)),
    "top_values": ("concat(column, '#', rank)", ("n",), ("value",)),
    "correlations": ("concat(col_x, '|', col_y)", ("r",), ()),
    "categorical_columns": ("column", ("position",), ()),
    "numerical_columns": ("column", ("position",), ()),
    "unique_values": ("column", ("n_unique",), ()),
    "insights": ("concat(section, '#', seq)", (), ("text",)),
    "preprocessing": ("concat(section, '#', seq)", (), ("text",)),
    "feature_ideas": ("concat(section, '#', seq)", (), ("text",)),
}
_TEXT_STATS = ("column", ("count", "unique", "freq"), ("top",))


def profile_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """``(part, item, field, number, text)``: all parts of ``analyze`` but the first rows, as one table."""
    found = []
    for part, rows in parts.items():
        if part not in _ROWS:
            continue
        item, numbers, texts = _TEXT_STATS if part == "basic_stats" and "top" in rows.columns else _ROWS[part]
        cells = [f"named_struct('field', '{n}', 'number', CAST({n} AS DOUBLE), 'text', CAST(NULL AS STRING))" for n in numbers]
        cells += [f"named_struct('field', '{t}', 'number', CAST(NULL AS DOUBLE), 'text', CAST({t} AS STRING))" for t in texts]
        found.append(rows.selectExpr(f"'{part}' AS part", f"CAST({item} AS STRING) AS item", f"inline({array_sql(cells)})"))
    return union_rows(found)
