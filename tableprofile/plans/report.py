"""Findings and advice derived by rule from the profile, as rows ``(section, seq, text)``.

Each report first reduces the table to one row of facts. The lines are array expressions over that
row, so nothing but the facts is computed from the data and nothing passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import (
    array_sql,
    columns_of,
    fixed2,
    literal_rows,
    literal_sql,
    number_sql,
    one_row,
    share_pct,
    union_rows,
    with_row,
)
from tableprofile.operators.describe import (
    DIRECTION,
    OUTLIER_PCT_LIMIT,
    facts_of,
    outlier_counts,
    sample_skewness,
)
from tableprofile.operators.facts import Facts
from tableprofile.operators.frequency import HIGH_CARDINALITY_INSIGHT, high_cardinality
from tableprofile.operators.missing import missing_facts
from tableprofile.operators.relations import top_correlations
from tableprofile.operators.roles import date_names, prose_names, split_roles, time_names
from tableprofile.plans import messages as M

DETAILS = 3
LISTED_MISSING = 5
HIGH_MISSING_PCT = 50.0
MANY_NUMERICAL = 10

Roles = tuple[list[str], list[str]]


def fill(template: str, **fields) -> Column:
    """The template with its ``{name}`` fields replaced by columns or constants."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            value = fields[piece[1:-1]]
            parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def no_lines() -> Column:
    return F.array().cast("array<string>")


def lines(*texts: Column | str) -> Column:
    return F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])


def only_if(cond: Column | bool, value: Column) -> Column:
    if isinstance(cond, bool):
        return value if cond else no_lines()
    return F.when(cond, value).otherwise(no_lines())


def section(facts: DataFrame, name: str, *groups: Column) -> DataFrame:
    """One row per line of the given arrays of text, numbered from 1."""
    text = F.concat(*groups) if groups else no_lines()
    return facts.select(F.posexplode(text).alias("pos", "text")).select(
        F.lit(name).alias("section"), (F.col("pos") + 1).alias("seq"), "text"
    )


def fixed_lines(df: DataFrame, name: str, texts: Sequence[str]) -> DataFrame:
    return literal_rows(
        df.sparkSession,
        [(name, i, t) for i, t in enumerate(texts, 1)],
        "section string, seq int, text string",
    )


def as_array(rows: DataFrame, order: str, *fields: str) -> Column:
    """A table with a row per column or pair as one ordered array, by scalar subquery."""
    cell = F.struct(order, *fields)
    return rows.agg(F.array_sort(F.collect_list(cell)).alias("rows")).scalar()


def missing_insights(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Columns with missing values, the first three in detail, and what to do about them."""
    found = F.filter("columns", lambda c: c["missing_count"] > 0)
    high = F.transform(
        F.filter("columns", lambda c: c["share"] > HIGH_MISSING_PCT), lambda c: c["column"]
    )
    facts = missing_facts(df, facts).select(found.alias("found"), high.alias("high"))
    n = F.size("found")
    detail = F.transform(
        F.slice("found", 1, DETAILS),
        lambda c: fill(
            M.MISSING["column"], column=c["column"], count=c["missing_count"], pct=fixed2(c["share"])
        ),
    )
    advice = F.when(
        F.size("high") > 0,
        fill(M.MISSING["drop"], columns=F.concat_ws(", ", F.slice("high", 1, DETAILS))),
    ).otherwise(F.lit(M.MISSING["impute"]))
    some = F.concat(
        lines(fill(M.MISSING["found"], n=n)),
        detail,
        only_if(n > DETAILS, lines(fill(M.MISSING["more"], n=n - DETAILS))),
        lines(advice),
    )
    return section(
        facts,
        "Missing Values Analysis",
        F.when(n > 0, some).otherwise(lines(M.MISSING["none"])),
    )


def distribution_insights(df: DataFrame, mode: str = "exact", facts: Facts | None = None) -> DataFrame:
    """Skew and outliers of the first three number columns."""
    title = "Distribution Insights"
    numbers = columns_of(df, "number")
    if not numbers:
        return fixed_lines(df, title, [M.DISTRIBUTION["none"]])
    names = numbers[:DETAILS]
    if mode == "exact":
        known = facts_of(df, names, facts)
        skews = known.df.sparkSession.sql(f"SELECT {literal_sql([known.number[n].skewness for n in names])} AS skews")
        facts = with_row(outlier_counts(df, names, mode, known), skews.selectExpr("CAST(skews AS ARRAY<DOUBLE>)"), "skews")
    else:
        skews = df.selectExpr(array_sql(sample_skewness(number_sql(df, n)) for n in names) + " AS skews")
        facts = with_row(outlier_counts(df, names, mode), skews, "skews")
    groups = []
    for i, n in enumerate(names):
        skew, outliers = F.col("skews")[i], F.col("outliers")[i]
        direction = F.expr(DIRECTION.replace("skewness", f"skews[{i}]"))
        groups.append(
            only_if(
                direction.isNotNull(),
                lines(
                    fill(M.DISTRIBUTION["skew"], column=n, direction=direction, skew=fixed2(skew))
                ),
            )
        )
        pct = fixed2(share_pct(outliers, F.col("n_rows")))
        groups.append(
            only_if(
                outliers > 0,
                lines(fill(M.DISTRIBUTION["outliers"], column=n, count=outliers, pct=pct)),
            )
        )
    rest = len(numbers) - DETAILS
    groups.append(only_if(rest > 0, lines(fill(M.DISTRIBUTION["more"], n=rest))))
    return section(facts, title, *groups)


def correlation_insights(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Number of pairs with |r| > 0.7 and the first three in matrix order."""
    title = "Correlation Analysis"
    if len(columns_of(df, "number")) < 2:
        return fixed_lines(df, title, [M.CORRELATION["too_few"]])
    pairs = top_correlations(df, "insight", facts=facts)
    n_pairs = pairs.agg(F.count(F.lit(1)).alias("n").cast("int")).scalar()
    first = as_array(pairs.where(F.col("rank") <= DETAILS), "rank", "col_x", "col_y", "r")
    facts = one_row(df.sparkSession, n_pairs.alias("n_pairs"), first.alias("pairs"))
    n = F.col("n_pairs")
    detail = F.transform(
        F.slice("pairs", 1, DETAILS),
        lambda p: fill(
            M.CORRELATION["pair"],
            x=p["col_x"],
            y=p["col_y"],
            direction=F.when(p["r"] > 0, F.lit("positively")).otherwise(F.lit("negatively")),
            r=fixed2(p["r"]),
        ),
    )
    some = F.concat(
        lines(fill(M.CORRELATION["found"], n=n)),
        detail,
        only_if(n > DETAILS, lines(fill(M.CORRELATION["more"], n=n - DETAILS))),
        lines(M.CORRELATION["advice"]),
    )
    return section(facts, title, F.when(n > 0, some).otherwise(lines(M.CORRELATION["none"])))


def names_array(names: Sequence[str]) -> Column:
    return F.array(*map(F.lit, names)) if names else no_lines()


def feature_insights(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Date columns, categories, high cardinality and a hint at polynomial features."""
    objects, n_numbers = columns_of(df, "object"), len(columns_of(df, "number"))
    high = as_array(high_cardinality(df, "insight", facts=facts), "position", "column", "n_unique") if objects else (
        F.array().cast("array<struct<position:int,column:string,n_unique:bigint>>")
    )
    facts = one_row(df.sparkSession, names_array(date_names(df, facts)).alias("dates"), high.alias("high"))
    dates = F.size("dates")
    listed = F.concat_ws(", ", F.slice("dates", 1, DETAILS))
    detail = F.transform(
        F.slice("high", 1, HIGH_CARDINALITY_INSIGHT),
        lambda c: fill(M.FEATURES["high_column"], column=c["column"], n=c["n_unique"]),
    )
    return section(
        facts,
        "Feature Engineering Recommendations",
        only_if(
            dates > 0,
            lines(fill(M.FEATURES["dates"], n=dates, columns=listed), M.FEATURES["date_parts"]),
        ),
        only_if(
            bool(objects),
            lines(fill(M.FEATURES["categories"], n=len(objects)), M.FEATURES["encoding"]),
        ),
        only_if(F.size("high") > 0, F.concat(lines(M.FEATURES["high"]), detail)),
        only_if(1 < n_numbers < 5, lines(M.FEATURES["polynomial"])),
    )


def insights(df: DataFrame, mode: str = "exact", facts: Facts | None = None) -> DataFrame:
    """All findings: missing values, distributions, correlations, feature engineering.

    Facts are gathered once for all sections.
    """
    facts = facts or Facts(df)
    return union_rows(
        [
            missing_insights(df, facts),
            distribution_insights(df, mode, facts),
            correlation_insights(df, facts),
            feature_insights(df, facts),
        ]
    )


def preprocessing_suggestions(
    df: DataFrame, roles: Roles | None = None, mode: str = "exact", facts: Facts | None = None
) -> DataFrame:
    """Advice in the sections numerical, categorical, missing_values, outliers and general."""
    facts = facts or Facts(df, paired=False)
    roles = roles or split_roles(df, facts)
    categorical, numerical = roles
    parts = []
    if numerical:
        steps = [M.SUGGEST_NUMERICAL["found"].format(n=len(numerical)), *M.SUGGEST_NUMERICAL["steps"]]
        parts.append(fixed_lines(df, "numerical", steps))
        counts = outlier_counts(df, numerical, mode, facts)
        groups = []
        for i, n in enumerate(numerical):
            count = F.col("outliers")[i]
            pct = F.round(share_pct(count, F.col("n_rows")), 2)
            groups.append(
                only_if(
                    F.coalesce(pct > OUTLIER_PCT_LIMIT, F.lit(False)),
                    lines(fill(M.SUGGEST_OUTLIERS["column"], column=n, count=count, pct=pct)),
                )
            )
        parts.append(section(counts, "outliers", *groups))
    if categorical:
        high = as_array(
            high_cardinality(df, "advice", roles, facts).select(
                F.struct(-F.col("n_unique"), "position").alias("key"), "column", "n_unique"
            ),
            "key",
            "column",
            "n_unique",
        )
        found = one_row(df.sparkSession, high.alias("high"))
        detail = F.transform(
            "high",
            lambda c: fill(M.SUGGEST_CATEGORICAL["high_column"], column=c["column"], n=c["n_unique"]),
        )
        parts.append(
            section(
                found,
                "categorical",
                lines(M.SUGGEST_CATEGORICAL["found"].format(n=len(categorical))),
                only_if(
                    F.size("high") > 0,
                    F.concat(
                        lines(M.SUGGEST_CATEGORICAL["high"]),
                        detail,
                        lines(*M.SUGGEST_CATEGORICAL["high_steps"]),
                    ),
                ),
                lines(*M.SUGGEST_CATEGORICAL["encoding"]),
            )
        )
    found = F.transform(
        F.filter("columns", lambda c: c["missing_count"] > 0), lambda c: c["column"]
    )
    missing = missing_facts(df, facts).select(found.alias("found"))
    n = F.size("found")
    listed = F.when(
        n > LISTED_MISSING,
        fill(
            M.SUGGEST_MISSING["many"],
            columns=F.concat_ws(", ", F.slice("found", 1, LISTED_MISSING)),
        ),
    ).otherwise(fill(M.SUGGEST_MISSING["few"], columns=F.concat_ws(", ", "found")))
    parts.append(
        section(
            missing,
            "missing_values",
            only_if(
                n > 0,
                lines(
                    fill(M.SUGGEST_MISSING["found"], n=n), listed, *M.SUGGEST_MISSING["strategies"]
                ),
            ),
        )
    )
    parts.append(fixed_lines(df, "general", M.SUGGEST_GENERAL))
    return union_rows(parts)


def feature_ideas(df: DataFrame, roles: Roles | None = None, facts: Facts | None = None) -> DataFrame:
    """Feature engineering ideas that fit the table's columns."""
    categorical, numerical = roles or split_roles(df, facts)
    times = time_names(df.columns)
    facts = one_row(df.sparkSession, names_array(prose_names(df, facts)).alias("texts"))

    def block(texts, **fields):
        return lines(*[fill(t, **fields) for t in texts])

    return section(
        facts,
        "feature_ideas",
        only_if(len(numerical) >= 2, block(M.IDEAS_NUMERICAL)),
        only_if(
            len(numerical) >= 2 and bool(times), block(M.IDEAS_TIME, columns=", ".join(times))
        ),
        only_if(len(categorical) >= 2, block(M.IDEAS_CATEGORICAL)),
        only_if(bool(numerical and categorical), block(M.IDEAS_MIXED)),
        only_if(len(numerical) > MANY_NUMERICAL, block(M.IDEAS_REDUCTION)),
        only_if(
            F.size("texts") > 0, block(M.IDEAS_TEXT, columns=F.concat_ws(", ", F.col("texts")))
        ),
    )
