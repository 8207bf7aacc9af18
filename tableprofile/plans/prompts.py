"""Profile text for a language model, prompt rows, rule answers and response checks.

No model is called here: prompts are rows to be sent elsewhere, responses come back as a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import columns_of, fixed, one_row, ref, type_label
from tableprofile.operators.describe import describe
from tableprofile.operators.facts import Facts
from tableprofile.operators.frequency import describe_text, top_values
from tableprofile.operators.missing import missing_facts
from tableprofile.operators.relations import top_correlations
from tableprofile.operators.roles import split_roles
from tableprofile.operators.selection import sample_rows
from tableprofile.plans import messages as M
from tableprofile.plans.report import Roles, fill

SAMPLE_ROWS = 5
MOST_MISSING = 3
STYLES = ("context", "profile")

TASKS = {
    "eda": (
        "Explore this table and report what stands out: what it is about, how the main variables"
        " are distributed and related, patterns and outliers, useful charts and first hypotheses."
    ),
    "feature": (
        "Recommend features to build from this table: transformations, encodings, interactions,"
        " time and text features, reduction and selection. Say why each one helps."
    ),
    "quality": (
        "Assess the data quality of this table: completeness, inconsistencies, outliers, cleaning"
        " steps and checks to put in place."
    ),
    "qa": "Answer the question about this table.",
    "memory": "Answer the question about this table in the light of the conversation so far.",
}

# Profile fields that each task's prompt shows, in order.
FIELDS = {
    "eda": ("shape", "columns_info", "missing_info", "basic_stats", "correlations", "sample_data"),
    "feature": ("shape", "columns_info", "basic_stats", "correlations"),
    "quality": ("shape", "columns_info", "missing_info", "basic_stats"),
    "qa": ("shape", "columns_info", "basic_stats"),
    "memory": ("shape", "columns_info", "basic_stats"),
}

LABELS = {
    "shape": "Size",
    "columns_info": "Columns",
    "missing_info": "Missing values",
    "basic_stats": "Statistics",
    "correlations": "Strongest correlations",
    "sample_data": "First rows",
}


def _number(col: Column) -> Column:
    return F.coalesce(fixed(col, 4), F.lit("NaN"))


def _joined(rows: DataFrame, order: str | Column, text: Column, sep: str = "\n") -> Column:
    """The text of a small table's rows in order, as one string, by scalar subquery."""
    cell = F.struct(F.col(order) if isinstance(order, str) else order, text.alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["text"])
    return rows.agg(F.concat_ws(sep, ordered).alias("text")).scalar()


def stats_text(df: DataFrame, mode: str = "exact", facts: Facts | None = None) -> Column:
    """One line of statistics per number column, or per column when there are no numbers."""
    if columns_of(df, "number"):
        pieces = [F.lit("count=")]
        labels = {
            "count": "count",
            "mean": "mean",
            "std": "std",
            "min": "min",
            "p25": "25%",
            "p50": "50%",
            "p75": "75%",
            "max": "max",
        }
        pieces = [F.col("column"), F.lit(":")]
        for i, (field, label) in enumerate(labels.items()):
            value = F.col(field).cast("string") if field == "count" else _number(F.col(field))
            pieces += [F.lit((", " if i else " ") + label + "="), value]
        return _joined(describe(df, mode=mode, facts=facts), "position", F.concat(*pieces))
    text = fill(
        "{column}: count={count}, unique={unique}, top={top}, freq={freq}",
        **{k: F.coalesce(F.col(k).cast("string"), F.lit("NaN")) for k in ("column", "count", "unique", "top", "freq")},
    )
    return _joined(describe_text(df), "position", text)


def top_values_text(df: DataFrame, roles: Roles) -> Column:
    """Per categorical column a line with its most frequent values."""
    tops = top_values(df, roles=roles)
    cell = F.struct("rank", F.concat("value", F.lit("="), F.col("n").cast("string")).alias("text"))
    per_column = tops.groupBy("position", "column").agg(
        F.concat_ws(
            ", ", F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["text"])
        ).alias("values")
    )
    return _joined(per_column, "position", F.concat("column", F.lit(" top values: "), "values"))


def missing_text(df: DataFrame, facts: Facts | None = None) -> Column:
    """One line per column with missing values, or a line that says there are none."""
    rows = F.transform(
        F.filter("columns", lambda c: c["missing_count"] > 0),
        lambda c: fill(
            M.CONTEXT["missing"],
            column=c["column"],
            count=c["missing_count"],
            pct=F.round(c["share"], 2),
        ),
    )
    text = F.when(F.size(rows) > 0, F.concat_ws("\n", rows)).otherwise(F.lit(M.CONTEXT["no_missing"]))
    return missing_facts(df, facts).select(text.alias("text")).scalar()


def correlations_text(df: DataFrame, style: str, roles: Roles | None, facts: Facts | None = None) -> Column:
    if style == "context":
        if len(columns_of(df, "number")) < 2:
            return F.lit(M.CONTEXT["no_pairs"])
        pair = fill(M.CONTEXT["pair"], x=F.col("col_x"), y=F.col("col_y"), r=fixed(F.col("r"), 3))
        found = _joined(top_correlations(df, "context", facts=facts), "rank", pair)
        return F.when(found == "", F.lit(M.CONTEXT["no_pairs"])).otherwise(found)
    if len(roles[1]) < 2:
        return F.lit(M.CONTEXT["profile_too_few"])
    pair = fill(
        M.CONTEXT["profile_pair"], x=F.col("col_x"), y=F.col("col_y"), r=fixed(F.col("r"), 4)
    )
    found = _joined(top_correlations(df, "profile", roles=roles, facts=facts), "rank", pair)
    return F.concat_ws("\n", F.lit(M.CONTEXT["profile_head"]), found)


def sample_text(df: DataFrame, order_by: Sequence[str]) -> Column:
    """A header line and the first rows as text, cells separated by bars."""
    cells = [F.coalesce(ref(c).cast("string"), F.lit("NaN")) for c in df.columns]
    rows = sample_rows(df, order_by, SAMPLE_ROWS).select(
        F.struct(*[ref(c) for c in order_by]).alias("key"), F.concat_ws(" | ", *cells).alias("line")
    )
    return F.concat_ws("\n", F.lit(" | ".join(df.columns)), _joined(rows, "key", F.col("line")))


def profile_context(
    df: DataFrame,
    order_by: Sequence[str],
    style: str = "context",
    roles: Roles | None = None,
    mode: str = "exact",
    facts: Facts | None = None,
) -> DataFrame:
    """One row: ``shape, columns_info, missing_info, basic_stats, correlations, sample_data``.

    ``order_by`` makes the first rows well defined. ``style="context"`` is the short profile (pairs
    with |r| > 0.5); ``style="profile"`` adds top values and lists the ten strongest pairs.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    facts = facts or Facts(df)
    if style == "profile":
        roles = roles or split_roles(df, facts)
    n_rows = F.lit(facts.n_rows)
    columns = "\n".join(
        M.CONTEXT["column"].format(column=f.name, dtype=type_label(f.dataType)) for f in df.schema
    )
    stats = stats_text(df, mode, facts)
    if style == "profile" and roles[0]:
        stats = F.concat_ws("\n\n", stats, top_values_text(df, roles))
    return one_row(
        df.sparkSession,
        fill(M.CONTEXT["shape"], rows=n_rows, columns=len(df.columns)).alias("shape"),
        F.lit(columns).alias("columns_info"),
        missing_text(df, facts).alias("missing_info"),
        stats.alias("basic_stats"),
        correlations_text(df, style, roles, facts).alias("correlations"),
        sample_text(df, order_by).alias("sample_data"),
    )


def _prompt(task: str, field, *tail: Column) -> Column:
    parts = [F.lit(TASKS[task])]
    parts += [F.concat(F.lit(LABELS[f] + ":\n"), field(f)) for f in FIELDS[task]]
    return F.concat_ws("\n\n", *parts, *tail)


def task_prompts(context: DataFrame) -> DataFrame:
    """``(task, prompt)`` for exploration, feature engineering and data quality."""
    rows = [
        F.struct(F.lit(t).alias("task"), _prompt(t, F.col).alias("prompt"))
        for t in ("eda", "feature", "quality")
    ]
    return context.select(F.inline(F.array(*rows)))


def question_prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    """The questions with ``task`` and ``prompt``. ``questions`` has a column ``question`` and may
    have ``history``; a question without earlier turns gets the plain prompt.

    The one-row profile is a scalar subquery, so the questions are neither joined nor shuffled.
    """
    profile = context.select(F.struct("shape", "columns_info", "basic_stats").alias("p")).scalar()
    asked = F.concat(F.lit("Question: "), F.col("question"))
    plain = _prompt("qa", profile.getField, asked)
    if "history" not in questions.columns:
        return questions.select("*", F.lit("qa").alias("task"), plain.alias("prompt"))
    past = F.concat(F.lit("Conversation so far:\n"), F.col("history"))
    first = F.coalesce(F.col("history"), F.lit("")) == ""
    return questions.select(
        "*",
        F.when(first, "qa").otherwise("memory").alias("task"),
        F.when(first, plain).otherwise(_prompt("memory", profile.getField, past, asked)).alias("prompt"),
    )


def intent_of(question: Column) -> Column:
    """The first intent with a keyword in the question, any case; else ``generic``."""
    text = F.lower(question)
    out = None
    for intent, words in M.INTENTS:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise("generic")


def answer_questions(questions: DataFrame, df: DataFrame | None) -> DataFrame:
    """The questions with ``intent`` and a rule ``answer``; without a table, a request to load one."""
    if df is None:
        return questions.select(
            "*", F.lit("no_table").alias("intent"), F.lit(M.ANSWERS["no_table"]).alias("answer")
        )
    facts = missing_facts(df).select(
        F.aggregate(
            "columns", F.lit(0).cast("bigint"), lambda a, c: a + c["missing_count"]
        ).alias("n"),
        F.transform(
            F.slice(
                F.array_sort(
                    F.transform(
                        "columns",
                        lambda c: F.struct((-c["missing_count"]).alias("k"), c["position"], c["column"]),
                    )
                ),
                1,
                MOST_MISSING,
            ),
            lambda c: F.concat(F.lit("'"), c["column"], F.lit("'")),
        ).alias("top"),
    )
    listed = F.concat(F.lit("["), F.concat_ws(", ", "top"), F.lit("]"))
    missing = facts.select(fill(M.ANSWERS["missing"], n=F.col("n"), columns=listed).alias("t")).scalar()
    answer = None
    for intent, _ in M.INTENTS:
        text = missing if intent == "missing" else F.lit(M.ANSWERS[intent])
        hit = F.col("intent") == intent
        answer = F.when(hit, text) if answer is None else answer.when(hit, text)
    return questions.withColumn("intent", intent_of(F.col("question"))).withColumn(
        "answer", answer.otherwise(F.lit(M.ANSWERS["generic"]))
    )


def long_enough(text: Column, min_chars: int) -> Column:
    """Length is tested before the text is stripped."""
    return text.isNotNull() & (F.length(text) > min_chars)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def valid_responses(responses: DataFrame, kind: str = "insight") -> DataFrame:
    """Accepted responses, stripped. ``chat``: longer than 10 characters. ``insight``: longer than
    50, and feature and quality responses only where the request's eda response is accepted too.

    ``responses`` has a column ``text``; for insights also ``request_id`` and ``task``.
    """
    if kind == "chat":
        good = responses.where(long_enough(F.col("text"), M.MIN_CHAT_CHARS))
    elif kind == "insight":
        good = responses.where(long_enough(F.col("text"), M.MIN_INSIGHT_CHARS))
        explored = good.where("task = 'eda'").select("request_id")
        good = good.join(explored, "request_id", "left_semi")
    else:
        raise ValueError("kind must be 'chat' or 'insight'")
    return good.withColumn("text", _stripped(F.col("text")))
