"""One query per operator over the given tables.

The tables have no missing values, so some queries blank values by a rule on the data: readings of
error events, priorities that are not specified, prices of orders that are not finished. Doubles
are rounded, since sums depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tableprofile as tp
from tableprofile.functions.columns import is_missing, ref
from tableprofile.sources.scratch import scratch_path
from verification import features

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(tp.registry(folder)[name])


def events_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "CASE WHEN event_type <> 'error' THEN value END AS value",
        "CASE WHEN value <= 50 THEN props END AS props",
    )


def orders_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice",
        "nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_day",
    )


def lineitem_with_net(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "*", "l_extendedprice * (1 - l_discount) AS net_price", "1 - l_discount AS kept_share"
    )


def events_with_total(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr("*", "user_id + value AS total")


def documents_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id", "text", "nullif(lang, 'fr') AS lang", "source", "n_chars", "int(n_chars > 1000) AS is_long"
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """A question per turn of the conversations, one kind per turn number."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id",
        "turn",
        "CASE turn % 8"
        " WHEN 0 THEN 'Which values are MISSING?'"
        " WHEN 1 THEN 'Any pattern in ' || role || ' data?'"
        " WHEN 2 THEN 'Which feature should I build?'"
        " WHEN 3 THEN 'How is it distributed?'"
        " WHEN 4 THEN 'Is there a relation between columns?'"
        " WHEN 5 THEN 'Prepare it for me'"
        " WHEN 6 THEN 'Missing pattern in the model?'"
        " ELSE text END AS question",
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as model responses: a request per conversation and three tasks in turn."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS request_id",
        "turn",
        "CASE turn % 3 WHEN 0 THEN 'eda' WHEN 1 THEN 'feature' ELSE 'quality' END AS task",
        "'  ' || CASE WHEN role = 'user' AND turn < 4 THEN role || '     ' ELSE text END || ' ' AS text",
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(ref(n), digits) + F.lit(0.0)).alias(n) if t == "double" else ref(n)
            for n, t in df.dtypes
        ]
    )


def on(name: str, operator, digits: int = 4) -> Query:
    """A query that applies an operator to a table as it is."""
    return lambda spark, folder: rounded(operator(table(spark, folder, name)), digits)


def over(source, operator, digits: int = 4) -> Query:
    return lambda spark, folder: rounded(operator(source(spark, folder)), digits)


def column_types_with_gaps(df: DataFrame) -> DataFrame:
    counts = tp.missing_values(df).select("position", "missing_count")
    return tp.column_types(df).join(counts, "position")


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with gaps, written as CSV and scanned again."""
    path = scratch_path(spark, "orders-csv")
    orders_with_gaps(spark, folder).selectExpr(
        "o_orderkey",
        "if(o_orderstatus = 'P', NULL, o_custkey) AS o_custkey",
        "o_orderstatus = 'O' AS is_open",
        "if(o_orderstatus = 'O', NULL, o_orderstatus = 'F') AS is_final",
        "o_totalprice",
        "coalesce(o_orderpriority, 'N/A') AS o_orderpriority",
        "order_day",
    ).write.csv(path, header=True)
    return rounded(tp.read_csv(spark, path))


def with_day_text(df: DataFrame, name: str) -> DataFrame:
    """The table with a time as text, which reads the same in any session."""
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd"))


def first_three_boxes(df: DataFrame) -> DataFrame:
    names = tp.columns_of(df, "number")[:3]
    out = tp.box_stats(df, names[0])
    for n in names[1:]:
        out = out.unionByName(tp.box_stats(df, n))
    return out


def eda_bundle_index(spark: SparkSession, folder: str) -> DataFrame:
    return tp.bundle_index(spark, tp.eda_bundle(table(spark, folder, "events"), "ts"))


def eda_bundle_points(spark: SparkSession, folder: str) -> DataFrame:
    points = tp.bundle_points(tp.eda_bundle(table(spark, folder, "events"), "ts"))
    return rounded(points.select("chart", "label", F.round("a", 4).alias("a"), "b"), 6)


def analyze(spark: SparkSession, folder: str) -> DataFrame:
    parts = tp.analyze(events_with_gaps(spark, folder), ["event_id"])
    return rounded(tp.profile_rows(parts))


def describe_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the rows below and up to every sketched quartile enclose its rank, but for a thousandth of the rows."""
    df = table(spark, folder, "lineitem")
    tests = []
    for row in tp.describe(df, mode="approx").collect():
        c = f"CAST({row['column']} AS DOUBLE)"
        near = [
            f"count_if({c} < {row[f]!r}D) <= {p + 0.001} * count(*) AND count_if({c} <= {row[f]!r}D) >= {p - 0.001} * count(*)"
            for f, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
        ]
        tests.append(f"named_struct('column', '{row['column']}', 'near', {' AND '.join(near)})")
    return df.selectExpr(f"array({', '.join(tests)}) AS rows").selectExpr("inline(rows)")


def unique_counts_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct counts by sketch, against the exact ones."""
    df = table(spark, folder, "documents")
    approx = tp.unique_counts(df, mode="approx").select("column", F.col("n_unique").alias("estimate"))
    exact = tp.unique_counts(df).join(approx, "column")
    return exact.select("column", "n_unique", (F.abs(F.col("estimate") - F.col("n_unique")) <= 0.15 * F.col("n_unique")).alias("near"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    history = tp.chat_history(table(spark, folder, "conversations"))
    return questions(spark, folder).join(history, ["conv_id", "turn"])


def question_prompts(spark: SparkSession, folder: str) -> DataFrame:
    context = tp.profile_context(table(spark, folder, "orders"), ["o_orderkey"])
    return tp.question_prompts(asked(spark, folder), context).select(
        "conv_id", "turn", "task", "prompt"
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return tp.answer_questions(questions(spark, folder), orders_with_gaps(spark, folder)).select(
        "conv_id", "turn", "intent", "answer"
    )


def answers_without_table(spark: SparkSession, folder: str) -> DataFrame:
    return tp.answer_questions(questions(spark, folder), None).select(
        "conv_id", "turn", "intent", "answer"
    )


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

QUERIES: dict[str, Query] = {
    # sources, selection, schema
    "csv_scan": csv_scan,
    "load_table": lambda s, f: tp.load_table(s, "supplier", tp.registry(f)),
    "require_rows": on("customer", tp.require_rows),
    "select_columns": on("lineitem", lambda d: tp.select_columns(d, ["l_orderkey", "l_tax"])),
    "select_all_columns": on("part", tp.select_columns),
    "columns_of_number": on("orders", lambda d: tp.select_columns(d, tp.columns_of(d, "number"))),
    "is_missing": over(
        events_with_gaps,
        lambda d: d.select(
            "event_id",
            is_missing(d, "value").alias("value_missing"),
            is_missing(d, "props").alias("props_missing"),
        ),
    ),
    "outlier_rows": on("documents", lambda d: tp.outlier_rows(d, "n_chars")),
    "sample_rows": on(
        "lineitem", lambda d: with_day_text(tp.sample_rows(d, LINE_KEY), "l_shipdate"), 2
    ),
    "shape": on("lineitem", tp.shape),
    "column_types": on("orders", column_types_with_gaps),
    "overview": on("orders", tp.overview),
    "column_roles": on("lineitem", tp.column_roles),
    "categorical_columns": over(documents_with_gaps, tp.categorical_columns),
    "numerical_columns": on("lineitem", tp.numerical_columns),
    "time_named_columns": on("orders", tp.time_named_columns),
    "date_parseable_columns": over(orders_with_gaps, tp.date_parseable_columns),
    "text_columns": on("documents", tp.text_columns),
    # aggregates
    "missing_values": over(events_with_gaps, tp.missing_values),
    "missing_values_present": over(orders_with_gaps, lambda d: tp.missing_values(d, "present")),
    "missing_values_sorted": over(orders_with_gaps, lambda d: tp.missing_values(d, "sorted")),
    "total_missing": over(events_with_gaps, tp.total_missing),
    "most_missing": over(orders_with_gaps, tp.most_missing),
    "describe": on("lineitem", tp.describe),
    "describe_gaps": over(events_with_gaps, tp.describe),
    "describe_text": on("part", tp.describe_text),
    "top_values": on("lineitem", tp.top_values),
    "top_values_gaps": over(orders_with_gaps, tp.top_values),
    "top_values_documents": on("documents", tp.top_values),
    "describe_text_documents": on("documents", tp.describe_text),
    "unique_counts": on("part", tp.unique_counts),
    "unique_counts_documents": on("documents", tp.unique_counts),
    "high_cardinality_advice": on("documents", tp.high_cardinality),
    "high_cardinality_insight": on("part", lambda d: tp.high_cardinality(d, "insight")),
    "quartiles_iqr": on("events", tp.quartiles_iqr),
    "outlier_summary_advice": on("documents", lambda d: tp.outlier_summary(d, "advice")),
    "outlier_summary_insight": on("events", lambda d: tp.outlier_summary(d, "insight")),
    "outlier_summary_chosen": over(
        events_with_gaps, lambda d: tp.outlier_summary(d, "chosen", ["value", "user_id"])
    ),
    "skewness": on("events", tp.skewness),
    "skewness_documents": on("documents", tp.skewness),
    "column_summary": on("lineitem", lambda d: tp.column_summary(d, "l_extendedprice")),
    # relations
    "correlation_matrix": over(
        lambda s, f: events_with_gaps(s, f).selectExpr("*", "user_id + value AS total"),
        tp.correlation_matrix,
        6,
    ),
    "top_correlations_profile": over(lineitem_with_net, tp.top_correlations, 6),
    **{
        f"top_correlations_{v}": over(
            lineitem_with_net, lambda d, v=v: tp.top_correlations(d, v), 6
        )
        for v in ("context", "insight", "heatmap", "table")
    },
    "most_correlated_pair": over(events_with_total, tp.most_correlated_pair, 6),
    "regression_line": over(
        events_with_total, lambda d: tp.regression_line(d, "total", "value"), 6
    ),
    "correlation_heatmap_lower": over(
        lineitem_with_net, lambda d: tp.correlation_heatmap(d, lower_only=True), 6
    ),
    # chart data
    "category_counts_folded": on("part", lambda d: tp.category_counts(d, "p_brand")),
    "category_counts_gaps": over(events_with_gaps, lambda d: tp.category_counts(d, "props")),
    "category_counts_few": over(
        orders_with_gaps, lambda d: tp.category_counts(d, "o_orderpriority")
    ),
    "missingness_map": over(events_with_gaps, lambda d: tp.missingness_map(d, "ts", 20), 6),
    "histogram": on("lineitem", lambda d: tp.histogram(d, "l_extendedprice")),
    "histograms_default": on("lineitem", tp.histograms),
    "histogram_auto": on("events", lambda d: tp.histogram_auto(d, "value")),
    "kde": on("events", lambda d: tp.kde(d, "value"), 8),
    "box_stats": on("events", lambda d: tp.box_stats(d, "value")),
    "box_stats_default": on("lineitem", first_three_boxes),
    "scatter_points": over(
        events_with_gaps, lambda d: tp.scatter_points(d, "user_id", "value", "event_type")
    ),
    "scatter_points_sample": on(
        "events", lambda d: tp.scatter_points(d, "user_id", "value", "event_type", 100, ["event_id"])
    ),
    "scatter_matrix_points": on(
        "lineitem", lambda d: tp.scatter_matrix_points(d, color="l_returnflag")
    ),
    "missing_bars": over(orders_with_gaps, tp.missing_bars),
    "eda_bundle": eda_bundle_index,
    "eda_bundle_points": eda_bundle_points,
    "analyze": analyze,
    "describe_approx": describe_approx,
    "unique_counts_approx": unique_counts_approx,
    # reports
    "missing_insights": over(events_with_gaps, tp.missing_insights),
    "missing_insights_high": over(orders_with_gaps, tp.missing_insights),
    "missing_insights_none": on("lineitem", tp.missing_insights),
    "distribution_insights": on("events", tp.distribution_insights),
    "distribution_insights_many": on("lineitem", tp.distribution_insights),
    "correlation_insights": over(lineitem_with_net, tp.correlation_insights),
    "correlation_insights_none": on("orders", tp.correlation_insights),
    "feature_insights": over(orders_with_gaps, tp.feature_insights),
    "insights": over(documents_with_gaps, tp.insights),
    "preprocessing_suggestions": over(documents_with_gaps, tp.preprocessing_suggestions),
    "feature_ideas": over(documents_with_gaps, tp.feature_ideas),
    "feature_ideas_time": on("orders", tp.feature_ideas),
    # conversations and prompts
    "chat_history": on("conversations", tp.chat_history),
    "chat_history_in_blocks": on("conversations", lambda df: tp.chat_history(df, 2)),
    "profile_context": on("orders", lambda d: tp.profile_context(with_day_text(d, "o_orderdate"), ["o_orderkey"])),
    "profile_context_gaps": over(
        orders_with_gaps, lambda d: tp.profile_context(d, ["o_orderkey"], "profile")
    ),
    "task_prompts": on(
        "orders", lambda d: tp.task_prompts(tp.profile_context(with_day_text(d, "o_orderdate"), ["o_orderkey"]))
    ),
    "question_prompts": question_prompts,
    "answer_questions": answers,
    "answer_questions_no_table": answers_without_table,
    "valid_responses_insight": over(responses, tp.valid_responses),
    "valid_responses_chat": over(responses, lambda d: tp.valid_responses(d, "chat")),
}

QUERIES |= features.QUERIES
