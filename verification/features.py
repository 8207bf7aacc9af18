"""Queries of the feature transforms and the same in SQL.

Doubles that depend on the order of sums are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprofile.features import categories, dates, missing, numbers, rows, selection, words

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "nullif(event_type, 'view') AS event_type", "CASE WHEN event_id % 7 <> 0 THEN value END AS value"
    )


_EVENTS = (
    "(SELECT event_id, user_id, nullif(event_type, 'view') AS event_type,"
    " CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    # A zero has no sign.
    made = {n: F.round(F.col(f"`{n}`"), 6) for n in names}
    return df.withColumns({n: F.when(x == 0, F.lit(0.0)).otherwise(x) for n, x in made.items()})


def impute_mean(spark, folder):
    return _rounded(missing.impute(_events(spark, folder), ["value"]), "value")


def impute_median(spark, folder):
    return _rounded(missing.impute(_events(spark, folder), ["value"], "median"), "value")


def impute_mode(spark, folder):
    return missing.impute(_events(spark, folder), ["event_type"], "mode")


def missing_indicators(spark, folder):
    return missing.missing_indicators(_events(spark, folder), ["event_type", "value"])


def drop_sparse_columns(spark, folder):
    df = _table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_totalprice END AS rare", "o_orderpriority"
    )
    return missing.drop_sparse_columns(df)


def drop_sparse_rows(spark, folder):
    df = _events(spark, folder).selectExpr("event_type", "value", "CASE WHEN user_id % 2 = 0 THEN event_id END AS event_id")
    return _rounded(missing.drop_sparse_rows(df), "value")


def standard_scale(spark, folder):
    df = _table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return _rounded(numbers.standard_scale(df, ["c_acctbal"]), "c_acctbal_scaled")


def min_max_scale(spark, folder):
    df = _table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return _rounded(numbers.min_max_scale(df, ["p_size", "p_retailprice"]), "p_size_scaled", "p_retailprice_scaled")


def power_terms(spark, folder):
    df = _table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return _rounded(numbers.power_terms(df, ["c_acctbal"]), "c_acctbal_log", "c_acctbal_sqrt", "c_acctbal_square")


def box_cox(spark, folder):
    return numbers.box_cox_exponents(_table(spark, folder, "orders"), ["o_totalprice"])


def bins_width(spark, folder):
    return numbers.bins(_events(spark, folder).select("event_id", "value"), "value", 8)


def bins_count(spark, folder):
    return numbers.bins(_table(spark, folder, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 5, "count")


def polynomial_terms(spark, folder):
    df = _table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    terms = ["l_quantity_x_l_quantity", "l_quantity_x_l_discount", "l_discount_x_l_discount"]
    return _rounded(numbers.polynomial_terms(df, ["l_quantity", "l_discount"]), *terms)


def ratio_and_difference(spark, folder):
    df = _table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    made = ["l_extendedprice_per_l_discount", "l_extendedprice_minus_l_discount"]
    return _rounded(numbers.ratio_and_difference(df, "l_extendedprice", "l_discount"), *made)


def clip_outliers(spark, folder):
    return _rounded(numbers.clip_outliers(_events(spark, folder).select("event_id", "value"), ["value"]), "value")


def date_parts(spark, folder):
    df = _table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return dates.date_parts(df, "o_orderdate").drop("o_orderdate")


def cyclical_parts(spark, folder):
    df = dates.cyclical_parts(_table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    made = [c for c in df.columns if c.startswith("o_orderdate_")]
    return _rounded(df, *made).drop("o_orderdate")


def days_since(spark, folder):
    df = _table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_shipdate", "l_shipdate + INTERVAL 30 HOURS AS later")
    df = dates.days_between(df, "l_shipdate", "later")
    return dates.days_since(df, "l_shipdate").drop("l_shipdate", "later")


def category_interaction(spark, folder):
    return categories.interaction(_events(spark, folder).select("event_id", "event_type", "user_id"), ["event_type", "user_id"])


def target_encode(spark, folder):
    df = _events(spark, folder).select("event_id", "event_type", "value")
    return _rounded(categories.target_encode(df, "event_type", "value"), "value", "event_type_target")


def target_encode_unseen(spark, folder):
    df = _events(spark, folder).select("event_id", "user_id", "value")
    made = categories.apply_target_encoding(df, "user_id", df.where("user_id % 3 <> 0"), "value")
    return _rounded(made, "value", "user_id_target")


def fold_rare(spark, folder):
    return categories.fold_rare(_table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", 0.016)


def one_hot(spark, folder):
    return categories.one_hot(_events(spark, folder).select("event_id", "event_type"), "event_type").drop("event_type")


def label_encode(spark, folder):
    return categories.label_encode(_events(spark, folder).select("event_id", "event_type"), "event_type")


def group_statistics(spark, folder):
    df = categories.group_statistics(_events(spark, folder).select("event_id", "event_type", "value"), "event_type", "value")
    return _rounded(df, *[c for c in df.columns if c.startswith("value")])


_MEASURES = ["l_quantity", "l_extendedprice"]


def principal_components(spark, folder):
    found = selection.principal_components(_table(spark, folder, "lineitem"), _MEASURES, 2)
    # The sign of a component is free but for its largest loading.
    return found.select(
        "component",
        F.round("variance", 4).alias("variance"),
        F.round("share", 8).alias("share"),
        *[F.round(F.abs(F.col("loadings")[i]), 8).alias(f"loading_{n}") for i, n in enumerate(_MEASURES)],
    )


def component_scores(spark, folder):
    df = _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_MEASURES)
    made = selection.component_scores(df, selection.fit_components(df, _MEASURES, 2))
    return made.select("l_orderkey", "l_linenumber", *[(F.round(f"component_{i}", 3) + 0.0).alias(f"component_{i}") for i in (1, 2)])


def box_cox_values(spark, folder):
    df = numbers.box_cox(_table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return _rounded(df, "o_totalprice", "o_totalprice_boxcox")


def drop_duplicate_documents(spark, folder):
    df = _table(spark, folder, "documents").select("text", "lang", "source", "n_chars")
    return rows.drop_duplicate_rows(df)


def feature_scores(spark, folder):
    found = selection.feature_scores(_table(spark, folder, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag")
    return found.select("column", F.round("information", 8).alias("information"), F.round("chi_square", 4).alias("chi_square"))


def drop_duplicate_rows(spark, folder):
    return rows.drop_duplicate_rows(_table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


def normalise_text(spark, folder):
    return words.normalise_text(_table(spark, folder, "benchmark"), "text")


def normalise_text_documents(spark, folder):
    return words.normalise_text(_table(spark, folder, "documents").select("doc_id", "text"), "text")


def text_size(spark, folder):
    return words.text_size(_table(spark, folder, "conversations"), "text").drop("text")


def bag_of_words(spark, folder):
    return words.bag_of_words(_table(spark, folder, "benchmark"), "item_id", "text")


def bag_of_words_documents(spark, folder):
    return words.bag_of_words(_table(spark, folder, "documents"), "doc_id", "text")


def tf_idf(spark, folder):
    return _rounded(words.tf_idf(_table(spark, folder, "benchmark"), "item_id", "text"), "weight")


def tf_idf_documents(spark, folder):
    return _rounded(words.tf_idf(_table(spark, folder, "documents"), "doc_id", "text"), "weight")


def drop_correlated(spark, folder):
    df = _table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_quantity * 2 + l_tax AS twice", "l_discount")
    return selection.drop_correlated(df, ["l_quantity", "twice", "l_discount"])


QUERIES: dict[str, Query] = {
    f"feature_{f.__name__}": f
    for f in (
        impute_mean, impute_median, impute_mode, missing_indicators, drop_sparse_columns, drop_sparse_rows, standard_scale,
        min_max_scale, power_terms, box_cox, bins_width, bins_count, polynomial_terms, ratio_and_difference, clip_outliers,
        date_parts, cyclical_parts, days_since, category_interaction, target_encode, target_encode_unseen, fold_rare, one_hot,
        label_encode, group_statistics, principal_components, feature_scores, drop_duplicate_rows, normalise_text, text_size,
        bag_of_words, tf_idf, drop_correlated, normalise_text_documents, bag_of_words_documents, tf_idf_documents,
        box_cox_values, component_scores, drop_duplicate_documents,
    )
}

_PLAIN = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_BAG = (
    "SELECT item_id, word, count(*) AS n FROM"
    f" (SELECT item_id, unnest(string_split({_PLAIN}, ' ')) AS word FROM benchmark) WHERE word <> '' GROUP BY item_id, word"
)
_CYCLE = (
    "SELECT o_orderkey, round(sin((month(o_orderdate) - 1) * (2 * pi() / 12)), 6) + 0 AS o_orderdate_month_sin,"
    " round(cos((month(o_orderdate) - 1) * (2 * pi() / 12)), 6) + 0 AS o_orderdate_month_cos,"
    " round(sin((isodow(o_orderdate) - 1) * (2 * pi() / 7)), 6) + 0 AS o_orderdate_weekday_sin,"
    " round(cos((isodow(o_orderdate) - 1) * (2 * pi() / 7)), 6) + 0 AS o_orderdate_weekday_cos FROM orders"
)
_SPREADS = ", ".join(
    f"{{'e': {e}::DOUBLE, 'v': var_pop({'ln(x)' if e == 0 else f'(exp({e}::DOUBLE * ln(x)) - 1) / {e}::DOUBLE'})}}"
    for e in numbers.EXPONENTS
)
# Of two columns: the covariances a, b and d, and the components in closed form, their larger loading positive.
_COMPONENTS = """
    WITH m AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice) AS b, var_samp(l_extendedprice) AS d,
                      avg(l_quantity) AS mq, avg(l_extendedprice) AS me FROM lineitem),
         e AS (SELECT *, unnest([1, 2])::INT AS i, (a + d) / 2 AS h, sqrt((a - d) * (a - d) / 4 + b * b) AS g FROM m),
         w AS (SELECT *, CASE i WHEN 1 THEN h + g ELSE h - g END AS v FROM e),
         n AS (SELECT *, CASE i WHEN 1 THEN b ELSE h + g - a END AS rx, CASE i WHEN 1 THEN h + g - a ELSE -b END AS ry FROM w),
         p AS (SELECT i, v, a, d, mq, me, rx / sqrt(rx * rx + ry * ry) * s AS x, ry / sqrt(rx * rx + ry * ry) * s AS y
               FROM (SELECT *, sign(CASE WHEN abs(rx) > abs(ry) THEN rx ELSE ry END) AS s FROM n))"""
_HOT = ", ".join(
    f"(event_type IS NOT DISTINCT FROM '{v}')::INT AS event_type_{v}" for v in ("click", "error", "purchase", "signup")
)

ORACLE: dict[str, str] = {
    "feature_impute_mean": f"""
        SELECT event_id, user_id, event_type, round(coalesce(value, (SELECT avg(value) FROM {_EVENTS})), 6) AS value
        FROM {_EVENTS}""",
    "feature_impute_median": f"""
        SELECT event_id, user_id, event_type,
               round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {_EVENTS})), 6) AS value
        FROM {_EVENTS}""",
    "feature_impute_mode": f"""
        SELECT event_id, user_id, coalesce(event_type, (
            SELECT event_type FROM {_EVENTS} WHERE event_type IS NOT NULL
            GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, value
        FROM {_EVENTS}""",
    "feature_missing_indicators": f"""
        SELECT *, (event_type IS NULL)::INT AS event_type_missing, (value IS NULL)::INT AS value_missing FROM {_EVENTS}""",
    "feature_drop_sparse_columns": "SELECT o_orderkey, o_orderpriority FROM orders",
    "feature_drop_sparse_rows": f"""
        WITH t AS (SELECT event_type, value, CASE WHEN user_id % 2 = 0 THEN event_id END AS event_id FROM {_EVENTS})
        SELECT event_type, round(value, 6) AS value, event_id FROM t
        WHERE (event_type IS NULL)::INT + (value IS NULL)::INT + (event_id IS NULL)::INT <= 1""",
    "feature_standard_scale": """
        SELECT c_custkey, c_acctbal, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6)
               AS c_acctbal_scaled FROM customer""",
    "feature_min_max_scale": """
        SELECT p_partkey, p_size, p_retailprice,
               round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS p_size_scaled,
               round((p_retailprice - min(p_retailprice) OVER ())
                     / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice_scaled
        FROM part""",
    "feature_power_terms": """
        SELECT c_custkey, c_acctbal, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS c_acctbal_log,
               round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS c_acctbal_sqrt,
               round(c_acctbal * c_acctbal, 6) AS c_acctbal_square FROM customer""",
    "feature_box_cox": f"""
        WITH t AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice > 0),
             f AS (SELECT count(*) AS n, sum(ln(x)) AS s FROM t), v AS (SELECT unnest([{_SPREADS}]) AS p FROM t)
        SELECT 'o_totalprice' AS "column", p.e AS exponent FROM f, v
        ORDER BY -0.5 * n * ln(p.v) + (p.e - 1) * s DESC LIMIT 1""",
    "feature_bins_width": f"""
        WITH t AS (SELECT event_id, value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM {_EVENTS})
        SELECT event_id, value, CASE WHEN value IS NOT NULL THEN least(floor((value - lo) * 8 / (hi - lo))::INT + 1, 8) END AS value_bin FROM t""",
    "feature_bins_count": """
        WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM part)
        SELECT p_partkey, p_retailprice, (1 + (e[1] < p_retailprice)::INT + (e[2] < p_retailprice)::INT
               + (e[3] < p_retailprice)::INT + (e[4] < p_retailprice)::INT)::INT AS p_retailprice_bin FROM part, q""",
    "feature_polynomial_terms": """
        SELECT l_orderkey, l_quantity, l_discount, round(l_quantity * l_quantity, 6) AS l_quantity_x_l_quantity,
               round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
               round(l_discount * l_discount, 6) AS l_discount_x_l_discount FROM lineitem""",
    "feature_ratio_and_difference": """
        SELECT l_orderkey, l_extendedprice, l_discount,
               round(CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END, 6) AS l_extendedprice_per_l_discount,
               round(l_extendedprice - l_discount, 6) AS l_extendedprice_minus_l_discount FROM lineitem""",
    "feature_clip_outliers": f"""
        WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM {_EVENTS})
        SELECT event_id, round(CASE WHEN value IS NOT NULL
               THEN least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)) END, 6) AS value FROM {_EVENTS}, q""",
    "feature_date_parts": """
        SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, quarter(o_orderdate)::INT AS o_orderdate_quarter,
               month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day,
               (isodow(o_orderdate) - 1)::INT AS o_orderdate_weekday FROM orders""",
    "feature_cyclical_parts": _CYCLE,
    "feature_days_since": """
        SELECT l_orderkey, date_diff('day', l_shipdate::DATE, (l_shipdate + INTERVAL 30 HOUR)::DATE)::INT AS days_l_shipdate_to_later,
               date_diff('day', l_shipdate::DATE, (SELECT max(l_shipdate) FROM lineitem)::DATE)::INT AS days_since_l_shipdate
        FROM lineitem""",
    "feature_category_interaction": f"""
        SELECT event_id, event_type, user_id, event_type || '_' || user_id::VARCHAR AS event_type_user_id FROM {_EVENTS}""",
    "feature_target_encode": f"""
        SELECT event_id, event_type, round(value, 6) AS value,
               round(avg(value) OVER (PARTITION BY event_type), 6) AS event_type_target FROM {_EVENTS}""",
    "feature_target_encode_unseen": f"""
        WITH f AS (SELECT user_id, value FROM {_EVENTS} WHERE user_id % 3 <> 0),
             m AS (SELECT user_id, avg(value) AS m FROM f GROUP BY user_id)
        SELECT event_id, t.user_id, round(t.value, 6) AS value,
               round(coalesce(m.m, (SELECT avg(value) FROM f)), 6) AS user_id_target
        FROM {_EVENTS} t LEFT JOIN m ON t.user_id = m.user_id""",
    "feature_fold_rare": """
        SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) >= 0.016 * count(*) OVER () THEN p_name ELSE 'Other' END
               AS p_name FROM part""",
    "feature_one_hot": f"SELECT event_id, {_HOT} FROM {_EVENTS}",
    "feature_label_encode": f"""
        SELECT event_id, event_type, CASE WHEN event_type IS NOT NULL
               THEN (dense_rank() OVER (ORDER BY event_type NULLS LAST) - 1)::BIGINT END AS event_type_label FROM {_EVENTS}""",
    "feature_group_statistics": f"""
        SELECT event_id, event_type, round(value, 6) AS value,
               round(avg(value) OVER w, 6) AS value_mean_by_event_type, round(median(value) OVER w, 6) AS value_median_by_event_type,
               round(min(value) OVER w, 6) AS value_min_by_event_type, round(max(value) OVER w, 6) AS value_max_by_event_type,
               round(value - avg(value) OVER w, 6) AS value_minus_mean_by_event_type
        FROM {_EVENTS} WINDOW w AS (PARTITION BY event_type)""",
    "feature_principal_components": f"""
        {_COMPONENTS} SELECT i AS component, round(v, 4) AS variance, round(v / (a + d), 8) AS share,
               round(abs(x), 8) AS loading_l_quantity, round(abs(y), 8) AS loading_l_extendedprice FROM p""",
    "feature_component_scores": f"""
        {_COMPONENTS} SELECT l_orderkey, l_linenumber,
               round((l_quantity - mq) * p1.x + (l_extendedprice - me) * p1.y, 3) + 0.0 AS component_1,
               round((l_quantity - mq) * p2.x + (l_extendedprice - me) * p2.y, 3) + 0.0 AS component_2
        FROM lineitem, (SELECT * FROM p WHERE i = 1) p1, (SELECT x, y FROM p WHERE i = 2) p2""",
    "feature_box_cox_values": f"""
        WITH t AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice > 0),
             f AS (SELECT count(*) AS n, sum(ln(x)) AS s FROM t), v AS (SELECT unnest([{_SPREADS}]) AS p FROM t),
             c AS (SELECT p.e AS e FROM f, v ORDER BY -0.5 * n * ln(p.v) + (p.e - 1) * s DESC LIMIT 1)
        SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, round(CASE WHEN o_totalprice > 0
               THEN CASE WHEN e = 0 THEN ln(o_totalprice) ELSE (pow(o_totalprice, e) - 1) / e END END, 6) AS o_totalprice_boxcox
        FROM orders, c""",
    "feature_drop_duplicate_documents": "SELECT DISTINCT text, lang, source, n_chars FROM documents",
    "feature_feature_scores": """
        WITH l AS (SELECT 'l_linestatus' AS c, l_linestatus AS v, l_returnflag AS t FROM lineitem
                   UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_returnflag FROM lineitem),
             j AS (SELECT c, v, t, count(*) AS n FROM l GROUP BY c, v, t),
             a AS (SELECT c, v, count(*) AS n FROM l GROUP BY c, v), b AS (SELECT c, t, count(*) AS n FROM l GROUP BY c, t),
             x AS (SELECT a.c, coalesce(j.n, 0)::DOUBLE AS n, a.n * b.n / sum(a.n) OVER (PARTITION BY a.c, b.t)::DOUBLE AS e,
                          sum(a.n) OVER (PARTITION BY a.c, b.t)::DOUBLE AS total
                   FROM a JOIN b USING (c) LEFT JOIN j ON j.c = a.c AND j.v = a.v AND j.t = b.t)
        SELECT c AS "column", round(sum(CASE WHEN n > 0 THEN n / total * ln(n / e) ELSE 0 END), 8) AS information,
               round(sum((n - e) * (n - e) / e), 4) AS chi_square FROM x GROUP BY c""",
    "feature_drop_duplicate_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "feature_normalise_text": f"SELECT item_id, {_PLAIN} AS text FROM benchmark",
    "feature_text_size": f"""
        SELECT conv_id, turn, role, length(text)::INT AS text_length,
               len(list_filter(string_split({_PLAIN}, ' '), lambda w: w <> ''))::INT AS text_words FROM conversations""",
    "feature_bag_of_words": _BAG,
    "feature_tf_idf": f"""
        WITH b AS ({_BAG}), d AS (SELECT word, count(*) AS k FROM b GROUP BY word)
        SELECT item_id, word, n, round(n * (ln((1 + (SELECT count(text) FROM benchmark)) / (1 + k)::DOUBLE) + 1), 6) AS weight
        FROM b JOIN d USING (word)""",
    "feature_drop_correlated": "SELECT l_orderkey, l_quantity, l_discount FROM lineitem",
}

# The same SQL over the longer, repeated texts.
ORACLE |= {
    f"feature_{name}_documents": ORACLE[f"feature_{name}"].replace("item_id", "doc_id").replace("benchmark", "documents")
    for name in ("normalise_text", "bag_of_words", "tf_idf")
}
