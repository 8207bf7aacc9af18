"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from tableprofile.plans import messages as M
from tableprofile.plans.prompts import FIELDS, LABELS, TASKS
from verification import features

LINEITEM = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)
LINE_NUMBERS = LINEITEM[:8]
# By role: l_linenumber and l_tax have few values.
LINE_NUMERICAL = [n for n in LINE_NUMBERS if n not in ("l_linenumber", "l_tax")]
NET_NUMBERS = (*LINE_NUMBERS, "net_price", "kept_share")
EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")
EVENT_NUMBERS = ("event_id", "user_id", "value")
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
GAP_ORDERS = (*ORDERS[:4], "o_orderpriority", "order_day")
PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
GAP_DOCUMENTS = (*DOCUMENTS, "is_long")

E_GAPS = (
    "(SELECT event_id, ts, user_id, event_type,"
    " CASE WHEN event_type <> 'error' THEN value END AS value,"
    " CASE WHEN value <= 50 THEN props END AS props FROM events)"
)
O_GAPS = (
    "(SELECT o_orderkey, o_custkey, o_orderstatus,"
    " CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice,"
    " nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,"
    " CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day FROM orders)"
)
L_NET = "(SELECT *, l_extendedprice * (1 - l_discount) AS net_price, 1 - l_discount AS kept_share FROM lineitem)"
E_TOTAL = "(SELECT *, user_id + value AS total FROM events)"
E_GAPS_TOTAL = f"(SELECT *, user_id + value AS total FROM {E_GAPS})"
D_GAPS = (
    "(SELECT doc_id, text, nullif(lang, 'fr') AS lang, source, n_chars,"
    " CAST(n_chars > 1000 AS INTEGER) AS is_long FROM documents)"
)
QUESTIONS = (
    "(SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'Which values are MISSING?'"
    " WHEN 1 THEN 'Any pattern in ' || role || ' data?' WHEN 2 THEN 'Which feature should I build?'"
    " WHEN 3 THEN 'How is it distributed?' WHEN 4 THEN 'Is there a relation between columns?'"
    " WHEN 5 THEN 'Prepare it for me' WHEN 6 THEN 'Missing pattern in the model?'"
    " ELSE text END AS question FROM conversations)"
)
RESPONSES = (
    "(SELECT conv_id AS request_id, turn, CASE turn % 3 WHEN 0 THEN 'eda' WHEN 1 THEN 'feature'"
    " ELSE 'quality' END AS task, '  ' || CASE WHEN role = 'user' AND turn < 4"
    " THEN role || '     ' ELSE text END || ' ' AS text FROM conversations)"
)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rnd(expr: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0"


def union(parts: Iterable[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def head(columns: Sequence[str], name: str) -> str:
    return f'CAST({columns.index(name)} AS INTEGER) AS position, {q(name)} AS "column"'


def fill(template: str, **fields: str) -> str:
    """SQL text of a message; the fields are SQL expressions."""
    parts, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(q(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(f"CAST({fields[name]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def numbered(section: str, lines: Sequence[tuple[str, str]]) -> str:
    """Report rows out of ``(condition, text)`` pairs, numbered in order."""
    rows = union(f"SELECT {i} AS o, {t} AS text WHERE {c}" for i, (c, t) in enumerate(lines))
    return (
        f"SELECT {q(section)} AS section, CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS seq,"
        f" text FROM ({rows})"
    )


# --- missing values ---


def missing(source: str, columns: Sequence[str]) -> str:
    return union(
        f"SELECT {head(columns, c)}, count(*) - count({c}) AS missing_count,"
        f" round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct,"
        f" 100.0 * (count(*) - count({c})) / count(*) AS share FROM {source}"
        for c in columns
    )


MISSING_OUT = 'position, "column", missing_count, missing_pct'


def missing_lines(source: str, columns: Sequence[str]) -> list[tuple[str, str]]:
    m = f"(SELECT *, row_number() OVER (ORDER BY position) AS k FROM ({missing(source, columns)}) WHERE missing_count > 0)"
    n = f"(SELECT count(*) FROM {m})"
    high = f"(SELECT \"column\", row_number() OVER (ORDER BY position) AS k FROM {m} WHERE share > 50)"
    high_names = f"(SELECT string_agg(\"column\", ', ' ORDER BY k) FROM {high} WHERE k <= 3)"
    lines = [(f"{n} > 0", fill(M.MISSING["found"], n=n))]
    for k in (1, 2, 3):

        def one(e, k=k):
            return f"(SELECT {e} FROM {m} WHERE k = {k})"

        lines.append(
            (
                f"{n} >= {k}",
                fill(
                    M.MISSING["column"],
                    column=one('"column"'),
                    count=one("missing_count"),
                    pct=one("printf('%.2f', share)"),
                ),
            )
        )
    lines.append((f"{n} > 3", fill(M.MISSING["more"], n=f"({n} - 3)")))
    lines.append((f"{high_names} IS NOT NULL", fill(M.MISSING["drop"], columns=high_names)))
    lines.append((f"{n} > 0 AND {high_names} IS NULL", q(M.MISSING["impute"])))
    lines.append((f"{n} = 0", q(M.MISSING["none"])))
    return lines


# --- descriptive statistics ---


def describe(source: str, columns: Sequence[str], numbers: Sequence[str]) -> str:
    return union(
        f"SELECT {head(columns, c)}, count({c}) AS count, {rnd(f'avg({c})')} AS mean,"
        f" {rnd(f'stddev_samp({c})')} AS std, {rnd(f'CAST(min({c}) AS DOUBLE)')} AS min,"
        f" {rnd(f'CAST(quantile_cont({c}, 0.25) AS DOUBLE)')} AS p25,"
        f" {rnd(f'CAST(quantile_cont({c}, 0.5) AS DOUBLE)')} AS p50,"
        f" {rnd(f'CAST(quantile_cont({c}, 0.75) AS DOUBLE)')} AS p75,"
        f" {rnd(f'CAST(max({c}) AS DOUBLE)')} AS max FROM {source}"
        for c in numbers
    )


def fences(source: str, c: str) -> str:
    """One row with quartiles and fences of a column."""
    return (
        "(SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM"
        f" (SELECT CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.5) AS DOUBLE)"
        f" AS median, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM {source}))"
    )


def quartiles(source: str, columns: Sequence[str], numbers: Sequence[str]) -> str:
    out = ", ".join(f"{rnd(k)} AS {k}" for k in ("q1", "median", "q3", "iqr", "lower", "upper"))
    return union(f"SELECT {head(columns, c)}, {out} FROM {fences(source, c)}" for c in numbers)


def outliers(source: str, columns: Sequence[str], numbers: Sequence[str]) -> str:
    return union(
        f"SELECT {head(columns, c)}, count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS outlier_count,"
        f" round(100.0 * count(*) FILTER (WHERE {c} < lower OR {c} > upper) / count(*), 2) AS outlier_pct,"
        f" 100.0 * count(*) FILTER (WHERE {c} < lower OR {c} > upper) / count(*) AS share"
        f" FROM {source}, {fences(source, c)}"
        for c in numbers
    )


OUTLIER_OUT = 'position, "column", outlier_count, outlier_pct'


def skewness(source: str, columns: Sequence[str], numbers: Sequence[str]) -> str:
    return union(
        f"SELECT {head(columns, c)}, {rnd('s')} AS skewness, CASE WHEN abs(s) > 1 THEN"
        f" CASE WHEN s > 0 THEN 'right' ELSE 'left' END END AS direction FROM"
        f" (SELECT skewness({c}) AS s FROM {source})"
        for c in numbers
    )


def distribution_lines(source: str, numbers: Sequence[str]) -> list[tuple[str, str]]:
    lines = []
    for c in numbers[:3]:
        s = f"(SELECT skewness({c}) FROM {source})"
        o = outliers(source, numbers, [c])
        count, pct = f"(SELECT outlier_count FROM ({o}))", f"(SELECT printf('%.2f', share) FROM ({o}))"
        direction = f"CASE WHEN {s} > 0 THEN 'right' ELSE 'left' END"
        lines += [
            (
                f"abs({s}) > 1",
                fill(
                    M.DISTRIBUTION["skew"], column=q(c), direction=direction, skew=f"printf('%.2f', {s})"
                ),
            ),
            (f"{count} > 0", fill(M.DISTRIBUTION["outliers"], column=q(c), count=count, pct=pct)),
        ]
    if len(numbers) > 3:
        lines.append(("true", q(M.DISTRIBUTION["more"].format(n=len(numbers) - 3))))
    return lines


# --- frequencies ---


def frequency(source: str, c: str) -> str:
    return f"(SELECT {c} AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"


def top_values(source: str, columns: Sequence[str], names: Sequence[str], k: int = 10) -> str:
    return union(
        f"SELECT {head(columns, c)}, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank,"
        f" CAST(value AS VARCHAR) AS value, n FROM {frequency(source, c)} ORDER BY n DESC, value LIMIT {k}"
        for c in names
    )


def unique(source: str, columns: Sequence[str], names: Sequence[str]) -> str:
    return union(
        f"SELECT {head(columns, c)}, count(DISTINCT {c}) AS n_unique FROM {source}" for c in names
    )


def describe_text(source: str, columns: Sequence[str], names: Sequence[str]) -> str:
    return union(
        f"SELECT {head(columns, c)}, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,"
        f" arg_min(CAST(value AS VARCHAR), (-n, value)) AS top, max(n) AS freq FROM {frequency(source, c)}"
        for c in names
    )


def categories(source: str, c: str) -> str:
    return (
        f"WITH f AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k, count(*) OVER () AS d"
        f" FROM {frequency(source, c)}),"
        f" b AS (SELECT CAST(value AS VARCHAR) AS value, n FROM f WHERE d <= 10 OR k <= 9"
        f" UNION ALL SELECT 'Other', (SELECT count(*) FROM {source}) - (SELECT sum(n) FROM f WHERE k <= 9)"
        f" WHERE (SELECT max(d) FROM f) > 10)"
        f" SELECT CAST(row_number() OVER (ORDER BY sum(n) DESC, value) AS INTEGER) AS rank, value,"
        f" CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY value"
    )


# --- correlations ---


def pairs(source: str, numbers: Sequence[str]) -> str:
    """Every pair, the earlier column as x."""
    return union(
        f"SELECT {numbers.index(a)} AS px, {numbers.index(b)} AS py, {q(a)} AS cx, {q(b)} AS cy,"
        f" corr({a}, {b}) AS c FROM {source}"
        for a, b in combinations(numbers, 2)
    )


def clean_pairs(source: str, numbers: Sequence[str]) -> str:
    return f"SELECT px, py, cx, cy, CASE WHEN isnan(c) THEN NULL ELSE c END AS c FROM ({pairs(source, numbers)})"


def ranked_pairs(
    source: str,
    numbers: Sequence[str],
    where: str,
    order: str,
    limit: int | None,
    orient: str,
) -> str:
    base = clean_pairs(source, numbers)
    there = f"SELECT px AS x, py AS y, cx AS col_x, cy AS col_y, c FROM ({base})"
    back = f"SELECT py AS x, px AS y, cy AS col_x, cx AS col_y, c FROM ({base})"
    rows = {"there": there, "back": back, "both": f"{there} UNION ALL {back}"}[orient]
    cut = "" if limit is None else f" WHERE rank <= {limit}"
    return (
        f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {order}, x, y) AS INTEGER) AS rank,"
        f" col_x, col_y, c AS r FROM ({rows}) WHERE {where}){cut}"
    )


def correlation_lines(source: str, numbers: Sequence[str]) -> list[tuple[str, str]]:
    p = f"({ranked_pairs(source, numbers, 'abs(c) > 0.7', '0', None, 'back')})"
    n = f"(SELECT count(*) FROM {p})"
    lines = [(f"{n} > 0", fill(M.CORRELATION["found"], n=n))]
    for k in (1, 2, 3):

        def one(e, k=k):
            return f"(SELECT {e} FROM {p} WHERE rank = {k})"

        lines.append(
            (
                f"{n} >= {k}",
                fill(
                    M.CORRELATION["pair"],
                    x=one("col_x"),
                    y=one("col_y"),
                    direction=one("CASE WHEN r > 0 THEN 'positively' ELSE 'negatively' END"),
                    r=one("printf('%.2f', r)"),
                ),
            )
        )
    lines += [
        (f"{n} > 3", fill(M.CORRELATION["more"], n=f"({n} - 3)")),
        (f"{n} > 0", q(M.CORRELATION["advice"])),
        (f"{n} = 0", q(M.CORRELATION["none"])),
    ]
    return lines


# --- charts ---


def binned(source: str, c: str, bins: str) -> str:
    """Equal-width bins; ``bins`` is an expression over v, the known values."""
    return (
        f"WITH d AS (SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL),"
        f" p AS (SELECT min(v) AS lo, max(v) AS hi, CAST({bins} AS BIGINT) AS bins FROM d),"
        f" w AS (SELECT *, (hi - lo) / bins AS width FROM p),"
        f" i AS (SELECT v, lo, width, bins, CAST(floor((v - lo) / width) AS BIGINT) AS i FROM d, w),"
        f" c AS (SELECT greatest(0, least(bins - 1, i + CASE WHEN v >= lo + (i + 1) * width THEN 1"
        f" WHEN v < lo + i * width THEN -1 ELSE 0 END)) AS i, count(*) AS n FROM i GROUP BY 1)"
        f" SELECT r.i + 1 AS bin, {rnd('lo + r.i * width')} AS lo,"
        f" {rnd('CASE WHEN r.i = bins - 1 THEN hi ELSE lo + (r.i + 1) * width END')} AS hi,"
        f" coalesce(n, 0) AS n FROM w, LATERAL (SELECT unnest(range(bins)) AS i) r LEFT JOIN c ON c.i = r.i"
    )


AUTO_BINS = (
    "ceil((max(v) - min(v)) / least(2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / cbrt(count(*)),"
    " (max(v) - min(v)) / (log2(count(*)) + 1)))"
)


def box(source: str, c: str) -> str:
    inside = f"{c} >= lower AND {c} <= upper"
    return (
        f'SELECT {q(c)} AS "column", '
        + ", ".join(f"{rnd(f'any_value({k})')} AS {k}" for k in ("q1", "median", "q3", "iqr"))
        + f", {rnd(f'CAST(min({c}) FILTER (WHERE {inside}) AS DOUBLE)')} AS whisker_lo,"
        f" {rnd(f'CAST(max({c}) FILTER (WHERE {inside}) AS DOUBLE)')} AS whisker_hi,"
        f" count(*) FILTER (WHERE NOT ({inside})) AS outlier_count,"
        f" round(100.0 * count(*) FILTER (WHERE NOT ({inside})) / count(*), 2) AS outlier_pct"
        f" FROM {source}, {fences(source, c)}"
    )


KDE = (
    "WITH p AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n,"
    " stddev_samp(value) * pow(count(value), -0.2) AS h FROM events),"
    " g AS (SELECT unnest(range(200)) AS i),"
    " x AS (SELECT i, lo, hi, n, h, lo - 3 * h + i * ((hi - lo + 6 * h) / 199) AS x FROM p, g)"
    " SELECT CAST(i + 1 AS INTEGER) AS point, round(any_value(x), 8) + 0.0 AS x,"
    " round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) + 0.0"
    " AS density, any_value(x >= lo AND x <= hi) AS inside FROM x, events GROUP BY i"
)

MISSING_MAP = (
    f"WITH e AS (SELECT *, epoch_us(ts) AS k FROM {E_GAPS}),"
    " p AS (SELECT min(k) AS lo, max(k) AS hi FROM e),"
    " b AS (SELECT least(20, CAST(floor((k - lo) * 20.0 / (hi - lo)) AS INTEGER) + 1) AS bucket, e.* FROM e, p) "
    + union(
        f'SELECT bucket, {q(c)} AS "column",'
        f" round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing_share"
        " FROM b GROUP BY bucket"
        for c in EVENTS
    )
)

# --- roles ---


def low_cardinality(source: str, c: str) -> str:
    return (
        f"(SELECT count(DISTINCT {c}) < 10 AND count(DISTINCT {c}) / count(*) < 0.05 FROM {source})"
    )


def roles(source: str, columns: Sequence[str], kinds: Sequence[str]) -> str:
    """``kinds``: one letter per column; n number, o object or boolean, d datetime."""
    rows = []
    for c, kind in zip(columns, kinds):
        role = {
            "n": f"CASE WHEN {low_cardinality(source, c)} THEN 'categorical' ELSE 'numerical' END",
            "o": "'categorical'",
            "d": "'other'",
        }[kind]
        rows.append(f"SELECT {head(columns, c)}, {role} AS role")
    return union(rows)


def with_role(source: str, columns: Sequence[str], kinds: Sequence[str], role: str) -> str:
    return (
        f'SELECT position, "column" FROM ({roles(source, columns, kinds)}) WHERE role = {q(role)}'
    )


DATE_PATTERNS = "['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%Y-%m-%d %H:%M:%S']"


def date_flag(source: str, c: str) -> str:
    return f"(SELECT coalesce(bool_and(try_strptime({c}, {DATE_PATTERNS}) IS NOT NULL) FILTER (WHERE {c} IS NOT NULL), true) FROM {source})"


def text_flag(source: str, c: str) -> str:
    words = f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w : w <> ''))"
    return f"(SELECT avg(CASE WHEN {words} > 3 THEN 1.0 ELSE 0.0 END) > 0.5 FROM {source})"


def flagged(columns: Sequence[str], flags: dict[str, str]) -> str:
    return union(f"SELECT {head(columns, c)} WHERE {f}" for c, f in flags.items())


def names_where(flags: dict[str, str]) -> str:
    """Names whose flag holds, in order, joined."""
    rows = union(f"SELECT {i} AS o, {q(c)} AS c WHERE {f}" for i, (c, f) in enumerate(flags.items()))
    return f"(SELECT string_agg(c, ', ' ORDER BY o) FROM ({rows}))"


def high_lines(
    found: str, template: str, most: int, order: str
) -> tuple[str, list[tuple[str, str]]]:
    h = f'(SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM ({found}) WHERE n_unique > 10)'
    n = f"(SELECT count(*) FROM {h})"
    lines = [
        (
            f"{n} >= {k}",
            fill(
                template,
                column=f'(SELECT "column" FROM {h} WHERE k = {k})',
                n=f"(SELECT n_unique FROM {h} WHERE k = {k})",
            ),
        )
        for k in range(1, most + 1)
    ]
    return n, lines


def feature_lines(
    source: str, columns: Sequence[str], objects: Sequence[str], n_numbers: int
) -> list[tuple[str, str]]:
    dates = {c: date_flag(source, c) for c in objects}
    count = "(" + " + ".join(f"CAST({f} AS INTEGER)" for f in dates.values()) + ")"
    listed = names_where(dates)
    lines = [
        (f"{count} > 0", fill(M.FEATURES["dates"], n=count, columns=listed)),
        (f"{count} > 0", q(M.FEATURES["date_parts"])),
        ("true", q(M.FEATURES["categories"].format(n=len(objects)))),
        ("true", q(M.FEATURES["encoding"])),
    ]
    n, high = high_lines(
        unique(source, columns, objects), M.FEATURES["high_column"], 2, "position"
    )
    lines += [(f"{n} > 0", q(M.FEATURES["high"])), *high]
    if 1 < n_numbers < 5:
        lines.append(("true", q(M.FEATURES["polynomial"])))
    return lines


D_OBJECTS = ("text", "lang", "source")


def suggestions(
    source: str = D_GAPS,
    columns: Sequence[str] = GAP_DOCUMENTS,
    numerical: Sequence[str] = ("doc_id", "n_chars"),
    categorical: Sequence[str] = (*D_OBJECTS, "is_long"),
) -> str:
    """Advice for a table whose roles are known."""
    always = "true"
    parts = [
        numbered(
            "numerical",
            [(always, q(M.SUGGEST_NUMERICAL["found"].format(n=len(numerical))))]
            + [(always, q(t)) for t in M.SUGGEST_NUMERICAL["steps"]],
        )
    ]
    out = outliers(source, columns, numerical)
    parts.append(
        numbered(
            "outliers",
            [
                (
                    f"(SELECT outlier_pct > 5 FROM ({out}) WHERE \"column\" = {q(c)})",
                    fill(
                        M.SUGGEST_OUTLIERS["column"],
                        column=q(c),
                        count=f"(SELECT outlier_count FROM ({out}) WHERE \"column\" = {q(c)})",
                        pct=f"(SELECT outlier_pct FROM ({out}) WHERE \"column\" = {q(c)})",
                    ),
                )
                for c in numerical
            ],
        )
    )
    n, high = high_lines(
        unique(source, columns, categorical),
        M.SUGGEST_CATEGORICAL["high_column"],
        5,
        "n_unique DESC, position",
    )
    parts.append(
        numbered(
            "categorical",
            [
                (always, q(M.SUGGEST_CATEGORICAL["found"].format(n=len(categorical)))),
                (f"{n} > 0", q(M.SUGGEST_CATEGORICAL["high"])),
                *high,
                *[(f"{n} > 0", q(t)) for t in M.SUGGEST_CATEGORICAL["high_steps"]],
                *[(always, q(t)) for t in M.SUGGEST_CATEGORICAL["encoding"]],
            ],
        )
    )
    flags = {c: f"(SELECT count(*) > count({c}) FROM {source})" for c in columns}
    k = "(" + " + ".join(f"CAST({f} AS INTEGER)" for f in flags.values()) + ")"
    parts.append(
        numbered(
            "missing_values",
            [
                (f"{k} > 0", fill(M.SUGGEST_MISSING["found"], n=k)),
                (f"{k} > 0", fill(M.SUGGEST_MISSING["few"], columns=names_where(flags))),
                *[(f"{k} > 0", q(t)) for t in M.SUGGEST_MISSING["strategies"]],
            ],
        )
    )
    parts.append(numbered("general", [(always, q(t)) for t in M.SUGGEST_GENERAL]))
    return union(parts)


def ideas(blocks: Sequence[tuple[str, Sequence[str], str]]) -> str:
    """Blocks of ``(condition, lines, joined column names)``."""
    lines = [(c, fill(t, columns=names)) for c, texts, names in blocks for t in texts]
    return numbered("feature_ideas", lines)


# --- prompts ---


def joined(rows: str, text: str, order: str) -> str:
    return f"(SELECT string_agg({text}, chr(10) ORDER BY {order}) FROM ({rows}))"


def stats_text(source: str, columns: Sequence[str], numbers: Sequence[str]) -> str:
    rows = union(
        f"SELECT {head(columns, c)}, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,"
        f" CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25,"
        f" CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75,"
        f" CAST(max({c}) AS DOUBLE) AS max FROM {source}"
        for c in numbers
    )
    text = "\"column\" || ': count=' || count"
    labels = {"mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}
    for field, label in labels.items():
        text += f" || ', {label}=' || printf('%.4f', {field})"
    return joined(rows, text, "position")


def sample_text(source: str, columns: Sequence[str], key: str) -> str:
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NaN')" for c in columns)
    rows = f"SELECT {key} AS k, concat_ws(' | ', {cells}) AS line FROM {source} ORDER BY {key} LIMIT 5"
    return f"({q(' | '.join(columns))} || chr(10) || {joined(rows, 'line', 'k')})"


O_DAYS = "(SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders)"
_TYPES = {
    "o_orderkey": "int64",
    "o_custkey": "int64",
    "o_orderstatus": "object",
    "o_totalprice": "float64",
    "o_orderpriority": "object",
    "order_day": "object",
    "o_orderdate": "datetime64[ns]",
}


def columns_text(columns: Sequence[str], types: dict[str, str] = _TYPES) -> str:
    return q("\n".join(M.CONTEXT["column"].format(column=c, dtype=types[c]) for c in columns))


def shape_text(source: str, columns: Sequence[str]) -> str:
    return fill(M.CONTEXT["shape"], rows=f"(SELECT count(*) FROM {source})", columns=str(len(columns)))


def context(source: str, types: dict[str, str] = _TYPES) -> str:
    """The short profile of orders, which have no gaps and no strong pair."""
    columns = ORDERS
    return (
        f"SELECT {shape_text('orders', columns)} AS shape, {columns_text(columns, types)} AS columns_info,"
        f" {q(M.CONTEXT['no_missing'])} AS missing_info,"
        f" {stats_text('orders', columns, ORDER_NUMBERS)} AS basic_stats,"
        f" {q(M.CONTEXT['no_pairs'])} AS correlations,"
        f" {sample_text(source, columns, 'o_orderkey')} AS sample_data"
    )


def gap_context() -> str:
    """The long profile of the orders with gaps."""
    m = missing(O_GAPS, GAP_ORDERS)
    line = fill(M.CONTEXT["missing"], column='"column"', count="missing_count", pct="missing_pct")
    tops = top_values(O_GAPS, GAP_ORDERS, ["o_orderstatus", "o_orderpriority", "order_day"])
    tops = (
        'SELECT position, "column", string_agg(value || \'=\' || n, \', \' ORDER BY rank) AS v'
        f' FROM ({tops}) GROUP BY position, "column"'
    )
    top_text = joined(tops, "\"column\" || ' top values: ' || v", "position")
    stats = stats_text(O_GAPS, GAP_ORDERS, ORDER_NUMBERS)
    ranked = ranked_pairs(
        O_GAPS, ORDER_NUMBERS, "c IS NOT NULL", "round(abs(c), 12) DESC", 10, "there"
    )
    pair = fill(M.CONTEXT["profile_pair"], x="col_x", y="col_y", r="printf('%.4f', r)")
    return (
        f"SELECT {shape_text(O_GAPS, GAP_ORDERS)} AS shape, {columns_text(GAP_ORDERS)} AS columns_info,"
        f" {joined(f'SELECT * FROM ({m}) WHERE missing_count > 0', line, 'position')} AS missing_info,"
        f" {stats} || chr(10) || chr(10) || {top_text} AS basic_stats,"
        f" {q(M.CONTEXT['profile_head'])} || chr(10) || {joined(ranked, pair, 'rank')} AS correlations,"
        f" {sample_text(O_GAPS, GAP_ORDERS, 'o_orderkey')} AS sample_data"
    )


def prompt(task: str, *tail: str) -> str:
    gap = " || chr(10) || chr(10) || "
    parts = [q(TASKS[task])] + [f"{q(LABELS[f] + ':')} || chr(10) || {f}" for f in FIELDS[task]]
    return gap.join([*parts, *tail])


HISTORY = (
    "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id"
    " ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations"
)


def question_prompts() -> str:
    asked = "'Question: ' || question"
    past = "'Conversation so far:' || chr(10) || history"
    return (
        f"SELECT conv_id, turn, CASE WHEN history = '' THEN 'qa' ELSE 'memory' END AS task,"
        f" CASE WHEN history = '' THEN {prompt('qa', asked)} ELSE {prompt('memory', past, asked)} END AS prompt"
        f" FROM {QUESTIONS} JOIN ({HISTORY}) USING (conv_id, turn), ({context('orders')})"
    )


def answers() -> str:
    intents = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(question), {q(w)})" for w in words) + f" THEN {q(i)}"
        for i, words in M.INTENTS
    )
    m = missing(O_GAPS, GAP_ORDERS)
    top = f"SELECT * FROM ({m}) ORDER BY missing_count DESC, position LIMIT 3"
    listed = f"(SELECT '[' || string_agg('''' || \"column\" || '''', ', ' ORDER BY missing_count DESC, position) || ']' FROM ({top}))"
    total = f"(SELECT CAST(sum(missing_count) AS BIGINT) FROM ({m}))"
    texts = " ".join(
        f"WHEN {q(i)} THEN "
        + (fill(M.ANSWERS[i], n=total, columns=listed) if i == "missing" else q(M.ANSWERS[i]))
        for i, _ in M.INTENTS
    )
    return (
        f"SELECT conv_id, turn, intent, CASE intent {texts} ELSE {q(M.ANSWERS['generic'])} END AS answer FROM"
        f" (SELECT conv_id, turn, CASE {intents} ELSE 'generic' END AS intent FROM {QUESTIONS})"
    )


def bundle() -> str:
    """Charts of the events and the size of each, by the rules of the standard set."""
    kinds = "ndnono"
    numerical = f"(SELECT list(\"column\" ORDER BY position) FROM ({with_role('events', EVENTS, kinds, 'numerical')}))"
    categorical = f"(SELECT list(\"column\" ORDER BY position) FROM ({with_role('events', EVENTS, kinds, 'categorical')}))"
    charts = [
        (
            "true",
            "'missing_values_heatmap'",
            "(SELECT count(DISTINCT least(100, floor((epoch_us(ts) - lo) * 100.0 / (hi - lo)) + 1)) FROM events,"
            f" (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)) * {len(EVENTS)}",
        )
    ]
    for c in EVENT_NUMBERS:
        used = f"list_position({numerical}, {q(c)}) <= 5"
        bins = f"(SELECT CAST({AUTO_BINS} AS BIGINT) FROM (SELECT {c} AS v FROM events))"
        charts += [(used, q(f"distribution_{c}"), bins), (used, q(f"density_{c}"), "200")]
    charts.append(
        ("true", "'correlation_heatmap'", f"len({numerical}) * (len({numerical}) - 1) // 2")
    )
    for c in EVENTS:
        used = f"list_position({categorical}, {q(c)}) <= 5"
        bars = f"(SELECT least(10, count(DISTINCT {c})) FROM events)"
        charts.append((used, q(f"categorical_{c}"), bars))
    charts.append((f"len({numerical}) >= 2", "'scatter_plot'", "(SELECT count(*) FROM events)"))
    charts.append((f"len({numerical}) >= 2", "'scatter_line'", "1"))
    rows = union(
        f"SELECT {i} AS o, {name} AS chart, CAST({n} AS BIGINT) AS n_rows WHERE {used}"
        for i, (used, name, n) in enumerate(charts)
    )
    return (
        "SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS seq, chart, n_rows"
        f" FROM ({rows})"
    )


def bundle_points() -> str:
    """What the charts of the events show; both categories and all number columns are in the standard set."""
    parts = [
        f"SELECT 'missing_values_heatmap' AS chart, c AS label, CAST(b AS DOUBLE) AS a, 0.0 AS b FROM"
        " (SELECT DISTINCT least(100, CAST(floor((epoch_us(ts) - lo) * 100.0 / (hi - lo)) AS INTEGER) + 1) AS b FROM events,"
        " (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)), (SELECT unnest(["
        + ", ".join(map(q, EVENTS))
        + "]) AS c)"
    ]
    for c in EVENT_NUMBERS:
        parts.append(f"SELECT {q('distribution_' + c)}, NULL, lo, CAST(n AS DOUBLE) FROM ({binned('events', c, AUTO_BINS)})")
        density = (
            f"WITH p AS (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n,"
            f" stddev_samp({c}) * pow(count({c}), -0.2) AS h FROM events),"
            " x AS (SELECT i, n, h, lo + i * ((hi - lo) / 199) AS x FROM p, (SELECT unnest(range(200)) AS i))"
            f" SELECT {q('density_' + c)}, NULL, any_value(x), round(sum(exp(-0.5 * pow((x - {c}) / h, 2)))"
            " / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0.0 FROM x, events GROUP BY i"
        )
        parts.append(density)
    parts.append(
        f"SELECT 'correlation_heatmap', cy || '|' || cx, NULL, round(c, 6) + 0.0 FROM ({clean_pairs('events', EVENT_NUMBERS)})"
    )
    for c in ("event_type", "props"):
        parts.append(f"SELECT {q('categorical_' + c)}, value, CAST(rank AS DOUBLE), CAST(n AS DOUBLE) FROM ({categories('events', c)})")
    best = ranked_pairs("events", EVENT_NUMBERS, "c IS NOT NULL", "round(abs(c), 12) DESC", 1, "back")
    for x, y in combinations(EVENT_NUMBERS, 2):
        chosen = f"(SELECT col_x = {q(y)} AND col_y = {q(x)} FROM ({best}))"
        parts.append(f"SELECT 'scatter_plot', NULL, CAST({y} AS DOUBLE), CAST({x} AS DOUBLE) FROM events WHERE {chosen}")
        parts.append(
            f"SELECT 'scatter_line', {q(y + '|' + x)}, round(s, 6) + 0.0, round(i, 6) + 0.0 FROM"
            f" (SELECT regr_slope({x}, {y}) AS s, regr_intercept({x}, {y}) AS i FROM events) WHERE {chosen}"
        )
    return f"SELECT chart, label, round(a, 4) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM ({union(parts)})"


def analysis() -> str:
    """All parts of the profile of the events with gaps, in long form."""

    def numbers(part: str, item: str, fields: Sequence[str], rows: str) -> list[str]:
        return [
            f"SELECT {q(part)} AS part, CAST({item} AS VARCHAR) AS item, {q(f)} AS field,"
            f" round(CAST({f} AS DOUBLE), 4) + 0.0 AS number, CAST(NULL AS VARCHAR) AS text FROM ({rows})"
            for f in fields
        ]

    def texts(part: str, item: str, field: str, rows: str) -> str:
        return (
            f"SELECT {q(part)}, CAST({item} AS VARCHAR), {q(field)}, CAST(NULL AS DOUBLE), CAST({field} AS VARCHAR) FROM ({rows})"
        )

    s, categories_, numerical, kinds = E_GAPS, ["event_type", "props"], EVENT_NUMBERS, "ndnono"
    types = dict(zip(EVENTS, ("int64", "datetime64[ns]", "int64", "object", "float64", "object")))
    dtypes = union(f"SELECT {q(c)} AS \"column\", {q(t)} AS dtype" for c, t in types.items())
    top = top_values(s, EVENTS, categories_)
    pairs_ = ranked_pairs(s, numerical, "c IS NOT NULL", "round(abs(c), 12) DESC", 10, "there")
    found = [
        *numbers("shape", "NULL", ["n_rows", "n_cols"], f"SELECT count(*) AS n_rows, {len(EVENTS)} AS n_cols FROM {s}"),
        texts("columns", '"column"', "dtype", dtypes),
        *numbers("missing_values", '"column"', ["missing_count", "missing_pct"], missing(s, EVENTS)),
        *numbers(
            "basic_stats", '"column"', ["count", "mean", "std", "min", "p25", "p50", "p75", "max"], describe(s, EVENTS, numerical)
        ),
        *numbers("quartiles", '"column"', ["q1", "median", "q3", "iqr", "lower", "upper"], quartiles(s, EVENTS, numerical)),
        *numbers("skewness", '"column"', ["skewness"], skewness(s, EVENTS, numerical)),
        texts("skewness", '"column"', "direction", skewness(s, EVENTS, numerical)),
        *numbers("top_values", "\"column\" || '#' || rank", ["n"], top),
        texts("top_values", "\"column\" || '#' || rank", "value", top),
        *numbers("correlations", "col_x || '|' || col_y", ["r"], pairs_),
        *[
            x
            for role in ("categorical", "numerical")
            for x in numbers(f"{role}_columns", '"column"', ["position"], with_role(s, EVENTS, kinds, role))
        ],
        *numbers("unique_values", '"column"', ["n_unique"], unique(s, EVENTS, EVENTS)),
    ]
    insights_ = union(
        [
            numbered("Missing Values Analysis", missing_lines(s, EVENTS)),
            numbered("Distribution Insights", distribution_lines(s, numerical)),
            numbered("Correlation Analysis", correlation_lines(s, numerical)),
            numbered("Feature Engineering Recommendations", feature_lines(s, EVENTS, categories_, 3)),
        ]
    )
    advice = suggestions(s, EVENTS, numerical, categories_)
    thoughts = ideas(
        [
            ("true", M.IDEAS_NUMERICAL, NO_TIME),
            ("true", M.IDEAS_CATEGORICAL, NO_TIME),
            ("true", M.IDEAS_MIXED, NO_TIME),
            *[
                (f"{names_where({c: text_flag(s, c) for c in categories_})} IS NOT NULL", M.IDEAS_TEXT, names_where({c: text_flag(s, c) for c in categories_}))
            ],
        ]
    )
    for part, rows in (("insights", insights_), ("preprocessing", advice), ("feature_ideas", thoughts)):
        found.append(texts(part, "section || '#' || seq", "text", rows))
    return f"SELECT part, item, field, number, text FROM ({union(found)})"


STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text"

PART_OBJECTS = ("p_name", "p_brand", "p_type")
NO_TIME = "''"

ORACLE: dict[str, str] = {
    "csv_scan": (
        "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS DOUBLE) END AS o_custkey,"
        " o_orderstatus = 'O' AS is_open, CASE WHEN o_orderstatus <> 'O' THEN"
        " CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END END AS is_final,"
        f" o_totalprice, o_orderpriority, order_day FROM {O_GAPS}"
    ),
    "load_table": "SELECT * FROM supplier",
    "require_rows": "SELECT * FROM customer",
    "select_columns": "SELECT l_orderkey, l_tax FROM lineitem",
    "select_all_columns": "SELECT * FROM part",
    "columns_of_number": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "is_missing": (
        "SELECT event_id, value IS NULL AS value_missing, props IS NULL AS props_missing"
        f" FROM {E_GAPS}"
    ),
    "outlier_rows": (
        f"SELECT documents.* FROM documents, {fences('documents', 'n_chars')}"
        " WHERE n_chars < lower OR n_chars > upper"
    ),
    "sample_rows": (
        f"SELECT {', '.join(LINEITEM[:10])}, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem"
        " ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 5"
    ),
    "shape": "SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols FROM lineitem",
    "column_types": union(
        f"SELECT {head(ORDERS, c)}, {q(_TYPES[c])} AS dtype, count(*) - count({c}) AS missing_count FROM orders"
        for c in ORDERS
    ),
    "overview": (
        "SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_cols, CAST(3 AS INTEGER) AS n_number,"
        " CAST(2 AS INTEGER) AS n_object, CAST(1 AS INTEGER) AS n_datetime FROM orders"
    ),
    "column_roles": roles("lineitem", LINEITEM, "nnnnnnnnood"),
    "categorical_columns": with_role(D_GAPS, GAP_DOCUMENTS, "nooonn", "categorical"),
    "numerical_columns": with_role("lineitem", LINEITEM, "nnnnnnnnood", "numerical"),
    "time_named_columns": (
        f"SELECT {head(ORDERS, 'o_orderdate')} WHERE (SELECT count(*) FROM"
        f" ({with_role('orders', ORDERS, 'nnondo', 'numerical')})) >= 2"
    ),
    "date_parseable_columns": flagged(
        GAP_ORDERS,
        {c: date_flag(O_GAPS, c) for c in ("o_orderstatus", "o_orderpriority", "order_day")},
    ),
    "text_columns": flagged(DOCUMENTS, {c: text_flag("documents", c) for c in D_OBJECTS}),
    "missing_values": f"SELECT {MISSING_OUT} FROM ({missing(E_GAPS, EVENTS)})",
    "missing_values_present": f"SELECT {MISSING_OUT} FROM ({missing(O_GAPS, GAP_ORDERS)}) WHERE missing_count > 0",
    "missing_values_sorted": f"SELECT {MISSING_OUT} FROM ({missing(O_GAPS, GAP_ORDERS)}) WHERE missing_count > 0",
    "total_missing": f"SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing FROM ({missing(E_GAPS, EVENTS)})",
    "most_missing": (
        "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY missing_count DESC, position) AS INTEGER) AS rank,"
        f' "column", missing_count FROM ({missing(O_GAPS, GAP_ORDERS)})) WHERE rank <= 3'
    ),
    "describe": describe("lineitem", LINEITEM, LINE_NUMBERS),
    "describe_gaps": describe(E_GAPS, EVENTS, EVENT_NUMBERS),
    "describe_text": describe_text("part", PART, PART_OBJECTS),
    "top_values": top_values(
        "lineitem", LINEITEM, ["l_linenumber", "l_tax", "l_returnflag", "l_linestatus"]
    ),
    "top_values_gaps": top_values(
        O_GAPS, GAP_ORDERS, ["o_orderstatus", "o_orderpriority", "order_day"]
    ),
    "top_values_documents": top_values("documents", DOCUMENTS, D_OBJECTS),
    "describe_text_documents": describe_text("documents", DOCUMENTS, D_OBJECTS),
    "unique_counts": unique("part", PART, PART),
    "unique_counts_documents": unique("documents", DOCUMENTS, DOCUMENTS),
    "high_cardinality_advice": (
        f"SELECT * FROM ({unique('documents', DOCUMENTS, D_OBJECTS)}) WHERE n_unique > 10"
        " ORDER BY n_unique DESC, position LIMIT 5"
    ),
    "high_cardinality_insight": (
        f"SELECT * FROM ({unique('part', PART, PART_OBJECTS)}) WHERE n_unique > 10"
        " ORDER BY position LIMIT 2"
    ),
    "quartiles_iqr": quartiles("events", EVENTS, EVENT_NUMBERS),
    "outlier_summary_advice": (
        f"SELECT {OUTLIER_OUT} FROM ({outliers('documents', DOCUMENTS, ['doc_id', 'n_chars'])})"
        " WHERE outlier_pct > 5"
    ),
    "outlier_summary_insight": (
        f"SELECT {OUTLIER_OUT} FROM ({outliers('events', EVENTS, EVENT_NUMBERS)}) WHERE outlier_count > 0"
    ),
    "outlier_summary_chosen": f"SELECT {OUTLIER_OUT} FROM ({outliers(E_GAPS, EVENTS, ['value', 'user_id'])})",
    "skewness": skewness("events", EVENTS, EVENT_NUMBERS),
    "skewness_documents": skewness("documents", DOCUMENTS, ["doc_id", "n_chars"]),
    "column_summary": (
        'SELECT "column", mean, p50 AS median, std, min, max FROM'
        f" ({describe('lineitem', LINEITEM, ['l_extendedprice'])})"
    ),
    "correlation_matrix": (
        "WITH p AS ("
        + clean_pairs(E_GAPS_TOTAL, (*EVENT_NUMBERS, "total"))
        + "), b AS (SELECT px, py, cx, cy, c FROM p UNION ALL SELECT py, px, cy, cx, c FROM p UNION ALL "
        + union(
            f"SELECT {i} AS px, {i} AS py, {q(c)} AS cx, {q(c)} AS cy,"
            f" CASE WHEN stddev_samp({c}) > 0 THEN 1.0 END AS c FROM {E_GAPS_TOTAL}"
            for i, c in enumerate((*EVENT_NUMBERS, "total"))
        )
        + ") SELECT CAST(px AS INTEGER) AS pos_x, CAST(py AS INTEGER) AS pos_y, cx AS col_x, cy AS col_y,"
        " round(CAST(c AS DOUBLE), 6) + 0.0 AS r FROM b"
    ),
    "most_correlated_pair": (
        "SELECT col_x, col_y, round(r, 6) + 0.0 AS r FROM ("
        + ranked_pairs(
            E_TOTAL, (*EVENT_NUMBERS, "total"), "c IS NOT NULL", "round(abs(c), 12) DESC", 1, "back"
        )
        + ")"
    ),
    "regression_line": (
        "SELECT 'total' AS col_x, 'value' AS col_y, CAST(regr_count(value, total) AS BIGINT) AS n,"
        " round(regr_slope(value, total), 6) + 0.0 AS slope, round(regr_intercept(value, total), 6) + 0.0"
        f" AS intercept, round(corr(value, total), 6) + 0.0 AS r FROM {E_TOTAL}"
    ),
    "correlation_heatmap_lower": (
        "SELECT CAST(py AS INTEGER) AS pos_x, CAST(px AS INTEGER) AS pos_y, cy AS col_x, cx AS col_y,"
        f" round(c, 6) + 0.0 AS r FROM ({clean_pairs(L_NET, NET_NUMBERS)})"
    ),
    "category_counts_folded": categories("part", "p_brand"),
    "category_counts_gaps": categories(E_GAPS, "props"),
    "category_counts_few": categories(O_GAPS, "o_orderpriority"),
    "missingness_map": MISSING_MAP,
    "histogram": binned("lineitem", "l_extendedprice", "30"),
    "histograms_default": union(
        f'SELECT *, {q(c)} AS "column" FROM ({binned("lineitem", c, "30")})' for c in LINE_NUMBERS[:3]
    ),
    "histogram_auto": binned("events", "value", AUTO_BINS),
    "kde": KDE,
    "box_stats": box("events", "value"),
    "box_stats_default": union(box("lineitem", c) for c in LINE_NUMBERS[:3]),
    "scatter_points": (
        f"SELECT CAST(user_id AS DOUBLE) AS x, value AS y, event_type AS color FROM {E_GAPS}"
        " WHERE value IS NOT NULL"
    ),
    "scatter_points_sample": (
        "SELECT CAST(user_id AS DOUBLE) AS x, value AS y, event_type AS color FROM events"
        " ORDER BY md5(CAST(event_id AS VARCHAR)), user_id, value LIMIT 100"
    ),
    "scatter_matrix_points": (
        "SELECT "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LINE_NUMBERS[:4])
        + ", l_returnflag AS color FROM lineitem"
    ),
    "missing_bars": f"SELECT {MISSING_OUT} FROM ({missing(O_GAPS, GAP_ORDERS)}) WHERE missing_count > 0",
    "eda_bundle": bundle(),
    "eda_bundle_points": bundle_points(),
    "analyze": analysis(),
    "describe_approx": union(f"SELECT {q(c)} AS \"column\", true AS near" for c in LINE_NUMBERS),
    "unique_counts_approx": union(
        f"SELECT {q(c)} AS \"column\", count(DISTINCT {c}) AS n_unique, true AS near FROM documents" for c in DOCUMENTS
    ),
    "missing_insights": numbered("Missing Values Analysis", missing_lines(E_GAPS, EVENTS)),
    "missing_insights_high": numbered("Missing Values Analysis", missing_lines(O_GAPS, GAP_ORDERS)),
    "missing_insights_none": numbered("Missing Values Analysis", missing_lines("lineitem", LINEITEM)),
    "distribution_insights": numbered("Distribution Insights", distribution_lines("events", EVENT_NUMBERS)),
    "distribution_insights_many": numbered(
        "Distribution Insights", distribution_lines("lineitem", LINE_NUMBERS)
    ),
    "correlation_insights": numbered("Correlation Analysis", correlation_lines(L_NET, NET_NUMBERS)),
    "correlation_insights_none": numbered(
        "Correlation Analysis", correlation_lines("orders", ORDER_NUMBERS)
    ),
    "feature_insights": numbered(
        "Feature Engineering Recommendations",
        feature_lines(O_GAPS, GAP_ORDERS, ("o_orderstatus", "o_orderpriority", "order_day"), 3),
    ),
    "insights": union(
        [
            numbered("Missing Values Analysis", missing_lines(D_GAPS, GAP_DOCUMENTS)),
            numbered(
                "Distribution Insights", distribution_lines(D_GAPS, ("doc_id", "n_chars", "is_long"))
            ),
            numbered(
                "Correlation Analysis",
                correlation_lines(D_GAPS, ("doc_id", "n_chars", "is_long")),
            ),
            numbered(
                "Feature Engineering Recommendations",
                feature_lines(D_GAPS, GAP_DOCUMENTS, D_OBJECTS, 3),
            ),
        ]
    ),
    "preprocessing_suggestions": suggestions(),
    "feature_ideas": ideas(
        [
            ("true", M.IDEAS_NUMERICAL, NO_TIME),
            ("true", M.IDEAS_CATEGORICAL, NO_TIME),
            ("true", M.IDEAS_MIXED, NO_TIME),
            (
                f"{names_where({c: text_flag(D_GAPS, c) for c in D_OBJECTS})} IS NOT NULL",
                M.IDEAS_TEXT,
                names_where({c: text_flag(D_GAPS, c) for c in D_OBJECTS}),
            ),
        ]
    ),
    "feature_ideas_time": ideas(
        [
            ("true", M.IDEAS_NUMERICAL, NO_TIME),
            ("true", M.IDEAS_TIME, "'o_orderdate'"),
            ("true", M.IDEAS_CATEGORICAL, NO_TIME),
            ("true", M.IDEAS_MIXED, NO_TIME),
        ]
    ),
    "chat_history": HISTORY,
    "chat_history_in_blocks": HISTORY,
    "profile_context": context(O_DAYS, _TYPES | {"o_orderdate": "object"}),
    "profile_context_gaps": gap_context(),
    "task_prompts": union(
        f"SELECT {q(t)} AS task, {prompt(t)} AS prompt FROM ({context(O_DAYS, _TYPES | {'o_orderdate': 'object'})})"
        for t in ("eda", "feature", "quality")
    ),
    "question_prompts": question_prompts(),
    "answer_questions": answers(),
    "answer_questions_no_table": (
        f"SELECT conv_id, turn, 'no_table' AS intent, {q(M.ANSWERS['no_table'])} AS answer FROM conversations"
    ),
    "valid_responses_insight": (
        f"SELECT request_id, turn, task, {STRIPPED} FROM {RESPONSES} r WHERE length(text) > 50 AND EXISTS"
        f" (SELECT 1 FROM {RESPONSES} e WHERE e.request_id = r.request_id AND e.task = 'eda'"
        " AND length(e.text) > 50)"
    ),
    "valid_responses_chat": (
        f"SELECT request_id, turn, task, {STRIPPED} FROM {RESPONSES} WHERE length(text) > 10"
    ),
}

_RANKINGS = {
    "profile": ([*LINE_NUMERICAL, "net_price", "kept_share"], "c IS NOT NULL", "round(abs(c), 12) DESC", 10, "there"),
    "context": (NET_NUMBERS, "abs(c) > 0.5", "round(abs(c), 12) DESC", 5, "back"),
    "insight": (NET_NUMBERS, "abs(c) > 0.7", "0", None, "back"),
    "heatmap": (NET_NUMBERS, "c IS NOT NULL", "round(c, 12) DESC", 5, "both"),
    "table": (NET_NUMBERS, "true", "round(abs(c), 12) DESC NULLS LAST", 10, "back"),
}
for _name, (_numbers, _where, _order, _limit, _orient) in _RANKINGS.items():
    ORACLE[f"top_correlations_{_name}"] = (
        "SELECT rank, col_x, col_y, round(r, 6) + 0.0 AS r FROM"
        f" ({ranked_pairs(L_NET, _numbers, _where, _order, _limit, _orient)})"
    )

ORACLE |= features.ORACLE
