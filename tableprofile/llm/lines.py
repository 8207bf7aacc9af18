"""Line dedup: lines that many sites share, by sketches of the distinct sites of every line.

Every line (text between line feeds, without white space at its ends) is reduced to a hash. One
HyperLogLog sketch of sites per hash, merged by partial aggregation, estimates its spread. Lines
whose estimate is near the threshold are counted exactly; clear ones are decided by the sketch,
whose error at the edge of the band is beyond six standard deviations. The first document, by id,
that has a boilerplate line keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.words import whole

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 8
#: Log of the sketch's registers: 1,024, a standard error of about 3 %.
LOG_REGISTERS = 10
#: Share of the threshold on either side of it within which lines are counted exactly.
BAND = 0.25


def _hash(line: Column) -> Column:
    """Hash of a line; null for a line that is blank."""
    bare = F.btrim(line, F.lit(" \t\x0b\f\r"))
    return F.when(bare != "", F.xxhash64(bare))


def _hashes(text: Column) -> Column:
    return F.transform(F.split(whole(text), "\n"), _hash)


def boilerplate_lines(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` (its hash), ``first_doc`` and ``spread`` of the lines that ``min_sites`` sites or more have.

    ``spread`` is exact near the threshold and the sketch's estimate above. A null site is no site.
    """
    lines = docs.select(
        "doc_id", F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line")
    ).filter("line IS NOT NULL")
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("spread"),
        F.min("doc_id").alias("first_doc"),
    )
    spread = spread.filter(F.col("spread") >= int(min_sites * (1 - BAND)))
    far = spread.filter(F.col("spread") > min_sites * (1 + BAND))
    near = spread.filter(F.col("spread") <= min_sites * (1 + BAND)).select("line", "first_doc")
    # Sites by line once per task before they meet; a line has at most as many rows as it has sites.
    exact = (
        lines.join(near, "line")
        .groupBy("line", "first_doc", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line", "first_doc")
        .agg(F.count("site").alias("spread"))
        .filter(F.col("spread") >= min_sites)
    )
    return far.select("line", "first_doc", "spread").unionByName(exact)


def drop_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns, ``text`` without boilerplate lines, and ``__n_lines`` and ``__n_dropped``.

    Lines that are blank stay. A line is kept in the row of the smallest id that has it, all its
    occurrences there, too; rows of equal id keep it alike. A null text stays null and has no
    lines. A row with a null id keeps no boilerplate, unless all rows with that line have a null id.
    """
    found = boilerplate_lines(docs, site_col, min_sites)
    of_rows = docs.select("doc_id", F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line"))
    dropped = (
        of_rows.filter("line IS NOT NULL")
        .join(found.select("line", "first_doc"), "line")
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.collect_set("line").alias("__lines"))
    )
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    gone = F.col("__lines")
    kept = F.filter(
        F.split("text", "\n"), lambda line: F.coalesce(~F.array_contains(gone, _hash(line)), F.lit(True))
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    cleaned = joined.select(
        *docs.columns,
        n_lines.alias("__n_lines"),
        F.when(gone.isNull(), F.split("text", "\n")).otherwise(kept).alias("__kept"),
    )
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("__kept"))
    return cleaned.select(
        *[F.array_join("__kept", "\n").alias("text") if c == "text" else c for c in docs.columns],
        "__n_lines",
        (F.col("__n_lines") - n_kept).alias("__n_dropped"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """Documents with the text left and how many lines there were and went."""
    return drop_boilerplate(docs).select(
        "doc_id",
        "source",
        "text",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
    )


#: The same in SQL, with exact counts for all lines.
LINES_SQL = f"""
WITH u AS (
    SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), l AS (
    SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM u
), b AS (
    SELECT bare, min(doc_id) AS first_doc FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}
), k AS (
    SELECT l.doc_id, count(*) AS n_lines, count(b.bare) AS n_dropped,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.bare IS NULL), '') AS text
    FROM l LEFT JOIN b ON l.bare = b.bare AND l.doc_id <> b.first_doc GROUP BY l.doc_id
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NOT NULL THEN k.text END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
