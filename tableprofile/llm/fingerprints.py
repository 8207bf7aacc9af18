"""Document fingerprints: threshold-scaled sketches of word shingles.

Every shingle hash below a fixed fraction of the hash range is kept, whatever the length of the
text, so that sketches of very unequal documents compare without bias, a union of texts has the
union of the sketches, and containment can be told beside likeness. A text none of whose hashes
falls below the fraction keeps its smallest hash, so that no text with a word has an empty sketch.
Only column expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprofile.llm.words import whole, words

WIDTH = 5
SCALE = 8
_HASHES = "array<bigint>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter; else none."""
    return _let(
        words(text),
        lambda w: F.when(F.size(w) == 0, F.array().cast(_HASHES)).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))),
                lambda i: F.xxhash64(F.slice(w, i, width)),
            )
        ),
    )


def scaled_sketch(hashes: Column, scale: int = SCALE) -> Column:
    """Sorted distinct hashes in the lowest 1/``scale`` of the unsigned range, or else the smallest.

    ``scale`` is a power of two of at least four, so that kept hashes are positive.
    """
    if scale < 4 or scale & (scale - 1):
        raise ValueError("scale must be a power of two, at least 4")
    low = F.lit(2**64 // scale)

    def never_empty(h: Column, kept: Column) -> Column:
        # In unsigned order, negative numbers come last.
        smallest = F.coalesce(F.array_min(F.filter(h, lambda x: x >= 0)), F.array_min(h))
        return F.when((F.size(kept) > 0) | (F.size(h) == 0), kept).otherwise(F.array(smallest))

    return _let(
        hashes,
        lambda h: _let(
            F.array_sort(F.array_distinct(F.filter(h, lambda x: (x >= 0) & (x < low)))),
            lambda kept: never_empty(h, kept),
        ),
    )


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return scaled_sketch(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of two texts; 1 for two empty texts."""
    return _let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0)),
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of the first text that occur in the second; 1 if it has none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(1.0))


def printed(sketch: Column) -> Column:
    """A sketch as text: hashes of 16 hexadecimal digits each, in order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """All columns of the input and ``sketch``.

    A null or empty text has an empty sketch; repeated rows and null ids give a row each.
    """
    return docs.withColumn("sketch", scaled_sketch(shingle_hashes(F.col(text_col), width), scale))


def _block(bounds: list) -> Column:
    """How many bounds are not above the id; -1 for a null id.

    Searched in two steps, so that the cost is the square root of the number of blocks.
    """
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lists = F.expr(f"array({', '.join('array(' + ', '.join(f'{b}L' for b in g) + ')' for g in groups)})")
    firsts = F.expr(f"array({', '.join(f'{g[0]}L' for g in groups)})")
    inside = _let(
        F.size(F.filter(firsts, lambda b: b <= F.col("doc_id"))),
        lambda g: F.when(g == 0, F.lit(0)).otherwise(
            (g - 1) * step + F.size(F.filter(F.element_at(lists, g), lambda b: b <= F.col("doc_id")))
        ),
    )
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(inside)


def with_next(
    rows: DataFrame, derive: Callable[[DataFrame], DataFrame], values: list[str], blocks: int | None = None
) -> DataFrame:
    """``derive(rows)`` with ``next_<value>`` of the row that follows by descending ``doc_id``.

    After the last row comes the first, and a single row follows itself. Rows are ordered in
    ``blocks`` blocks of consecutive ids (by default four per shuffle partition), bounded by
    quantiles of the ids; the rows of each block's greatest id are also sent to the block above,
    so that values move once. Rows of equal id are in order of the hash of their values, and null
    ids come last.
    """
    spark = rows.sparkSession
    n = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    if n > 1:
        shares = F.expr(f"array({', '.join(f'{i / n}D' for i in range(1, n))})")
        found = rows.agg(F.percentile_approx("doc_id", shares, 20 * n)).first()[0]
    bounds = sorted(set(found or []))
    # At most blocks + 1 rows reach the driver.
    heads = rows.select(_block(bounds).alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id")).collect()
    heads = sorted((tuple(r) for r in heads), key=lambda r: r[0])
    to = ", ".join(
        f"struct(cast({'null' if head is None else head} as bigint) AS __head, {heads[(k + 1) % len(heads)][0]} AS __block)"
        for k, (_, head) in enumerate(heads)
    )
    own = rows.select("*", _block(bounds).alias("__block"), F.lit(0).alias("__copy"))
    if heads:
        wanted = spark.range(1).select(F.expr(f"inline(array({to}))"))
        copies = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("__head")))
        own = own.unionAll(copies.select(*rows.columns, "__block", F.lit(1).alias("__copy")))
    order = Window.partitionBy("__block").orderBy("__copy", F.col("doc_id").desc_nulls_last(), F.xxhash64(*values))
    followed = derive(own).select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    return followed.filter("__copy = 0").drop("__copy", "__block")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other and the next document's.

    The edited text has the last half of its characters replaced by the first as many of the next
    document's, by descending ``doc_id``; after the last document comes the first.
    """
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        with_next(rows, fingerprints, ["text", "sketch"])
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn(
            "edited",
            F.concat(
                F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                F.substring("next_text", F.lit(1), half),
            ),
        )
        .select("doc_id", "n_chars", "sketch", "next_sketch", "edited")
        .withColumn("edited_sketch", scaled_sketch(shingle_hashes(F.col("edited"))))
    )
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
