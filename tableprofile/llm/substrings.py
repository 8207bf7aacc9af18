"""Substring dedup: passages that documents share, found by difference-cover anchors.

Positions of a document whose remainder by a period lies in a difference cover are its anchors.
For any two positions there is a shift below the period that takes both to an anchor, so two equal
windows of ``width`` words share an aligned anchor window of ``width - period + 1`` words. Only
anchor windows are counted over all documents; where one is shared, it is extended to the full
windows around it, and these are compared by the least document that has them.

Documents are dealt to blocks of bounded size. A block sends each anchor and window once, however
many of its documents have it, and gets back what the others say, so a passage in a third of all
documents is a row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tableprofile.llm.arrays import Words, mixed, slices, texts
from tableprofile.llm.classes import with_first
from tableprofile.llm.scratch import small_batches

WIDTH = 13
PERIOD = 7
#: Bytes of text in a block, on average.
BLOCK = 4 << 20


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set whose differences are all remainders of ``period`` (at most 16)."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("a period is at least 1")


def _row_keys(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mixed(mixed(ids.view(np.uint64)) + keys.view(np.uint64))


class _Part:
    """Words of some documents of a block, with ids.

    Documents without an id, and copies of a document of smaller id, have no part in the search.
    """

    def __init__(self, table: pa.Table, copies: np.ndarray, data: np.ndarray, bounds: np.ndarray, i: int, j: int):
        self.words = Words(data, bounds, i, j)
        ids = table.column("doc_id").slice(i, j - i)
        self.known = ~ids.is_null().to_numpy(zero_copy_only=False) if ids.null_count else np.ones(j - i, bool)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        keys = table.column("__key").slice(i, j - i).to_numpy()
        self.copy = self.known & np.isin(_row_keys(self.ids, keys), copies)
        self.known &= ~self.copy

    def full(self, width: int) -> np.ndarray:
        """Whether a window of ``width`` words starts at every word."""
        return self.words.fits(width) & self.known[self.words.doc]

    def anchors(self, width: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchor windows."""
        words, length = self.words, width - period + 1
        inside = (np.arange(len(words.start)) - words.first[words.doc]) % period
        at = np.flatnonzero(np.isin(inside, difference_cover(period)) & self.full(length))
        return at, words.grams(length)[at]


def _parts(table: pa.Table, sent: pa.Table) -> Iterator[_Part]:
    """The documents of a block, where some rows of ``sent`` name copies."""
    if table.num_rows:
        named = sent.filter(pc.is_valid(sent.column("key")))
        copies = _row_keys(named.column("value").to_numpy().astype(np.int64), named.column("key").to_numpy().astype(np.int64))
        data, bounds = texts(table.column("text"))
        for i, j in slices(bounds):
            yield _Part(table, copies, data, bounds, i, j)


def _values(sent: pa.Table) -> pa.Table:
    return sent.filter(pc.is_null(sent.column("key")))


def _found(sought: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether, and where, values are among sorted ones."""
    if not len(among):
        return np.zeros(len(sought), bool), np.zeros(len(sought), np.int64)
    at = np.minimum(np.searchsorted(among, sought), len(among) - 1)
    return among[at] == sought, at


def _extremes(hashes: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the least and greatest id."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    d = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(h)] - 1 if len(h) else first
    return h[first], d[first], d[last]


def _block_of(table: pa.Table, sent: pa.Table) -> int:
    return (table if table.num_rows else sent).column("__block")[0].as_py()


def _anchors(width: int, period: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        hashes, ids = [], []
        for part in _parts(table, sent):
            at, found = part.anchors(width, period)
            hashes.append(found)
            ids.append(part.ids[part.words.doc[at]])
        value, low, high = _extremes(hashes, ids)
        return pa.table(
            {
                "anchor": pa.array(value.view(np.int64)),
                "__block": pa.array(np.full(len(value), _block_of(table, sent), np.int64)),
                "many": pa.array(low < high),
            }
        )

    return run


def _windows(width: int, period: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        among = np.sort(_values(sent).column("value").to_numpy().astype(np.int64).view(np.uint64))
        hashes, ids = [], []
        for part in _parts(table, sent):
            at, found = part.anchors(width, period)
            at = at[_found(found, among)[0]]
            words = part.words
            wanted = np.zeros(len(words.start), bool)
            for shift in range(period):
                start = at - shift
                wanted[start[start >= words.first[words.doc[at]]]] = True
            start = np.flatnonzero(wanted & part.full(width))
            hashes.append(words.grams(width)[start])
            ids.append(part.ids[words.doc[start]])
        value, low, high = _extremes(hashes, ids)
        block = _block_of(table, sent)
        return pa.table(
            {
                "window": pa.array(value.view(np.int64)),
                "__block": pa.array(np.full(len(value), block, np.int64)),
                "low": pa.array(low),
                "high": pa.array(high),
            }
        )

    return run


def _cleaned(width: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        repeats = _values(sent)
        among = repeats.column("value").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(among)
        among, low = among[order], repeats.column("low").to_numpy().astype(np.int64)[order]
        n_words, n_removed, kept, spans = [], [], [], []
        for part in _parts(table, sent):
            words, full = part.words, part.full(width)
            found, at = _found(words.grams(width), among)
            hit = full & found
            if len(low):
                hit &= low[at] < part.ids[words.doc]
            edges = np.zeros(len(words.start) + width + 1, np.int64)
            np.add.at(edges, np.flatnonzero(hit), 1)
            np.add.at(edges, np.flatnonzero(hit) + width, -1)
            gone = np.cumsum(edges)[: len(words.start)] > 0
            raw = words.bytes.tobytes()
            for d in range(len(words.first) - 1):
                a, b = words.first[d], words.first[d + 1]
                out = np.ones(b - a, bool) if part.copy[d] and b - a >= width else gone[a:b]
                removed = int(out.sum())
                n_words.append(int(b - a))
                n_removed.append(removed)
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[a:b][~out], words.end[a:b][~out])]))
                turns = np.flatnonzero(np.diff(np.r_[False, out, False]))
                spans.append([{"first": int(f), "last": int(e) - 1} for f, e in zip(turns[::2], turns[1::2])])
        result = {name: table.column(name) for name in names}
        result["__n_words"] = pa.array(n_words, pa.int64())
        result["__n_removed"] = pa.array(n_removed, pa.int64())
        result["__kept"] = pa.array(kept, pa.binary()).cast(pa.string())
        result["__removed"] = pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
        return pa.table(result)

    return run


def remove_shared_passages(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """All columns of the input, with ``__n_words``, ``__n_removed``, ``__kept`` and ``__removed``.

    A window is ``width`` consecutive words (runs of anything but ASCII white space) of one
    document. Words go that are covered by a window whose words also occur in a row of smaller
    ``doc_id``, as the input stands. ``__kept`` joins the words left by one space; ``__removed`` has
    first and last numbers, from 0, of the runs that went. A null text has no words; rows of equal
    id do not affect each other; a row with a null id loses nothing and affects none. The input has
    ``doc_id``, an integer, and ``text``; columns ``__block`` and ``__key`` are
    not allowed.
    """
    if not 1 <= period <= width:
        raise ValueError("the period is at most the width")
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block))
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "__block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n))
    )
    rows = rows.withColumn("__key", F.xxhash64("text"))
    dealt = rows.groupBy("__block")
    # A text that a smaller id has goes whole, if it has a window; it need not be searched.
    named = rows.filter("doc_id IS NOT NULL").select(
        "doc_id", "__block", "__key", F.xxhash64(F.lit(1), "text").alias("other"), F.octet_length("text").alias("size")
    )
    copies = with_first(named, ["__key", "other", "size"], "doc_id").filter("doc_id > first")
    copies = copies.select(
        F.col("doc_id").alias("value"), F.col("__block").alias("__block"), F.col("__key").alias("key")
    )
    nothing = F.lit(None).cast("long")
    anchors = dealt.cogroup(copies.groupBy("__block")).applyInArrow(
        _anchors(width, period), "anchor long, __block long, many boolean"
    )
    same = Window.partitionBy("anchor")
    shared = (
        anchors.withColumn("n", F.count("*").over(same))
        .withColumn("any", F.max("many").over(same))
        .filter("n > 1 OR any")
        .select(F.col("anchor").alias("value"), "__block", nothing.alias("key"))
        .unionAll(copies)
    )
    windows = dealt.cogroup(shared.groupBy("__block")).applyInArrow(
        _windows(width, period), "window long, __block long, low long, high long"
    )
    least = F.min("low").over(Window.partitionBy("window"))
    repeats = windows.withColumn("low", least).filter("high > low")
    repeats = repeats.select(F.col("window").alias("value"), "__block", nothing.alias("key"), "low").unionAll(
        copies.withColumn("low", nothing)
    )
    schema = StructType(docs.withColumn("doc_id", F.col("doc_id").cast("long")).schema.fields)
    span = StructType([StructField("first", LongType()), StructField("last", LongType())])
    schema = schema.add("__n_words", "long").add("__n_removed", "long").add("__kept", "string").add("__removed", ArrayType(span))
    return dealt.cogroup(repeats.groupBy("__block")).applyInArrow(_cleaned(width, docs.columns), schema)


def substring_digest(docs: DataFrame) -> DataFrame:
    """Counts, spans and a digest of the words left, per document."""
    return remove_shared_passages(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_removed").alias("n_removed"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


def passages_removed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns; those that lose words have the words left as their text."""
    cleaned = remove_shared_passages(docs)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col(text_col))
    return cleaned.withColumn(text_col, text).select(*docs.columns)


#: The digest in SQL, by all windows.
PASSAGES_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM g JOIN f ON g.k = f.k WHERE f.least < g.doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id),
a AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT w.doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w JOIN gone USING (doc_id))),
left_over AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS kept FROM a ANTI JOIN r ON a.doc_id = r.doc_id AND a.p = r.p GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
