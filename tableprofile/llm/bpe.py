"""Byte-level BPE: encoding by overlapping chunks, decoding by raw bytes.

Long texts are cut into chunks that overlap, which tasks pre-tokenise on their own. Two chunks are
stitched at the first place in their overlap where both begin a pre-token: the pattern never looks
back, so from there on they agree. Pre-tokens that end within a few characters of a chunk's end
are not trusted, as the pattern may have looked at what the chunk lacks. If an overlap has no such
place, the two chunks are pre-tokenised again as one. Ids are the merges of each pre-token by rank.

Ids travel as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprofile.llm.arrays import slices, texts
from tableprofile.llm.scratch import small_batches

#: Characters by which chunks advance, and by which they overlap.
CHUNK = 1 << 15
OVERLAP = 1 << 9
#: Characters before a chunk's end in which a pre-token's end may be wrong.
DOUBT = 3
#: Pre-tokens whose ids a task remembers at once.
REMEMBERED = 1 << 17
_codecs: dict[tuple[int, str], "Codec"] = {}


class Codec:
    """Ranks of byte strings, and the pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self._merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._known: dict[str, bytes] = {}
        #: Ids from here on are free.
        self.size = max(ranks.values()) + 1
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self._bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self._length = np.array([len(t) for t in by_rank], np.int64)
        self._offset = np.cumsum(self._length) - self._length

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _learn(self, piece: str) -> bytes:
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        ids = np.array(self._merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self._known[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> list[bytes]:
        known, learn = self._known.get, self._learn
        return [known(p) or learn(p) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, one after the other."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        length = self._length[tokens]
        shift = self._offset[tokens] - (np.cumsum(length) - length)
        return self._bytes[np.repeat(shift, length) + np.arange(length.sum())].tobytes()


def load_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The lines of a rank file (one or two MB at most are expected), sent to every executor once."""
    with open(path, "rb") as lines:
        return spark.sparkContext.broadcast(lines.read())


def codec(ranks: Broadcast, pattern: str) -> Codec:
    """The codec of a task's process, made once."""
    key = (hash(ranks.value), pattern)
    if key not in _codecs:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.value.splitlines() if line)}
        _codecs[key] = Codec(table, pattern)
    return _codecs[key]


def _whole(ranks: Broadcast, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            for i, j in slices(bounds):
                raw = data[bounds[i] : bounds[j]].tobytes()
                at = (bounds[i : j + 1] - bounds[i]).tolist()
                out = [b"".join(own.ids(own.pieces(raw[a:b].decode()))) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            for i in range(batch.num_rows):
                text = data[bounds[i] : bounds[i + 1]].tobytes().decode()
                starts = range(0, max(1, len(text) - overlap), chunk)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column("doc_id").slice(i, 1)] * n),
                        pa.concat_arrays([batch.column("key").slice(i, 1)] * n),
                        pa.array(list(starts), pa.int64()),
                        pa.array([text[s : s + chunk + overlap] for s in starts], pa.string()),
                    ],
                    ["doc_id", "key", "start", "text"],
                )

    return run


def _ends(text: str, own: Codec) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Characters and ids before every boundary of pre-tokens, and the ids."""
    pieces = own.pieces(text)
    ids = own.ids(pieces)
    chars = np.cumsum([0, *map(len, pieces)])
    return chars, np.cumsum([0, *[len(b) // 4 for b in ids]]), b"".join(ids)


def _chunks(ranks: Broadcast, pattern: str, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids of chunks, with the boundaries in their first and last ``overlap`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                text, start = batch.column("text")[i].as_py(), batch.column("start")[i].as_py()
                chars, counts, ids = _ends(text, own)
                edge = (chars <= overlap) | (chars >= len(text) - overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(i, 1) for c in ("doc_id", "key", "start", "text")],
                        pa.array([(chars[edge] + start).tolist()], pa.list_(pa.int64())),
                        pa.array([counts[edge].tolist()], pa.list_(pa.int64())),
                        pa.array([ids], pa.binary()),
                    ],
                    ["doc_id", "key", "start", "text", "chars", "counts", "ids"],
                )

    return run


def stitch(chunks: list[tuple[int, str, np.ndarray, np.ndarray, bytes]], own: Codec) -> bytes:
    """Ids of a text from its chunks in order: start, text, boundaries, ids before these, ids.

    Chunks that agree on no boundary are pre-tokenised again as one, twice as many of them each
    time that this gives none either, so that a run without any boundary costs its length and not its square.
    """
    parts = []
    start, text, chars, counts, ids = chunks[0]
    begin, at, more = 0, 1, 1
    while at < len(chunks):
        follow = chunks[at]
        end = start + len(text)
        agreed = np.intersect1d(chars[(chars >= follow[0]) & (chars <= end - DOUBT) & (counts >= begin)], follow[2])
        if len(agreed):
            parts.append(ids[4 * begin : 4 * int(counts[np.searchsorted(chars, agreed[0])])])
            begin = int(follow[3][np.searchsorted(follow[2], agreed[0])])
            start, text, chars, counts, ids = follow
            at, more = at + 1, 1
        else:
            # From the last agreed boundary on, all as one.
            known = int(chars[np.searchsorted(counts, begin)]) - start
            joined = [text[known:]]
            for added in chunks[at : at + more]:
                joined.append(added[1][end - added[0] :])
                end = added[0] + len(added[1])
            start, text = start + known, "".join(joined)
            chars, counts, ids = _ends(text, own)
            chars, begin = chars + start, 0
            at, more = at + more, 2 * more
    parts.append(ids[4 * begin :])
    return b"".join(parts)


def _stitched(ranks: Broadcast, pattern: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        own = codec(ranks, pattern)
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        copies = sum(r["start"] == 0 for r in rows)
        chunks = [
            (r["start"], r["text"], np.array(r["chars"]), np.array(r["counts"]), r["ids"]) for r in rows[::copies]
        ]
        return pa.table(
            {
                "doc_id": pa.array([rows[0]["doc_id"]] * copies, pa.int64()),
                "ids": pa.array([stitch(chunks, own)] * copies, pa.binary()),
            }
        )

    return run


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` and ``ids`` of every row; a null or empty text has no ids.

    Rows of one text and id are encoded once and given as often as they occur; null ids are ids
    like others. Other columns are ignored. Ids have no special tokens: what looks like one is text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.char_length("text") > chunk + overlap
    short = rows.filter(~is_long).mapInArrow(_whole(ranks, pattern), "doc_id long, ids binary")
    cut = (
        rows.filter(is_long)
        .withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
        .mapInArrow(_cut(chunk, overlap), "doc_id long, key string, start long, text string")
    )
    encoded = cut.repartition("key", "start").mapInArrow(
        _chunks(ranks, pattern, overlap),
        "doc_id long, key string, start long, text string, chars array<long>, counts array<long>, ids binary",
    )
    return short.unionAll(encoded.groupBy("doc_id", "key").applyInArrow(_stitched(ranks, pattern), "doc_id long, ids binary"))


def decode(rows: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the bytes of the ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [own.decode(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"]
                )

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number and digest of every text's ids, and the digest of what they decode to."""
    ranks = load_ranks(docs.sparkSession, path)
    return decode(encode(docs, ranks, pattern), ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
