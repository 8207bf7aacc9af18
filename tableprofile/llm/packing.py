"""Best-fit packing of documents into training sequences under conflicts.

Documents are cut into pieces of at most the capacity, and pieces, longest first, go to the open
bin whose room is the tightest that holds them, if it has no document of the same source and none
of the same cluster of copies; else the search goes on to the next roomier bin, and after the last
one a new bin is opened. Bins are kept by room, each with a bitmap of its sources and one of its
clusters. Pieces are dealt to shards of bounded size at random, so every shard sees a fair share of
a frequent source, and shards are packed side by side. Words are counted once; what follows works
on sizes alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.arrays import Words, slices, texts
from tableprofile.llm.scratch import small_batches, written
from tableprofile.llm.words import words

#: Words in a training sequence.
CAPACITY = 2048
#: Pieces of a shard, on average.
SHARD = 8192


class Bins:
    """Open bins by room. ``rooms`` is a bitmap of the rooms for which there is a bin."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.rooms = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> int:
        """The tightest bin that holds a piece without a conflict, the oldest of equal ones; maybe a new one."""
        left = self.rooms >> length
        room = length
        while left:
            skip = (left & -left).bit_length() - 1
            room += skip
            for k in self.by_room[room]:
                if not self.sources[k] & source and not self.clusters[k] & cluster:
                    self._move(k, room, room - length)
                    self.sources[k] |= source
                    self.clusters[k] |= cluster
                    self.used[k] += 1
                    return k
            left >>= skip + 1
            room += 1
        self.sources.append(source)
        self.clusters.append(cluster)
        self.used.append(1)
        self._add(len(self.sources) - 1, self.capacity - length)
        return len(self.sources) - 1

    def _add(self, k: int, room: int) -> None:
        if room:
            self.by_room[room][k] = None
            self.rooms |= 1 << room

    def _move(self, k: int, old: int, new: int) -> None:
        del self.by_room[old][k]
        if not self.by_room[old]:
            self.rooms ^= 1 << old
        self._add(k, new)


def pack(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it of pieces (length, source, cluster) in the given order.

    Bits stand for the sources and clusters of these pieces in order of appearance; None conflicts
    with nothing.
    """
    bins, names, copies, out = Bins(capacity), {}, {}, []
    for length, source, cluster in pieces:
        a = 0 if source is None else 1 << names.setdefault(source, len(names))
        b = 0 if cluster is None else 1 << copies.setdefault(cluster, len(copies))
        k = bins.place(length, a, b)
        out.append((k, bins.used[k] - 1))
    return out


def _packed(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        clusters = table.column("cluster")
        # A cluster of one piece conflicts with nothing, so it needs no bit.
        values, inverse, counts = np.unique(clusters.to_numpy(), return_inverse=True, return_counts=True)
        single = counts[inverse] == 1
        rows = zip(
            table.column("n_words").to_pylist(),
            table.column("source").to_pylist(),
            (None if one else c for one, c in zip(single, inverse.tolist())),
        )
        found = pack(rows, capacity)
        return pa.table(
            {
                "shard": table.column("__shard"),
                "bin": pa.array([k for k, _ in found], pa.int64()),
                "position": pa.array([p for _, p in found], pa.int64()),
                "doc_id": table.column("doc_id"),
                "piece": table.column("piece"),
                "first_word": table.column("first_word"),
                "n_words": table.column("n_words"),
                "source": table.column("source"),
                "cluster": clusters,
            }
        )

    return run


def text_cluster(text: Column) -> Column:
    """The same number for texts of the same words in the same order, whatever their case and spacing."""
    return F.xxhash64(F.array_join(words(F.lower(text)), " "))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their text's words in its place, without those that have none."""
    for batch in batches:
        data, bounds = texts(batch.column("text"))
        total = [np.diff(Words(data, bounds, i, j, hashed=False).first) for i, j in slices(bounds)]
        total = np.concatenate(total).astype(np.int64) if total else np.zeros(0, np.int64)
        columns = [batch.column(c) for c in ("doc_id", "source", "cluster")]
        sized = pa.RecordBatch.from_arrays([*columns, pa.array(total)], ["doc_id", "source", "cluster", "total"])
        yield sized.filter(pa.array(total > 0))


def best_fit_packing(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard: int = SHARD,
    source_col: str = "source",
    cluster: Column | None = None,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """``shard``, ``bin``, ``position``, ``doc_id``, ``piece``, ``first_word``, ``n_words``, ``source`` and ``cluster`` of every piece.

    A sequence is a (shard, bin); its pieces follow each other by ``position`` and have at most
    ``capacity`` words together. A piece has ``capacity`` words of a document, the last one what is
    left, however long the text. Documents without words, null texts too, have no piece. A null
    source conflicts with no other; ``cluster`` tells copies of a text (by default equal words), and
    ``clusters`` (``doc_id``, ``component_id``) does for the ids it has, the smallest of an id's.
    Repeated rows are copies of each other and are dealt one by one, as are rows without an id, whose
    copies are told by ``cluster``. Of pieces of one length those of smaller id go first. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    cluster = text_cluster(F.col("text")) if cluster is None else cluster.cast("long")
    if clusters is not None:
        given = clusters.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").cast("long").alias("given"))
        given = written(given, "given")
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
        if ids.join(given.filter("given IS NOT NULL"), "doc_id", "leftanti").limit(1).count() == 0:
            # What every id is given need not be told from its text.
            cluster = F.when(F.col("doc_id").cast("long").isNull(), cluster)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        cluster.alias("cluster"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(_sized, "doc_id long, source string, cluster long, total long")
    # Equal rows are counted where they are read, so that no key has more than a row per task.
    sized = written(sized.groupBy("doc_id", "source", "cluster", "total").agg(F.count("*").alias("copies")), "sizes")
    if clusters is not None:
        named = sized.filter("doc_id IS NOT NULL").join(given, "doc_id", "left")
        named = named.withColumn("cluster", F.coalesce("given", "cluster")).drop("given")
        dealt = named.unionByName(sized.filter("doc_id IS NULL"))
    else:
        dealt = sized
    return _pieces_packed(dealt, capacity, shard)


def pack_counted(counted: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """What ``best_fit_packing`` gives, out of ``doc_id``, ``source``, ``cluster`` and ``total``, the words, of every document."""
    keys = ["doc_id", "source", "cluster", "total"]
    sized = written(counted.filter("total > 0").groupBy(*keys).agg(F.count("*").alias("copies")), "sizes")
    return _pieces_packed(sized, capacity, shard)


def _pieces_packed(sized: DataFrame, capacity: int, shard: int) -> DataFrame:
    """Bins of the pieces of documents, equal ones in one row with their number."""
    last = f"CAST(floor((total - 1) / {capacity}) AS bigint)"
    pieces = (
        sized.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, {last})")))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * capacity).alias("first_word"),
            F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("long").alias("n_words"),
            "source",
            "cluster",
            "copy",
            "total",
        )
    )
    n_pieces = sized.agg(F.expr(f"sum(copies * ({last} + 1))")).first()[0] or 0
    n = max(1, -(-n_pieces // shard))
    # Neither one id nor one text decides alone, as a third of the rows may share either.
    hashed = F.xxhash64("doc_id", "piece", "cluster", "source", "total", "copy")
    return (
        pieces.withColumn("__shard", F.pmod(hashed, F.lit(n)))
        .drop("copy", "total")
        .groupBy("__shard")
        .applyInArrow(
            _packed(capacity),
            "shard long, bin long, position long, doc_id long, piece long, first_word long, n_words long, source string, cluster long",
        )
    )
