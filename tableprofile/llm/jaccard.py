"""N-gram Jaccard join: documents whose sets of word shingles are alike, by prefix filtering.

Shingles are in one global order, rare before frequent. Two sets of the wanted likeness share a
shingle within their first few (the prefix), so documents meet only in buckets of prefix shingles;
length and positions in the order rule out some of those, counts by ranges of the hashes (suffix
filter) most of the rest, and what is left is verified once per pair by its whole texts.

Large groups of near copies share their buckets, whose pairs grow with the square. Of buckets with the
same members one is kept. Links are first sought between the members of a bucket and one leader. Then
only pairs that no chain of links connects yet are left: they are compared inside the bucket, block by
block in numpy, by lengths, positions and bitmaps of the shingles. Once, or twice where buckets are very
large, a block gives only as many of those that may be alike as connect its members, which are verified;
what these leave open, the pairs that passed the bitmaps by accident and few others, is verified whole.
So components are exact, and no table has a row per pair of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.arrays import Words, mixed, slices, texts
from tableprofile.llm.classes import with_first
from tableprofile.llm.components import connected_components
from tableprofile.llm.scratch import small_batches, written

WIDTH = 5
PERCENT = 80
#: Shingles that come last in the order, by their frequency; the rest count as equally rare. The
#: number bounds what is broadcast (16 bytes each) and only changes how fast the join is.
FREQUENT = 1 << 18
#: Members of a block of a bucket; larger buckets are compared block by block.
BLOCK = 2048
#: Bits of a document's bitmap of shingles, and members up to which buckets are compared many at once.
BITS = 4096
TOGETHER = 16
#: Pairs in large buckets for each document from which on two rounds are sparse; only changes how fast the join is.
MANY = 256
#: Shingles counted at once in a task.
CHUNK = 1 << 19
#: Prefix rows that a task packs at once (24 bytes each), and those of a part on average.
PACK = 1 << 20
PART = 1 << 18
#: Leaves the highest 23 bits of a shingle, by which most are told not to be frequent.
SIEVE_SHIFT = np.uint64(40)
_TOP = np.uint64(1 << 63)


def _shingled(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct 63-bit shingle hashes, in order, of some texts after the other, where each text's begin and end, its words.

    Fewer words than ``width`` are one shingle.
    """
    for i, j in slices(bounds):
        words = Words(data, bounds, i, j, lower=True)
        hashes, first, kept = words.grams(width) >> np.uint64(1), words.first, words.fits(width)
        n = np.diff(first)
        short = (n > 0) & (n < width)
        for d in np.flatnonzero(short).tolist():
            own = np.zeros(1, np.uint64)
            for k in range(first[d], first[d + 1]):
                own = mixed(own + words.hash[k : k + 1])
            hashes[first[d]], kept[first[d]] = own[0] >> np.uint64(1), True
        flat = hashes[kept]
        starts = np.concatenate([[0], np.cumsum(np.where(short, 1, np.maximum(n - width + 1, 0)))])
        ends = starts.tolist()
        for begin, end in zip(ends[:-1], ends[1:]):
            flat[begin:end].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[starts[:-1][np.diff(starts) > 0]] = True
        yield flat[new], np.concatenate([[0], np.cumsum(new)])[starts], n


def _shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Distinct 63-bit shingle hashes of every text, in order."""
    for flat, starts, _ in _shingled(data, bounds, width):
        ends = starts.tolist()
        for begin, end in zip(ends[:-1], ends[1:]):
            yield flat[begin:end]


def _signatures(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every set that are equal for equal sets."""
    out = []
    for hashed in (mixed(flat), mixed(flat ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)])
        out.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
    return out[0], out[1]


def _first_of_equal(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, seen: set) -> np.ndarray:
    """Which sets have some shingles and are the first of their equals."""
    out = np.zeros(len(sizes), bool)
    for k, key in enumerate(zip(sizes.tolist(), a.tolist(), b.tolist())):
        if key[0] and key not in seen:
            seen.add(key)
            out[k] = True
    return out


def _repeated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand there more than once, and how often."""
    values = np.sort(np.concatenate(parts))
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(values)))
    return values[at[counts > 1]], counts[counts > 1]


def _sizes(width: int, schema: pa.Schema | None = None) -> Callable:
    """Size and signature of every text's set, its number of words and the columns of ``schema``; in rows with a ``shingle``, how many sets of a batch have it.

    Of the texts with an id, the different sets of a batch are counted some ``CHUNK`` shingles at a
    time, and only shingles that several of them have get a row.
    """

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = _repeated(parts)
        none = pa.nulls(len(values), pa.int64())
        n, shingle = pa.array(counts.astype(np.int64)), pa.array(values.view(np.int64))
        return pa.RecordBatch.from_arrays([none, n, none, none, none, shingle, *[pa.nulls(len(values), t) for t in kinds]], names)

    carried, kinds = (schema.names, schema.types) if schema else ([], [])
    names = ["doc_id", "n_shingles", "key_a", "key_b", "n_words", "shingle", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has_id = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            keys, parts, size, row, seen = [], [], 0, 0, set()
            for flat, starts, n_words in _shingled(*texts(batch.column("text")), width):
                sizes, own = np.diff(starts), _signatures(flat, starts)
                keys.append((sizes, *own, n_words))
                ids = has_id[row : row + len(sizes)]
                row += len(sizes)
                wanted = _first_of_equal(np.where(ids, sizes, 0), *own, seen)
                parts.append(flat[np.repeat(wanted, sizes)])
                size += len(parts[-1])
                if size >= CHUNK:
                    yield counted(parts)
                    parts, size = [], 0
            if size:
                yield counted(parts)
            if keys:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*keys)]
                none = pa.nulls(batch.num_rows, pa.int64())
                others = [batch.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, none, *others], names)

    return run


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles of ``n`` of which two sets of the wanted likeness share one at least."""
    return n - (percent * n + 99) // 100 + 1


def _beginnings(
    flat: np.ndarray, starts: np.ndarray, wanted: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray, sieve: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes of the wanted sets in the global order: token, number of the set, place in the order.

    Rare shingles come by their hash, behind them frequent ones by rank, with the highest bit set.
    """
    sizes = np.diff(starts)
    length = np.where(wanted, prefix_length(sizes, percent), 0)
    common, ranks = np.zeros(len(flat), bool), np.zeros(len(flat), np.uint64)
    maybe = np.flatnonzero(sieve[(flat >> SIEVE_SHIFT).astype(np.int64)])
    if len(maybe):
        at = np.minimum(np.searchsorted(frequent, flat[maybe]), len(frequent) - 1)
        found = frequent[at] == flat[maybe]
        common[maybe[found]], ranks[maybe[found]] = True, rank[at[found]]
    before = np.concatenate([[0], np.cumsum(~common)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = before[:-1] - before[starts[:-1]][of]
    take = np.flatnonzero(~common & (place < length[of]))
    token, of, place = [flat[take]], [of[take]], [place[take]]
    rare = before[starts[1:]] - before[starts[:-1]]
    for d in np.flatnonzero(rare < length).tolist():
        own = slice(starts[d], starts[d + 1])
        last = np.sort(ranks[own][common[own]])[: length[d] - rare[d]]
        token.append(last | _TOP)
        of.append(np.full(len(last), d))
        place.append(rare[d] + np.arange(len(last)))
    return np.concatenate(token), np.concatenate(of), np.concatenate(place)


def _prefixes(width: int, percent: int, table: Broadcast, n_parts: int) -> Callable:
    """Prefixes as packed rows (token, doc, size and place), dealt to parts by the token, frequent ones by the document."""

    def packed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        token, doc, place = (np.concatenate(c) for c in zip(*found))
        doc, place = doc.view(np.uint64), place.view(np.uint64)
        part = (np.where(token >= _TOP, mixed(doc), token) % np.uint64(n_parts)).astype(np.uint16 if n_parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        rows = np.stack([token, doc, place], axis=1)[order]
        part = part[order]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        offsets = (np.append(at, len(part)) * rows.itemsize * 3).astype(np.int32)
        body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int64)), body], ["part", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = table.value
        sieve = np.zeros(1 << 23, bool)
        sieve[(frequent >> SIEVE_SHIFT).astype(np.int64)] = True
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, seen = 0, set()
            for flat, starts, _ in _shingled(*texts(batch.column("text")), width):
                sizes = np.diff(starts)
                wanted = _first_of_equal(sizes, *_signatures(flat, starts), seen)
                token, of, place = _beginnings(flat, starts, wanted, percent, frequent, rank, sieve)
                held.append((token, ids[row + of].astype(np.int64), (sizes[of].astype(np.int64) << 32) | place))
                row += len(sizes)
                size += len(token)
                if size >= PACK:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return run


def _in_company(table: pa.Table) -> pa.Table:
    """The rows of a part whose token is frequent, and so surely has company, or that another row has, too."""
    rows = np.frombuffer(b"".join(x.as_buffer() for x in table.column("body")), np.uint64).reshape(-1, 3)
    rows = rows[np.argsort(rows[:, 0])]
    token = rows[:, 0]
    same = token[1:] == token[:-1]
    keep = token >= _TOP
    keep[1:] |= same
    keep[:-1] |= same
    rows = rows[keep].view(np.int64)
    return pa.table({name: np.ascontiguousarray(rows[:, k]) for k, name in enumerate(("token", "doc", "place"))})


def _least(m: int, n: int, percent: int) -> int:
    """Smallest common number at which two sets of these sizes are alike."""
    return -(-percent * (m + n) // (100 + percent))


def _counts(shingles: np.ndarray) -> bytes:
    """Numbers of shingles by ranges of the hashes, two or so in each; 255 stands for more, too."""
    bits = max(4, int(len(shingles) // 2).bit_length())
    at = (shingles >> np.uint64(63 - bits)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _may_be_alike(a: np.ndarray, b: np.ndarray, m: int, n: int, percent: int) -> bool:
    """The suffix filter: what two sets have in common is bounded range by range."""
    if a.max() == 255 or b.max() == 255:
        return True
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) < len(b):
        b = b.reshape(len(a), -1).sum(1)
    return int(np.minimum(a, b).sum()) >= _least(m, n, percent)


def _promising(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_pylist() for c in ("n_a", "n_b")]
            counts = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)] for c in ("counts_a", "counts_b")]
            keep = [_may_be_alike(a, b, m, n, percent) for a, b, m, n in zip(*counts, *sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bitmap(shingles: np.ndarray) -> bytes:
    out = np.zeros(BITS, bool)
    out[(shingles % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _counted(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), _counts(s), _bitmap(s)) for s in _shingle_sets(*texts(batch.column("text")), width)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array([n for n, _, _ in sets], pa.int64()),
                    pa.array([c for _, c, _ in sets], pa.binary()),
                    pa.array([b for _, _, b in sets], pa.binary()),
                ],
                ["doc_id", "text", "n", "counts", "bits"],
            )

    return run


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= _least(len(a), len(b), percent)


def _verified(width: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = _shingle_sets(*texts(batch.column("text_a")), width)
            right = _shingle_sets(*texts(batch.column("text_b")), width)
            keep = [_alike(x, y, percent) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs that share a token and pass the length and positional filters on it.

    What two sets can have in common is bounded by what stands before and after a common token;
    the bound holds for each token, so it does not matter which of several lets a pair pass.
    """
    low = F.lit((1 << 32) - 1)
    n_a, n_b = F.shiftright("a.place", 32), F.shiftright("b.place", 32)
    at_a, at_b = F.col("a.place").bitwiseAND(low), F.col("b.place").bitwiseAND(low)
    room = F.least("at_a", "at_b") + 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    joined = left.alias("a").join(right.alias("b"), "token").filter("a.doc <> b.doc")
    return (
        joined.select(
            F.least("a.doc", "b.doc").alias("a"),
            F.greatest("a.doc", "b.doc").alias("b"),
            n_a.alias("n_a"),
            n_b.alias("n_b"),
            at_a.alias("at_a"),
            at_b.alias("at_b"),
        )
        .filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (room * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))))
        .select("a", "b")
        .distinct()
    )


def _leaders(buckets: DataFrame) -> DataFrame:
    """One member of every bucket."""
    leader = F.min_by(F.struct("doc", "place"), F.xxhash64("doc"))
    return buckets.groupBy("token").agg(leader.alias("l")).select("token", "l.doc", "l.place")


def _open(buckets: DataFrame, labels: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Members of buckets with a pair that nothing connects yet, by blocks, with their bitmaps."""
    placed = buckets.join(labels, F.col("doc") == labels["node"], "left").select(
        "token", "doc", "place", "m", F.coalesce("component", "doc").alias("component")
    )
    ends = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    members = placed.join(ends.filter("low < high").select("token"), "token").join(bitmaps, "doc")
    # A member meets its own block and every other one of its bucket.
    members = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "place", "component", "bits"
    )
    return members.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")


class _Members:
    """Rows of open buckets, one after the other, ordered by bucket and blocks."""

    def __init__(self, table: pa.Table, percent: int):
        def column(name: str) -> np.ndarray:
            return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)

        self.percent = percent
        self.doc, self.component, self.own = column("doc"), column("component"), column("own")
        self.n, self.at = column("place") >> 32, column("place") & 0xFFFFFFFF
        key = np.stack([column("token"), column("i"), column("j")])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        self.groups = np.stack([starts, np.r_[starts[1:], table.num_rows]], axis=1)
        self.within = (key[1] == key[2])[starts]
        bits = table.column("bits").combine_chunks().cast(pa.large_binary())
        self.bits = np.frombuffer(b"".join(x.as_buffer() for x in bits), np.uint64).reshape(len(bits), BITS // 64)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Those pairs (a 2 x k matrix of rows) that may be alike and nothing connects yet."""
        n, m, p = self.n[a], self.n[b], self.percent
        low, high = np.minimum(n, m), np.maximum(n, m)
        room = np.minimum(self.at[a], self.at[b]) + 1 + np.minimum(n - self.at[a], m - self.at[b]) - 1
        keep = (self.component[a] != self.component[b]) & (100 * low >= p * high) & (room * (100 + p) >= p * (n + m))
        a, b, n, m = a[keep], b[keep], n[keep], m[keep]
        x, y = self.bits[a], self.bits[b]
        # A bit that only one of two sets has stands for a shingle the other lacks.
        left = n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
        right = m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
        keep = np.minimum(left, right) * (100 + p) >= p * (n + m)
        return np.stack([a[keep], b[keep]])

    def pairs(self, sparse: bool) -> Iterator[np.ndarray]:
        """The pairs of all buckets; where ``sparse``, of large ones as many as connect what they connect."""
        sizes = self.groups[:, 1] - self.groups[:, 0]
        small = self.within & (sizes <= TOGETHER)
        for size in np.unique(sizes[small]).tolist():
            first = self.groups[small & (sizes == size), 0]
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 16) // max(1, len(i)))
            for k in range(0, len(first), step):
                yield self.alike((first[k : k + step, None] + i).ravel(), (first[k : k + step, None] + j).ravel())
        for (begin, end), within in zip(self.groups[~small].tolist(), self.within[~small].tolist()):
            rows = np.arange(begin, end)
            left = rows if within else rows[self.own[rows] == self.own[rows].min()]
            right = rows if within else rows[self.own[rows] != self.own[rows].min()]
            label = self.component.copy() if sparse else self.component
            for row in left.tolist():
                others = right[right > row] if within else right
                others = others[label[others] != label[row]]
                # Lengths first: most of a bucket's members are far off.
                others = others[100 * np.minimum(self.n[others], self.n[row]) >= self.percent * np.maximum(self.n[others], self.n[row])]
                if not len(others):
                    continue
                found = self.alike(np.full(len(others), row), others)
                if sparse and found.shape[1]:
                    near, first = np.unique(label[found[1]], return_index=True)
                    found = found[:, first]
                    label[rows[np.isin(label[rows], near)]] = label[row]
                yield found


def _open_pairs(percent: int, sparse: bool) -> Callable:
    """For a task: pairs of unconnected members of its buckets that may be alike; see ``_Members.pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            members = _Members(table, percent)
            parts = [p for p in members.pairs(sparse) if p.shape[1]]
            if parts:
                pairs = members.doc[np.concatenate(parts, axis=1)]
                low, high = pairs.min(axis=0), pairs.max(axis=0)
                distinct = np.unique(np.stack([low, high]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(distinct[0]), pa.array(distinct[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = [batch.column(c) for c in ("token", "i", "j")]
            # All but the last bucket of a batch are complete.
            last = batch.num_rows - 1
            while last > 0 and all(c[last - 1] == c[last] for c in key):
                last -= 1
            if last or len(held) > 1 and any(held[-2].column(c)[-1] != batch.column(c)[0] for c in ("token", "i", "j")):
                table = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
                held = [batch.slice(last)]
                if table.num_rows:
                    yield from found(table)
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    **carried: Column,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text with fewer words
    than ``width`` has one shingle, its whole sequence; a null text or one without words has none
    and links with nothing. Rows are linked when 100 times the common shingles are at least
    ``percent`` times all shingles of both; ``component_id`` is the smallest id reachable. Repeated
    rows give a row each. A row with a null id has a null component and links nothing. Other columns
    are ignored; ids are integers. With ``carried`` columns, long or string, rows have these and
    ``n_words`` besides, so that who needs them does not read the texts again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    others = docs.select(*[c.alias(name) for name, c in carried.items()]).schema
    kinds = pa.schema([(f.name, pa.string() if f.dataType.typeName() == "string" else pa.int64()) for f in others])
    texts_and_others = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *[c.alias(name) for name, c in carried.items()],
    )
    types = [f"{f.name} {f.dataType.simpleString()}" for f in others]
    found = texts_and_others.mapInArrow(
        _sizes(width, kinds),
        ", ".join(["doc_id long, n_shingles long, key_a long, key_b long, n_words long, shingle long", *types]),
    )
    found = written(found, "sizes")
    sized = found.filter("shingle IS NULL").drop("shingle")
    named = sized.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Documents of equal sets are one class, which goes by its smallest id.
    member = with_first(named, ["n_shingles", "key_a", "key_b"], "doc_id")
    member = member.groupBy("doc_id").agg(F.min("first").alias("class"))
    member = written(member, "classes")

    texted = rows.filter("doc_id IS NOT NULL")
    counted = found.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n_shingles").alias("n"))
    counted = written(counted.withColumn("level", F.floor(8 * F.log2("n"))), "counts")
    # Eight levels for each doubling; as many of the highest as the table holds.
    level, room = None, FREQUENT
    for row in counted.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.col("level").desc()).collect():
        if row["k"] > room:
            break
        level, room = row["level"], room - row["k"]
    top = counted.filter(F.col("level") >= level if level is not None else F.lit(False)).select("shingle", "n").toArrow()
    frequent, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order, rank = np.argsort(frequent), np.zeros(len(frequent), np.uint64)
    rank[np.lexsort((frequent, n))] = np.arange(1, len(frequent) + 1, dtype=np.uint64)
    table = spark.sparkContext.broadcast((frequent[order], rank[order]))

    # A rare token is counted where it lands; a frequent one is spread, as it surely has company.
    n_rows = named.agg(F.sum(F.expr(f"n_shingles - floor(({percent} * n_shingles + 99) / 100) + 1"))).first()[0] or 0
    prefixes = texted.mapInArrow(_prefixes(width, percent, table, max(1, -(-n_rows // PART))), "part long, body binary")
    shared = prefixes.groupBy("part").applyInArrow(_in_company, "token long, doc long, place long")
    # Few documents go by another one's id, as a rule.
    moved = written(member.filter("class <> doc_id"), "moved")
    shared = (
        shared.join(moved, shared["doc"] == moved["doc_id"], "left")
        .groupBy("token", F.coalesce("class", "doc").alias("doc"))
        .agg(F.min("place").alias("place"))
    )
    shared = written(shared, "prefixes")
    # Of buckets with the same members one is enough: the filters hold for every common shingle.
    met = shared.groupBy("token").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")
    )
    met = met.filter("m > 1").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", "m")
    buckets = written(shared.join(met, "token"), "buckets")
    wanted = buckets.select(F.col("doc").alias("doc_id")).distinct()
    involved = texted.join(wanted, "doc_id", "leftsemi")
    if sized.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        involved = involved.dropDuplicates(["doc_id"])
    involved = written(
        involved.mapInArrow(_counted(width), "doc_id long, text string, n long, counts binary, bits binary"), "texts"
    )

    def side(name: str, *columns: str) -> DataFrame:
        return involved.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def verified(pairs: DataFrame) -> DataFrame:
        promising = pairs.join(side("a", "n", "counts"), "a").join(side("b", "n", "counts"), "b")
        promising = written(promising.mapInArrow(_promising(percent), "a long, b long"), "promising")
        # Only the texts of these pairs are sent.
        ends = written(promising.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
        text = written(involved.select("doc_id", "text").join(ends, "doc_id", "leftsemi"), "ended")
        text_a, text_b = (text.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = promising.join(text_a, "a").join(text_b, "b")
        return written(both.mapInArrow(_verified(width, percent), "a long, b long"), "links")

    tested = written(_pairs(_leaders(buckets), buckets, percent), "pairs")
    links = verified(tested)
    labels = connected_components(links)
    bitmaps = involved.select(F.col("doc_id").alias("doc"), "bits")
    # Buckets of two have been compared, and small ones are in the first round, which takes all their pairs.
    rounds = [(True, 2), (False, TOGETHER)]
    # Where large buckets have many pairs, another sparse round leaves fewer of them to the last one.
    in_large = buckets.filter(F.col("m") > TOGETHER).agg(F.sum((F.col("m") - 1) / 2)).first()[0] or 0
    if in_large > MANY * member.count():
        rounds.insert(1, (True, TOGETHER))
    for sparse, compared in rounds:
        found = _open(buckets.filter(F.col("m") > compared), labels, bitmaps).mapInArrow(_open_pairs(percent, sparse), "a long, b long").distinct()
        found = written(found, "open")
        if found.limit(1).count() == 0:
            break
        pairs = written(found.join(tested, ["a", "b"], "leftanti"), "pairs")
        tested = tested.unionAll(pairs)
        more = verified(pairs)
        if more.limit(1).count():
            links = links.unionAll(more)
            labels = connected_components(links)

    joined = member.join(labels, member["class"] == labels["node"], "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "class").alias("component_id")
    )
    return sized.join(joined, sized["doc_id"] == joined["id"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        *(["n_words", *carried] if carried else []),
    )


def keep_one_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of the smallest id of every component, all columns.

    Of rows of one id, or without an id, that have the same text one stays, whichever.
    """
    found = jaccard_components(docs, width=width, percent=percent)
    others = found.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(others, "doc_id", "leftanti")
    digest = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    repeated = docs.groupBy("doc_id", *digest).count().filter("count > 1")
    if repeated.limit(1).count() == 0:
        return left
    # As a rule ids are unique, and no text is sent for this.
    marked = left.withColumns({"__a": digest[0], "__b": digest[1]})
    return marked.dropDuplicates(["doc_id", "__a", "__b"]).select(*docs.columns)


#: The components in SQL, by all pairs that share a shingle.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT node AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = node GROUP BY node
"""
