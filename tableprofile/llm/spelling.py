"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary is put into blocked Bloom filters, one or more per word length. Every word's deletions
and replacements are generated as hashes in numpy, a few operations per edit, and looked up in the
filters, which executors hold as a broadcast. Only edits that a filter knows become strings; an exact
join with the vocabulary drops the false ones. An insertion is the deletion of the other word, and a
replacement is generated from the smaller letter only, so every pair is found once.

A broadcast never has more than ``BROADCAST`` bytes: a larger vocabulary takes several rounds, each
with the filters of some lengths, or of some hash shards of one length. Rounds change the cost, not
the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.arrays import mixed
from tableprofile.llm.scratch import written
from tableprofile.llm.words import ascii_lower, whole

#: Letters of a word: all are single bytes in Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
#: Least code points and occurrences of a word, and how often more a form must occur.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many has a letter dropped before words are counted (see ``vocabulary``).
DROPPED = 31
#: Bits of a filter per word, bytes of a block, bytes built in one task, bytes sent to an executor at once.
BITS, BLOCK, SEGMENT, BROADCAST = 16, 64, 1 << 13, 1 << 25
#: Edits looked up at once, and words whose edits a task looks up.
PROBES = 1 << 19
WORDS = 1 << 15
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))

Part = tuple[int, int, int, int]  # shard, number of shards, first block, number of blocks


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n``: runs of letters, A-Z in lower case, that occur often enough.

    Of every run whose checksum with the document's id is a multiple of 31, one letter is dropped, as
    a source of misspellings that is the same on every run. A null text has no words, a null id counts
    as an empty one, rows of one id are counted each; other columns are ignored. Runs are counted
    where they are read and then once more by word, so that a frequent word is one row per task.
    """
    runs = F.regexp_extract_all(whole(F.col("text")), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.select(whole(F.col("doc_id")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", ascii_lower(F.col("run")).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = rows.select(F.when(F.col("h") % DROPPED == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = found.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _terms(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What every letter adds to its word's hash, and the powers of the places."""
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(letters.shape[1] - 1, _POWER)])
    return _VALUES[letters] * powers, powers


def hashes(letters: np.ndarray) -> np.ndarray:
    return mixed(_terms(letters)[0].sum(axis=1, dtype=np.uint64))


def _place(x: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)


def _lanes(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two of a block's eight lanes, with three bits to set in each."""
    out = []
    for shift in (0, 21):
        y = mixed(x + np.uint64(shift + 1))
        lane = (y & np.uint64(3)) + np.uint64(0 if shift == 0 else 4)
        mask = np.zeros(len(x), np.uint64)
        for k in range(3):
            mask |= np.uint64(1) << ((y >> np.uint64(8 + 6 * k)) & np.uint64(63))
        out.append((lane, mask))
    return out


def known(filters: np.ndarray, parts: list[Part], x: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filters of a length may have; the rest is surely not there."""
    found = []
    for shard, shards, first, blocks in parts:
        at = np.flatnonzero(x % np.uint64(shards) == shard) if shards > 1 else np.arange(len(x))
        for step in range(2):
            lane, mask = _lanes(x[at])[step]
            word = filters[(_place(x[at], blocks) + np.uint64(first)) * np.uint64(BLOCK // 8) + lane]
            at = at[(word & mask) == mask]
        found.append(at)
    return np.concatenate(found)


def edits(words: list[str], alphabet: np.ndarray, filters: np.ndarray, parts: dict[int, list[Part]]) -> Iterator[tuple[list[int], list[str]]]:
    """Deletions and replacements, of words of one length, that the filters know: index of the word, and edit."""
    letters = codes(words)
    n, length = letters.shape
    terms, powers = _terms(letters)
    total = terms.sum(axis=1, dtype=np.uint64)
    if length - 1 in parts:
        # Of a letter's repetitions the last one is deleted: the others give the same word.
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        gone = before + (total[:, None] - before - terms) * _INVERSE
        own = np.ones(letters.shape, bool)
        own[:, :-1] = letters[:, 1:] != letters[:, :-1]
        flat = np.flatnonzero(own)
        flat = flat[known(filters, parts[length - 1], mixed(gone.reshape(-1)[flat]))]
        for k in range(0, len(flat), PROBES // length + 1):
            rows, at = np.divmod(flat[k : k + PROBES // length + 1], length)
            yield rows.tolist(), [words[r][:i] + words[r][i + 1 :] for r, i in zip(rows.tolist(), at.tolist())]
    if length in parts:
        values = _VALUES[alphabet]
        step = max(1, PROBES // (n * len(alphabet)))
        for i in range(0, length, step):
            here = letters[:, i : i + step]
            larger = np.flatnonzero(alphabet[None, None, :] > here[:, :, None])
            rest, k = np.divmod(larger, len(alphabet))
            rows, at = np.divmod(rest, here.shape[1])
            x = total[rows] - terms[rows, at + i] + values[k] * powers[at + i]
            hit = known(filters, parts[length], mixed(x))
            rows, at, put = rows[hit].tolist(), (at[hit] + i).tolist(), alphabet[k[hit]].tolist()
            yield rows, [words[r][:a] + chr(c) + words[r][a + 1 :] for r, a, c in zip(rows, at, put)]


def _by_length(batches: Iterator[pa.RecordBatch], limit: Callable[[int], int]) -> Iterator[tuple[list[str], list[int]]]:
    """Words and counts of one length each, at most ``limit(length)`` at once."""
    for batch in batches:
        words, counts = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == length)
            for k in range(0, len(at), limit(length)):
                part = at[k : k + limit(length)]
                yield words[part].tolist(), counts[part].tolist()


def _rounds(lengths: dict[int, int], limit: int) -> list[dict[int, list[tuple[int, int, int]]]]:
    """Which shards of which lengths are looked up together: per length (shard, shards, blocks)."""
    out: list[dict[int, list[tuple[int, int, int]]]] = [{}]
    used = 0
    for length, n in sorted(lengths.items()):
        need = max(1, -(-n * BITS // (8 * BLOCK)))
        shards = -(-need * BLOCK // limit)
        blocks = -(-need // shards)
        for shard in range(shards):
            if used + blocks * BLOCK > limit and out[-1]:
                out.append({})
                used = 0
            out[-1].setdefault(length, []).append((shard, shards, blocks))
            used += blocks * BLOCK
    return out


def _filled(vocab: DataFrame, plan: dict[int, list[tuple[int, int, int]]]) -> tuple[Broadcast, dict[int, list[Part]]]:
    """The filters of a round. Each segment is built by one task; the driver strings them together."""
    parts: dict[int, list[Part]] = {}
    blocks = 0
    for length, shards in plan.items():
        for shard, of, n in shards:
            parts.setdefault(length, []).append((shard, of, blocks, n))
            blocks += n
    per = SEGMENT // BLOCK

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _by_length(batches, lambda length: max(1, PROBES // length)):
            x = hashes(codes(words))
            for shard, of, first, n in parts.get(len(words[0]), []):
                own = x[x % np.uint64(of) == shard]
                block = (_place(own, n) + np.uint64(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((block // per).astype(np.int32)), pa.array((block % per).astype(np.int32)), pa.array(own.view(np.int64))],
                    ["segment", "block", "x"],
                )

    def build(table: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT // 8, np.uint64)
        block = table.column("block").to_numpy().astype(np.uint64) * np.uint64(BLOCK // 8)
        for lane, mask in _lanes(table.column("x").to_numpy().view(np.uint64)):
            np.bitwise_or.at(out, block + lane, mask)
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    segments = (
        vocab.filter(F.length("word").isin(list(plan)))
        .mapInArrow(places, "segment int, block int, x long")
        .groupBy("segment")
        .applyInArrow(build, "segment int, bits binary")
    )
    filters = np.zeros((-(-blocks // per), SEGMENT // 8), np.uint64)
    for row in segments.collect():  # at most BROADCAST bytes and a segment
        filters[row["segment"]] = np.frombuffer(row["bits"], np.uint64)
    return vocab.sparkSession.sparkContext.broadcast(filters.reshape(-1)), parts


def near_pairs(vocab: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every two words one edit apart, once, in either order.

    ``vocab`` has each ``word`` once. Without words there are no pairs. A word has no more partners
    than it has edits, some 180 per letter, so no key of the join can grow with the table.
    """
    sizes = vocab.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in sizes.collect()}  # a row per word length
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint8)  # of the 116 in LETTERS
    found = None
    for plan in _rounds(lengths, limit):
        if not plan:
            continue
        filters, parts = _filled(vocab, plan)

        def probe(batches: Iterator[pa.RecordBatch], filters: Broadcast = filters, parts: dict = parts) -> Iterator[pa.RecordBatch]:
            for words, counts in _by_length(batches, lambda length: max(1, PROBES // (length * len(alphabet)))):
                for rows, edited in edits(words, alphabet, filters.value, parts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([words[r] for r in rows], pa.string()),
                            pa.array([counts[r] for r in rows], pa.int64()),
                            pa.array(edited, pa.string()),
                        ],
                        ["word", "n", "near"],
                    )

        lengths_here = sorted({x for length in plan for x in (length, length + 1)})
        # Words take long and few bytes, so their number says into how many parts they are dealt.
        tasks = -(-sum(lengths.get(n, 0) for n in lengths_here) // WORDS)
        some = vocab.filter(F.length("word").isin(lengths_here)).repartition(tasks, F.xxhash64("word"))
        part = some.mapInArrow(probe, "word string, n long, near string")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return vocab.limit(0).select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, where the chain of ``form`` ends; ``forms`` has words that have a form only.

    Each round follows as many steps as all rounds before together. A form occurs ten times as often
    as its word, so chains end after a few steps and cannot close.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if steps.filter("moved").limit(1).count() == 0:
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, limit: int = BROADCAST) -> DataFrame:
    """``word``, its ``form`` and ``root``, ``n``, ``n_near`` and ``form_n`` for every word of ``docs``.

    A word's form is the near word of largest count, of smaller code points where counts tie, if it
    occurs ``ratio`` times as often; the root is the last form along the chain. See ``vocabulary``
    for nulls, repeated rows and other columns; without words there are no rows. A run of letters of
    any length is one word.
    """
    vocab = written(vocabulary(docs), "vocabulary")
    pairs = near_pairs(vocab, limit)
    ends = F.array(
        F.struct(F.col("word"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")).alias("other")),
        F.struct(F.col("near").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("form")).alias("other")),
    )
    best = pairs.select(F.inline(ends)).groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    is_form: Column = -F.col("best.n") >= ratio * F.col("n")
    told = written(
        vocab.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.form")).alias("form"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        ),
        "variants",
    )
    ended = roots(told.filter(F.col("form").isNotNull()))
    return told.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
