"""Toxicity by noisy-channel deobfuscation.

Obfuscated tokens (leetspeak, letters spaced out, letters repeated) are lattices of characters: a
digit or sign may stand for a letter, be noise or break the word; a separator between single
letters may be dropped; a run of a letter may be shorter. Viterbi decoding finds the likeliest
reading under a character language model, and the restored words are scored by a logistic
regression. A token of plain letters without a doubled one has a single reading and needs no
decoding; a sign at the end of a token may be a letter or an ornament.

The language model mixes trigrams counted over all documents with four-grams of the words that the
regression weighs. The regression learns from at most ``SAMPLE`` rows of each label, those of the
least hash of their id, and at most ``CANDIDATES`` words. Every text is read and scored in full.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.arrays import slices, texts
from tableprofile.llm.scratch import small_batches, written
from tableprofile.llm.words import held_out

SAMPLE = 4000
CANDIDATES = 2000
#: Lengths of the beginnings of words that are features beside whole words; these end in ``*``.
PREFIXES = (4, 5, 6, 7)
#: Toxic rows of the sample that a candidate is in, at least, and its odds against other rows.
MIN_ROWS = 3
MIN_ODDS = 3.0
#: Letters that a sign may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
    "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz", "%": "abcdefghijklmnopqrstuvwxyz",
}
_WILD_SIGNS = frozenset(c for c, letters in LEET.items() if len(letters) > 2)
_LETTERS = " abcdefghijklmnopqrstuvwxyz?"
_SIZE = len(_LETTERS)
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|~^=/\\-_+`"
_INNER = re.compile(r"(.)\1\1|[0-9@$!|+€£(*#%]|[^\W\d_][.\-_~'][^\W\d_]")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
#: Marks at the end of a token that cannot stand for a letter.
_MARKS = "".join(c for c in _EDGE if c not in LEET)
_SPACED = re.compile(r"(?<!\w)[\w@$!|+*](?:[ .\-_*~][\w@$!|+*]){2,}(?!\w)")
#: Log probabilities of the channel.
_SUBSTITUTED, _WILD, _NOISE, _BREAK, _DROPPED, _SHORTENED = map(math.log, (0.5, 0.1, 0.02, 0.05, 0.3, 0.3))
REMEMBERED = 1 << 16
#: Runs of characters of a token that are read at once.
PIECE = 256


def _fold_table() -> np.ndarray:
    """Number in the model's alphabet of every code point: letters without marks, breaks, and others."""
    table = np.zeros(0x110000, np.int64)
    table[0x250:] = _SIZE - 1
    for k in range(0x250):
        table[k] = _folded(chr(k))
    return table


def _folded(c: str) -> int:
    if not c.isalpha():
        return 0
    at = _LETTERS.find(unicodedata.normalize("NFKD", c.lower())[0])
    return at if at > 0 else _SIZE - 1


class Model(NamedTuple):
    """Trigram counts over the corpus; features with weights; the score of a text without any of them."""

    trigrams: np.ndarray
    weights: dict[str, float]
    offset: float


class Decoder:
    """Likeliest readings under the language model."""

    def __init__(self, model: Model, share: float = 0.3):
        tri = model.trigrams.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1)) + 1
        uni = uni / uni.sum()
        bi_p = (bi + 50 * uni) / (bi.sum(1, keepdims=True) + 50)
        tri_p = (tri + 50 * bi_p[None]) / (tri.sum(2, keepdims=True) + 50)
        four = np.zeros((_SIZE,) * 4)
        for word, weight in model.weights.items():
            if weight > 0:
                codes = [0, 0, 0, *map(_folded, word[:-1])] if word[-1] == "*" else [0, 0, 0, *map(_folded, word), 0]
                for k in range(3, len(codes)):
                    four[tuple(codes[k - 3 : k + 1])] += weight
        total = four.sum(3, keepdims=True)
        known = np.divide(four, total, out=np.zeros_like(four), where=total > 0)
        self._log = np.log((1 - share) * tri_p[None] + share * known).astype(np.float32)
        self._flat = self._log.ravel().tolist()
        self._known: dict[str, str] = {}
        self._told: dict[tuple[str, int, bool, bool], list[tuple[tuple[int, ...], float]]] = {}

    def _options(self, c: str, spaced: bool) -> list[tuple[int, float]]:
        """What a character may stand for: number of a letter (-1: nothing, 0: a break) and log probability."""
        letter = _folded(c)
        if letter:
            return [(letter, 0.0)]
        if c in LEET:
            signs = LEET[c]
            p = _WILD if len(signs) > 2 else _SUBSTITUTED - math.log(len(signs))
            return [*((_LETTERS.index(s), p) for s in signs), (-1, _NOISE), (0, _BREAK)]
        return [(-1, _DROPPED if spaced else _NOISE), (0, _BREAK if not spaced else _DROPPED)]

    def _trailing(self, c: str, spaced: bool) -> list[tuple[int, float]]:
        return [(s, _DROPPED if s == -1 else p) for s, p in self._options(c, spaced)]

    def read(self, token: str) -> str:
        """The likeliest reading of a token, or of letters with separators, as words of a-z."""
        found = self._known.get(token)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            found = self._known[token] = self._decode(token)
        return found

    def _steps(self, token: str) -> list[list[tuple[tuple[int, ...], float]]]:
        """Per run of a character what it may be read as: letters (none: nothing) and log probability."""
        spaced = _SPACED.fullmatch(token) is not None
        tail = len(token.rstrip(_EDGE))
        runs, k = [], 0
        while k < len(token):
            run = 1
            while k + run < len(token) and token[k + run] == token[k]:
                run += 1
            runs.append((token[k], run, k < tail))
            k += run
        told = [self._readings(c, min(run, 3), inside, spaced) for c, run, inside in runs]
        wild = [c in _WILD_SIGNS for c, _, _ in runs]
        for i in range(len(runs) - 2) if sum(wild) > 2 else ():
            # Three different signs for any letter, one after the other, hide no word that could be told.
            if all(wild[i : i + 3]):
                told[i : i + 3] = [[((), _NOISE), ((0,), _BREAK)]] * 3
        return told

    def _readings(self, c: str, run: int, inside: bool, spaced: bool) -> list[tuple[tuple[int, ...], float]]:
        """What a run of a character may be read as; remembered."""
        key = (c, run, inside, spaced)
        found = self._told.get(key)
        if found is None:
            # A sign behind the last letter may be a letter, but is as likely an ornament.
            single = self._options(c, spaced) if inside else self._trailing(c, spaced)
            # A run of a character reads as one, two or all of them; longer runs are noise or emphasis.
            lengths = {1: 0.0} if run == 1 else {1: _SHORTENED, 2: _SHORTENED if run > 2 else 0.0}
            found = [((s,) * n if s >= 0 else (), p + q) for s, p in single for n, q in lengths.items() if s > 0 or n == 1]
            if len(self._told) < REMEMBERED:
                self._told[key] = found
        return found

    def _decode(self, token: str) -> str:
        steps = self._steps(token)
        many = sum(len(options) > _SIZE for options in steps) > 1
        read = self._by_arrays if many else self._by_states
        # Far longer than a word: in pieces, which bounds what is remembered.
        pieces = [read(steps[k : k + PIECE]) for k in range(0, len(steps), PIECE)]
        return "".join(_LETTERS[s] for piece in pieces for s in piece)

    def _by_states(self, steps: list[list[tuple[tuple[int, ...], float]]]) -> list[int]:
        """Viterbi over the states that occur, for lattices of few; a state is the last three symbols."""
        flat, size, square = self._flat, _SIZE, _SIZE * _SIZE
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for options in steps:
            after: dict[int, tuple[float, tuple]] = {}
            for state, (score, path) in states.items():
                for symbols, p in options:
                    key, total, trace = state, score + p, path
                    for s in symbols:
                        if s or key % size:
                            total += flat[key * size + s]
                            trace = (trace, s)
                            key = key % square * size + s
                    if key not in after or after[key][0] < total:
                        after[key] = (total, trace)
            states = after
        best = max(states.items(), key=lambda kv: kv[1][0] + flat[kv[0] * size])[1][1]
        out = []
        while best:
            best, s = best
            out.append(s)
        return out[::-1]

    def _by_arrays(self, steps: list[list[tuple[tuple[int, ...], float]]]) -> list[int]:
        """The same over all states at once, for lattices with several signs that may be any letter."""
        size, pairs = _SIZE, _SIZE * _SIZE
        log = self._log.reshape(size, pairs, size)
        score = np.full(size * pairs, -np.inf)
        score[0] = 0.0
        trail = []
        for options in steps:
            new = np.full(size * pairs, -np.inf)
            origin, emitted = np.zeros(size * pairs, np.int32), np.zeros(size * pairs, np.int16)

            def offer(keys: np.ndarray, totals: np.ndarray, came: np.ndarray, code: np.ndarray) -> None:
                better = totals > new[keys]
                at = keys[better]
                new[at], origin[at], emitted[at] = totals[better], came[better], code[better]

            active = np.flatnonzero(score > -np.inf)
            xs, yz = np.unique(active // pairs), np.unique(active % pairs)
            y, z = yz // size, yz % size
            came = score.reshape(size, pairs)[np.ix_(xs, yz)]
            for symbols, p in options:
                if not symbols or symbols == (0,):
                    # Nothing, or a break where there is one already.
                    stay = active if not symbols else active[active % size == 0]
                    offer(stay, score[stay] + p, stay, np.zeros(len(stay), np.int16))
            single = [(s[0], p) for s, p in options if len(s) == 1]
            if single:
                letters, chance = np.array([s for s, _ in single]), np.array([p for _, p in single])
                totals = came[:, :, None] + log[np.ix_(xs, yz, letters)]
                best, which = totals.max(axis=0), xs[totals.argmax(axis=0)] * pairs + yz[:, None]
                if letters[-1] == 0:
                    best[z == 0, -1] = -np.inf
                keys = yz[:, None] * size + letters
                code = np.broadcast_to(letters + 1, keys.shape).astype(np.int16)
                offer(keys.ravel(), (best + chance).ravel(), which.ravel(), code.ravel())
                double = {s[0]: p for s, p in options if len(s) == 2}
                if double:
                    chosen = np.flatnonzero([s in double for s in letters])
                    twice = letters[chosen]
                    chance2 = np.array([double[s] for s in twice.tolist()])
                    totals = best[:, chosen] + self._log[y[:, None], z[:, None], twice, twice] + chance2
                    for last in np.unique(z).tolist():
                        rows = np.flatnonzero(z == last)
                        top = totals[rows].argmax(axis=0)
                        keys = (last * size + twice) * size + twice
                        column = np.arange(len(twice))
                        offer(keys, totals[rows][top, column], which[:, chosen][rows][top, column], (twice + 1 + 100).astype(np.int16))
            trail.append((origin, emitted))
            score = new
        at = int((score + self._log.reshape(-1, size)[:, 0]).argmax())
        out = []
        for origin, emitted in reversed(trail):
            code = int(emitted[at])
            out += [code - 101] * 2 if code > 100 else [code - 1] if code else []
            at = int(origin[at])
        return out[::-1]


#: Decoders of a worker's process, by what they are made of.
_decoders: dict[int, Decoder] = {}


def decoder_of(model: Model) -> Decoder:
    """The decoder of a task's process, with the readings that earlier tasks found."""
    key = hash((model.trigrams.tobytes(), tuple(sorted(model.weights.items()))))
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(model)
    return _decoders[key]


def _suspect(token: str) -> str | None:
    """What is to be decoded of a token, or None if it is plain."""
    core = token.rstrip(_EDGE)
    lead = core.lstrip(_EDGE)
    # One sign in front may be a letter; more of them are ornament.
    if len(core) - len(lead) == 1 and core[0] in LEET:
        lead = core
    return lead if lead and _INNER.search(lead) and _HAS_LETTER.search(lead) else None


def _signed(token: str) -> str | None:
    """The token with the signs at its end that may be letters, or None if it ends otherwise."""
    core = token.rstrip(_MARKS)
    if not core or core[-1] not in _EDGE or not _HAS_LETTER.search(core):
        return None
    lead = core.lstrip(_EDGE)
    return core if len(core) - len(lead) == 1 and core[0] in LEET else lead


def restored_words(text: str, decoder: Decoder | None) -> set[str]:
    """Distinct words of a text in lower case, with the readings of its obfuscated tokens."""
    lower = text.lower()
    words = set(_WORD.findall(lower))
    if decoder is not None:
        for token in set(lower.split()):
            # Letters between marks: doubled ones are looked at below.
            if token.strip(_MARKS).isalpha():
                continue
            for core in (_suspect(token), _signed(token)):
                if core is not None:
                    words.update(decoder.read(core).split())
        for word in [w for w in words if _DOUBLED.search(w)]:
            words.update(decoder.read(word).split())
        for run in _SPACED.finditer(lower):
            words.update(decoder.read(run.group()).split())
    return words


def beginnings(words: set[str]) -> set[str]:
    return {f"{w[:k]}*" for k in PREFIXES for w in words if len(w) > k}


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigrams of letters (without marks) and breaks over all texts; one row per task and trigram meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _fold_table(), np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            for i, j in slices(bounds):
                strings = [data[a:b].tobytes().decode() for a, b in zip(bounds[i:j], bounds[i + 1 : j + 1])]
                codes = table[np.frombuffer(("\n\n" + "\n\n".join(strings) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
                total += np.bincount((codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    counts = np.zeros(_SIZE**3, np.int64)
    # At most 28 to the third power rows.
    for r in rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts


def _logistic(rows: list[list[int]], y: np.ndarray, width: int, shrink: float = 0.03, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression over sets of feature numbers, by scaled gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    w, b = np.zeros(width), 0.0
    curve = 0.25 * np.bincount(feature, np.bincount(at, minlength=len(rows))[at].astype(float), width) + shrink
    for _ in range(rounds):
        z = b + np.bincount(at, w[feature], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = y - p
        w = w + (np.bincount(feature, error[at], width) - shrink * w) / curve
        b = b + error.sum() / (0.25 * len(rows) + 1e-9)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES) -> Model:
    """A model whose trigrams are of all documents, and whose weights are of labelled rows not held out."""
    small_batches(docs.sparkSession)
    trigrams = count_trigrams(docs)
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for label in (0, 1):
        of = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = of if chosen is None else chosen.unionAll(of)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                words = restored_words(text.as_py() or "", None)
                found.append(sorted(words | beginnings(words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "words"]
            )

    texted = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # Copies of a text count once, as toxic if one of them is.
    rows = texted.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    rows = written(rows.mapInArrow(listed, "toxic int, words array<string>"), "words")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        rate = n_toxic / max(1, n_toxic + n_other)
        return Model(trigrams, {}, 4.0 if rate > 0.5 else -4.0)
    words = (
        rows.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .filter(F.col("t") >= MIN_ROWS)
        .withColumn("odds", (F.col("t") + 0.5) / n_toxic / ((F.col("c") + 0.5) / n_other))
        .filter((F.col("odds") >= MIN_ODDS))
        .orderBy((F.col("t") * F.log("odds")).desc(), "word")
        .limit(candidates)
    )
    lexicon = [r["word"] for r in words.select("word").collect()]
    number = {w: k for k, w in enumerate(lexicon)}
    # Of the bounded sample, the candidates of each row.
    held = rows.select("toxic", F.array_intersect("words", F.array(*map(F.lit, lexicon)).cast("array<string>")).alias("words"))
    sets = sorted((r["toxic"], sorted(number[w] for w in r["words"])) for r in held.collect())
    weights, offset = _logistic([s for _, s in sets], np.array([t for t, _ in sets], float), len(lexicon))
    return Model(trigrams, {w: round(float(x), 6) for w, x in zip(lexicon, weights) if abs(x) >= 0.05}, round(offset, 6))


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, lexicon = decoder_of(model), dict(model.weights)
        for word, weight in model.weights.items():
            # Decoded readings have no marks.
            bare = "".join(c if c == "*" else _LETTERS[_folded(c)] for c in word)
            lexicon[bare] = max(weight, lexicon.get(bare, weight))
        whole = {w for w in lexicon if w[-1] != "*"}
        begins = [(k, {w[:-1] for w in lexicon if w[-1] == "*" and len(w) == k + 1}) for k in PREFIXES]
        for batch in batches:
            scores, found = [], []
            for text in batch.column("text"):
                words = restored_words(text.as_py() or "", decoder)
                hits = sorted(whole & words)
                for k, known in begins:
                    if known:
                        hits += sorted(f"{w}*" for w in known & {w[:k] for w in words if len(w) > k})
                z = model.offset + sum(lexicon[w] for w in hits)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                found.append(hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))],
                ["doc_id", "score", "words"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: likelier toxic) and the scored ``words`` of every row.

    ``text`` is the only input; a null or empty text has the score of a text without known words.
    Repeated rows and null ids give a row each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double, words array<string>")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, verdict and fold of every document, learnt from the other folds."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
