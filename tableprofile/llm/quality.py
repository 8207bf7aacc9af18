"""Quality rules: counts over whole texts, and line labels of a conditional random field.

Every line of a document is content or boilerplate. A linear-chain conditional random field scores
lines by their make-up and labels by the label before; Viterbi decoding finds the best sequence,
and a document stays if at least half of its characters in lines are content.

The field learns from documents labelled as a whole, whose lines all take the document's label: at
most ``SAMPLE`` documents of each label, those of the least hash of their id, and of each of them all
lines, or where these are more than ``STRETCH`` times ``STRETCHES``, as many stretches at even distances over
the whole text. So the fit has a bounded number of lines and of steps. Counts, features and decoding
cover every text in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.arrays import Words, mixed, slices, texts
from tableprofile.llm.scratch import small_batches

#: Labelled documents of each label that the field learns from, at most.
SAMPLE = 500
#: Lines of a stretch that is learnt from as one chain, and stretches of a document, at most.
STRETCH = 64
STRETCHES = 16
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CONTENT = 0.5
_SYMBOLS = b"#*$%&|<>"
_KINDS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "other": bytes(range(192, 256)),
    "digit": b"0123456789",
    "symbol": _SYMBOLS,
    "bang": b"!?",
    "stop": b".,;:",
    "space": b" \t\x0b\x0c\r",
    "piece": bytes(range(128, 192)),
}
_TABLES = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in _KINDS.items()}


class Field(NamedTuple):
    """Weights of the boilerplate label over standardised features, and of the four label changes."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """How much boilerplate is ahead of content, by line."""
        x = (features - self.mean) / self.scale
        return x @ self.weights[:-1] + self.weights[-1]


def _line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a character, their number of characters, and the first line of every text."""
    at = bounds - bounds[0]
    part = data[bounds[0] : bounds[-1]]
    breaks = part == 10
    starts = np.zeros(len(part) + 1, bool)
    starts[at[:-1]] = True
    starts[1:][breaks] = True
    start = np.flatnonzero(starts[: len(part)])
    end = np.r_[start[1:], len(part)]
    end = end - (breaks[np.maximum(end - 1, 0)] & (end > start)) if len(start) else end
    full = end > start
    start, end = start[full], end[full]
    sums = {}
    for name, table in _TABLES.items():
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(table[part], out=total[1:])
        sums[name] = (total[end] - total[start]).astype(float)
    chars = (end - start) - sums["piece"]
    n = np.maximum(chars, 1)
    letters = sums["upper"] + sums["lower"] + sums["other"]
    last = part[np.maximum(end - 1, 0)] if len(start) else part[:0]
    features = np.column_stack(
        [
            np.log1p(chars),
            letters / n,
            sums["upper"] / np.maximum(letters, 1),
            sums["digit"] / n,
            sums["symbol"] / n,
            sums["bang"] / n,
            sums["stop"] / n,
            (sums["space"] + 1) / n,
            sums["symbol"] > 2,
            np.isin(last, np.frombuffer(b".!?", np.uint8)),
        ]
    )
    return features, chars, np.searchsorted(start, at)


def viterbi(scores: list[float], moves: list[list[float]]) -> list[int]:
    """The best labels (1: boilerplate) of one text; content wins ties."""
    (stay, leave), (back, remain) = moves
    content, boiler, trace = 0.0, 0.0, []
    for k, s in enumerate(scores):
        if k == 0:
            content, boiler = 0.0, s
            continue
        from_content = content + stay >= boiler + back
        to_boiler = content + leave >= boiler + remain
        trace.append((0 if from_content else 1, 0 if to_boiler else 1))
        content, boiler = max(content + stay, boiler + back), max(content + leave, boiler + remain) + s
    if not scores:
        return []
    labels = [0 if content >= boiler else 1]
    for step in reversed(trace):
        labels.append(step[labels[-1]])
    return labels[::-1]


def stretches(lines: np.ndarray, size: int = STRETCH, most: int = STRETCHES) -> list[np.ndarray]:
    """A text's lines in stretches; of more than ``most``, those at even distances, the first and the last among them."""
    n = -(-len(lines) // size)
    chosen = range(n) if n <= most else np.unique(np.linspace(0, n - 1, most).round().astype(int)).tolist()
    return [lines[k * size : (k + 1) * size] for k in chosen]


def fit_field(texts_of: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.2, shrink: float = 1e-3) -> Field:
    """Weights of highest likelihood, each document counting once, by gradient ascent with momentum.

    Stretches of a document are chains of their own, so that the steps of a round have a bound.
    """
    cut = [(x, y, sum(map(len, parts))) for parts, y in zip(map(stretches, texts_of), labels) for x in parts]
    texts_of, labels, of_document = zip(*cut)
    every = np.concatenate(texts_of)
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    order = np.argsort([-len(x) for x in texts_of], kind="stable")
    xs = [np.c_[(texts_of[k] - mean) / scale, np.ones(len(texts_of[k]))] for k in order]
    ys = np.array([labels[k] for k in order])
    sizes = np.array([len(x) for x in xs])
    longest = int(sizes[0])
    at_step = [np.stack([x[t] for x, n in zip(xs, sizes) if n > t]) for t in range(longest)]
    alive = [int((sizes > t).sum()) for t in range(longest)]
    share = 1.0 / np.array([of_document[k] for k in order])
    documents = (share * sizes).sum()
    weights, moves = np.zeros(every.shape[1] + 1), np.zeros((2, 2))
    pace_w, pace_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(rounds):
        ahead = []
        for t in range(longest):
            emit = np.zeros((alive[t], 2))
            emit[:, 1] = at_step[t] @ weights
            if t:
                before = ahead[-1][: alive[t], :, None] + moves
                emit = emit + np.logaddexp(before[:, 0], before[:, 1])
            ahead.append(emit)
        grad_w, grad_m = -shrink * weights, -shrink * moves
        behind = np.zeros((len(xs), 2))
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            both = ahead[t] + behind[:n]
            p = np.exp(both - np.logaddexp(both[:, :1], both[:, 1:]))
            grad_w = grad_w + at_step[t].T @ ((ys[:n] - p[:, 1]) * share[:n]) / documents
            if t:
                emit = np.zeros((n, 2))
                emit[:, 1] = at_step[t] @ weights
                pair = ahead[t - 1][:n, :, None] + moves + (emit + behind[:n])[:, None, :]
                flat = pair.reshape(n, 4)
                q = np.exp(flat - flat.max(1, keepdims=True))
                q = (q / q.sum(1, keepdims=True)).reshape(n, 2, 2)
                seen = np.zeros((n, 2, 2))
                seen[np.arange(n), ys[:n], ys[:n]] = 1
                grad_m = grad_m + ((seen - q) * share[:n, None, None]).sum(0) / documents
                step = moves + (emit + behind[:n])[:, None, :]
                behind[:n] = np.logaddexp(step[:, :, 0], step[:, :, 1])
        pace_w, pace_m = 0.9 * pace_w + grad_w, 0.9 * pace_m + grad_m
        weights, moves = weights + rate * pace_w, moves + rate * pace_m
    return Field(mean, scale, weights, moves)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field learnt from labelled documents; None unless both labels occur."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = None
    for label in (0, 1):
        of = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = of if chosen is None else chosen.unionAll(of)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            out = []
            for i in range(len(bounds) - 1):
                parts = stretches(_line_features(data, bounds[i : i + 2])[0].astype(np.float32))
                out.append(b"".join(x.tobytes() for x in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "lines"]
            )

    texted = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texted.dropDuplicates(["doc_id"]).select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(
        lines, "doc_id long, quality int, lines binary"
    )
    # At most twice the sample, of 1,024 lines each; a line is 40 bytes.
    found = rows.orderBy("doc_id").collect()
    if len({r["quality"] for r in found if r["lines"]}) < 2:
        return None
    width = _line_features(np.frombuffer(b"x", np.uint8), np.array([0, 1]))[0].shape[1]
    return fit_field(
        [np.frombuffer(r["lines"], np.float32).reshape(-1, width).astype(float) for r in found],
        [1 - r["quality"] for r in found],
    )


def _repeat_words(words: Words, window: int) -> np.ndarray:
    """Words of every text that are in windows found twice or more in it.

    Hashes only propose windows; equal ones are compared word by word.
    """
    out = np.zeros(len(words.first) - 1, np.int64)
    start = np.flatnonzero(words.fits(window))
    if not len(start):
        return out
    keys = mixed(words.grams(window)[start] ^ mixed(words.doc[start].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    proposed = np.zeros(len(start), bool)
    proposed[order[1:][same]] = True
    proposed[order[:-1][same]] = True
    at = start[proposed]
    raw = words.bytes.tobytes()
    for d in np.unique(words.doc[at]):
        groups: dict[tuple, list[int]] = {}
        for k in at[words.doc[at] == d].tolist():
            groups.setdefault(tuple(raw[s:e] for s, e in zip(words.start[k : k + window], words.end[k : k + window])), []).append(k)
        found = [k for group in groups.values() if len(group) > 1 for k in group]
        covered = (np.asarray(found, np.int64)[:, None] + np.arange(window)).ravel()
        out[d] = len(np.unique(covered))
    return out


def _judged(field: Field | None, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    moves = field.moves.tolist() if field else [[0.0, 0.0], [0.0, 0.0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            columns: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "n_boilerplate")}
            for i, j in slices(bounds):
                words = Words(data, bounds, i, j)
                part, at = words.bytes, bounds[i : j + 1] - bounds[i]
                chars = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
                per_word = np.r_[0, np.cumsum(chars[words.end] - chars[words.start])]
                symbols = np.r_[0, np.cumsum(_TABLES["symbol"][part])]
                columns["n_words"].extend(np.diff(words.first).tolist())
                columns["word_chars"].extend((per_word[words.first[1:]] - per_word[words.first[:-1]]).tolist())
                columns["n_symbols"].extend((symbols[at[1:]] - symbols[at[:-1]]).tolist())
                columns["n_repeat_words"].extend(_repeat_words(words, window).tolist())
                features, sizes, first = _line_features(data, bounds[i : j + 1])
                scores = field.scores(features).tolist() if field else [-1.0] * len(features)
                sizes = sizes.tolist()
                raw = part.tobytes()
                for d in range(j - i):
                    a, b = first[d], first[d + 1]
                    labels = viterbi(scores[a:b], moves)
                    total = sum(sizes[a:b])
                    content = sum(n for n, label in zip(sizes[a:b], labels) if not label)
                    columns["content_share"].append(content / total if total else 0.0)
                    columns["n_boilerplate"].append(sum(labels))
                    lines = [x for x in raw[at[d] : at[d + 1]].split(b"\n") if x.strip()]
                    columns["n_dup_lines"].append(len(lines) - len(set(lines)))
            kinds = {"content_share": pa.float64()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()]],
                ["doc_id", *columns],
            )

    return run


def judge(docs: DataFrame, field: Field | None, window: int = WINDOW) -> DataFrame:
    """Counts, ``content_share`` and ``kept`` of every row.

    ``n_words``: runs of anything but ASCII white space; ``word_chars``: code points in them;
    ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an
    earlier line; ``n_repeat_words``: words in windows of eight found twice or more in the text;
    ``n_boilerplate``: lines so labelled. ``base_failed``: fewer than 20 words, or more than 30 % of
    them in repeated windows. A null text counts as empty and fails. Without a field every line is
    content. Repeated rows and null ids give a row each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(
        _judged(field, window),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " content_share double, n_boilerplate long",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("content_share") >= MIN_CONTENT)
    )
