"""Language identification by hierarchical discrimination.

Counts of hashed character n-grams are the features. Linear support vector machines, one for each
pair of families, vote for the language family first; then machines for each pair of languages
within it vote for the language. Only text decides; languages are those of the labelled rows.

The machines learn from a bounded sample: of each language at most ``SAMPLE`` documents, those of
the least hash of their id, and at most ``SAMPLE_ALL`` of all. Each machine is fitted by a task of its
own; weights alone, a vector per machine, come to the driver. Prediction reads every text in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprofile.llm.arrays import slices, texts
from tableprofile.llm.scratch import small_batches, written
from tableprofile.llm.words import held_out

SAMPLE = 400
SAMPLE_ALL = 4000
LOG_FEATURES = 13
UNKNOWN = "und"
#: Rows of even n-gram shares that a profile counts in, and how far texts of a language differ. Fixed values.
EVEN = 2.0
BETWEEN_TEXTS = 0.05
#: Families of common language codes; a code that is not here is a family of its own. Fixed values.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indic": "bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_letters: list[np.ndarray] = []


class Profile(NamedTuple):
    """Log shares of the n-grams of a language, with their mean and variance in texts of it."""

    logs: np.ndarray
    mean: float
    variance: float


class Model(NamedTuple):
    """Languages by family; for every machine its two sides, weights and offset; languages' profiles."""

    families: dict[str, list[str]]
    sides: list[tuple[str, str]]
    weights: np.ndarray
    offsets: np.ndarray
    profiles: dict[str, Profile]


def _table() -> np.ndarray:
    """Lower case of letters, and a space for everything else, by code point."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                table[k] = ord(c.lower()[0])
        _letters.append(table)
    return _letters[0]


def _grams(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of one to three characters: hash and number of the text, where there is a letter."""
    # Every text starts with a space of its own, so that no n-gram with two letters spans two texts.
    codes = np.frombuffer("".join("\n" + s for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = _table()[codes]
    doc = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
    letter = chars != 32
    h = np.zeros(len(chars), np.uint32)
    some = np.zeros(len(chars), bool)
    for k in range(3):
        n = len(chars) - k
        h = h[:n] * np.uint32(0x01000193) + chars[k:] * np.uint32(0x9E3779B1) + np.uint32(k)
        some = some[:n] | letter[k:]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        use = some & (doc[:n] == doc[k:])
        yield (mixed >> np.uint32(32 - LOG_FEATURES))[use], doc[:n][use]


def _features(text: str) -> np.ndarray:
    total = np.zeros(1 << LOG_FEATURES)
    for h, _ in _grams([text]):
        total += np.bincount(h, minlength=len(total))
    return total


def _machine(x: np.ndarray, y: np.ndarray, shrink: float = 1e-2, rounds: int = 200) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, both sides weighing the same, by descent."""
    mean = x.mean(0)
    scale = x.std(0) + 1e-4
    z = ((x - mean) / scale).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 0.5 / max(1e-9, float((share * (z * z).sum(1)).sum() + shrink))
    w, b, pace_w, pace_b = np.zeros(z.shape[1], np.float32), 0.0, 0.0, 0.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ w + b)) * y * share
        pace_w = 0.9 * pace_w + (z.T @ slack - shrink * w)
        pace_b = 0.9 * pace_b + float(slack.sum())
        w, b = w + step * pace_w, b + step * pace_b
    own = w / scale
    return own, float(b - own @ mean)


def _profile(x: np.ndarray) -> Profile:
    """Of the rows of a language; the fewer they are, the more n-grams count as possible."""
    share = (x.sum(0, dtype=float) + EVEN / x.shape[1]) / (len(x) + EVEN)
    logs = np.log(share)
    mean = float(share @ logs)
    return Profile(logs, mean, float(share @ logs**2) - mean**2)


def _sampled(docs: DataFrame, sample: int, sample_all: int) -> DataFrame:
    """``doc_id``, ``lang`` and ``text`` of the rows to learn from; of rows of one id and language one text."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.withColumn("of", F.xxhash64("text"))
    n_languages = known.select("lang").distinct().count()
    each = max(1, min(sample, sample_all // max(1, n_languages)))
    ids = known.groupBy("lang", "doc_id").agg(F.min("of").alias("of"))
    # Each task keeps the first few of a language before anything is sent.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("place", place).filter(F.col("place") <= each).select("lang", "doc_id", "of")
    rows = known.join(F.broadcast(chosen), ["lang", "doc_id", "of"])
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams that a text has, with their shares."""
    for batch in batches:
        at, shares = [], []
        for text in batch.column("text"):
            total = _features(text.as_py())
            some = np.flatnonzero(total)
            at.append(some.astype(np.int32))
            shares.append((total[some] / max(1.0, total.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["doc_id", "lang", "at", "shares"],
        )


def _dense(table: pa.Table) -> np.ndarray:
    x = np.zeros((table.num_rows, 1 << LOG_FEATURES), np.float32)
    sizes = table.column("at").combine_chunks().value_lengths().to_numpy()
    at, shares = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "shares"))
    x[np.repeat(np.arange(table.num_rows), sizes), at] = shares
    return x


def _fitted(table: pa.Table) -> pa.Table:
    """One machine, from the rows of its two sides, or the profile of a language."""
    table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    side = table.column("side").to_numpy()
    if (side == 0).all():
        profile = _profile(_dense(table))
        out, numbers = profile.logs, [profile.mean, profile.variance]
    else:
        out, offset = _machine(_dense(table), side.astype(np.float32))
        numbers = [offset]
    return pa.table(
        {
            "number": table.column("number").slice(0, 1),
            "vector": pa.array([np.asarray(out, float).tobytes()], pa.binary()),
            "numbers": pa.array([numbers], pa.list_(pa.float64())),
        }
    )


def train(docs: DataFrame, sample: int = SAMPLE, sample_all: int = SAMPLE_ALL) -> Model:
    """A model from rows with a text and a language that are not held out."""
    spark = docs.sparkSession
    counted = _sampled(docs, sample, sample_all).mapInArrow(_counted, "doc_id long, lang string, at array<int>, shares array<float>")
    rows = written(counted, "grams")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model({}, [], np.zeros((1 << LOG_FEATURES, 0), np.float32), np.zeros(0), {})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(_FAMILY.get(lang.lower().split("-")[0], lang), []).append(lang)
    groups = [{f: members for f, members in families.items()}]
    groups += [{lang: [lang] for lang in members} for members in families.values()]
    # What is fitted, by number: machines first, then the languages' profiles. A row says which side a language is on.
    sides: list[tuple[str, str]] = []
    parts: list[tuple[int, str, int]] = []
    for group in groups:
        for a, b in combinations(sorted(group), 2):
            parts += [(len(sides), lang, 1) for lang in group[a]] + [(len(sides), lang, -1) for lang in group[b]]
            sides.append((a, b) if group is groups[0] else (f"/{a}", f"/{b}"))
    parts += [(len(sides) + k, lang, 0) for k, lang in enumerate(langs)]
    roles = spark.createDataFrame(parts, "number int, lang string, side int")
    fitted = rows.join(roles, "lang").groupBy("number").applyInArrow(_fitted, "number int, vector binary, numbers array<double>")
    found = {r["number"]: (np.frombuffer(r["vector"], float), r["numbers"]) for r in fitted.collect()}
    machines = [found[k] for k in range(len(sides))]
    stacked = np.stack([w for w, _ in machines], 1) if machines else np.zeros((1 << LOG_FEATURES, 0))
    profiles = {lang: Profile(found[len(sides) + k][0], *found[len(sides) + k][1]) for k, lang in enumerate(langs)}
    return Model(families, sides, stacked.astype(np.float32), np.array([n[0] for _, n in machines]), profiles)


def _elected(names: list[str], prefix: str, sides: list[tuple[str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winner of the pairwise votes by row, margins breaking ties, and how sure its closest vote is."""
    votes = np.zeros((len(margins), len(names)))
    sure = np.ones((len(margins), len(names)))
    number = {prefix + name: k for k, name in enumerate(names)}
    for k, (a, b) in enumerate(sides):
        if a in number and b in number:
            p = 1 / (1 + np.exp(-2 * np.clip(margins[:, k], -20, 20)))
            votes[:, number[a]] += (p >= 0.5) + p * 1e-3
            votes[:, number[b]] += (p < 0.5) + (1 - p) * 1e-3
            sure[:, number[a]] = np.minimum(sure[:, number[a]], p)
            sure[:, number[b]] = np.minimum(sure[:, number[b]], 1 - p)
    best = votes.argmax(1)
    return best, sure[np.arange(len(margins)), best]


def _likeness(model: Model, langs: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], count: np.ndarray) -> np.ndarray:
    """Mean log share of each text's n-grams in the profile of its language, in deviations from what is usual."""
    names = sorted(model.profiles)
    logs = np.stack([model.profiles[n].logs for n in names])
    which = np.array([names.index(lang) if lang in model.profiles else 0 for lang in langs])
    total = np.zeros(len(langs))
    for h, doc in grams:
        total += np.bincount(doc, logs[which[doc], h], len(langs))
    mean = np.array([model.profiles[n].mean for n in names])[which]
    variance = np.array([model.profiles[n].variance for n in names])[which]
    n = np.maximum(count, 1)
    # A character is in three n-grams.
    return (total / n - mean) / np.sqrt(3 * variance / n + BETWEEN_TEXTS)


def _predicted(model: Model, least: float | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    families = sorted(model.families)

    def of(strings: list[str]) -> tuple[list[str], np.ndarray]:
        total = np.zeros((len(strings), len(model.sides)))
        count = np.zeros(len(strings))
        grams = []
        for h, doc in _grams(strings):
            if least is not None:
                grams.append((h, doc))
            count += np.bincount(doc, minlength=len(strings))
            for k in range(len(model.sides)):
                total[:, k] += np.bincount(doc, model.weights[h, k], len(strings))
        margins = total / np.maximum(count, 1)[:, None] + model.offsets
        family, sure = _elected(families, "", model.sides, margins)
        langs = np.full(len(strings), UNKNOWN, object)
        score = np.zeros(len(strings))
        for f, name in enumerate(families):
            rows = np.flatnonzero((family == f) & (count > 0))
            if len(rows):
                members = model.families[name]
                best, inner = _elected(members, "/", model.sides, margins[rows])
                langs[rows] = np.array(members, object)[best]
                score[rows] = sure[rows] * inner
        if least is not None:
            unlike = _likeness(model, langs, grams, count) < least
            langs[unlike], score[unlike] = UNKNOWN, 0.0
        return langs.tolist(), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column("text"))
            langs, scores = [], []
            for i, j in slices(bounds):
                strings = [data[a:b].tobytes().decode() for a, b in zip(bounds[i:j], bounds[i + 1 : j + 1])]
                found, score = of(strings)
                langs += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in batch.schema.names],
                    pa.array(langs, pa.string()),
                    pa.array(np.concatenate(scores) if scores else np.zeros(0)),
                ],
                [*batch.schema.names, "__lang", "__score"],
            )

    return run


def identify(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """All rows and columns with ``__lang`` and ``__score`` (0 to 1).

    ``__lang`` is a learnt language, or ``und`` with score 0 if the text is null or has no letter,
    or nothing was learnt. With ``least`` a text is also ``und`` if its n-grams are less likely in
    the language that won than is usual there by more than that many standard deviations (a
    negative number): the votes always have a winner, however foreign the text. ``text`` is the
    only input.
    """
    if not model.families:
        return docs.withColumns({"__lang": F.lit(UNKNOWN), "__score": F.lit(0.0)})
    small_batches(docs.sparkSession)
    schema = docs.withColumns({"__lang": F.lit(""), "__score": F.lit(0.0)}).schema
    return docs.mapInArrow(_predicted(model, least), schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """Prediction and fold of every document, learnt from the other folds."""
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
    )
