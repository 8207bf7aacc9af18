"""Licence scan: ordered signature rules behind a keyword filter, overlaps resolved by containment.

Text is reduced to lower-case words (runs of a-z, 0-9 and all that is not ASCII) with one space
between, so that rules need not care for punctuation and positions are word numbers. Documents
without any keyword of any rule are done after one substring search per keyword. In the others,
rules whose keywords occur are matched; a detection goes if another of the same or a stronger
priority spans its words. Everything happens within a row: no shuffle, no Python.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.llm.license_rules import BASE, Rule, rules
from tableprofile.llm.words import ascii_lower, whole

#: What stands between words: all ASCII but letters and digits. Fixed values.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_SPAN = "array<struct<first:int,last:int>>"
_FOUND = "array<struct<first:int,back:int,priority:int,rule:int,label:string,score:double>>"
_LEVELS = 4
#: Detections of a block of the suppression.
_BLOCK = 256
#: Marks of a match's ends; no word holds them.
_OPEN, _CLOSE = "\x01", "\x02"


def _literal(value, schema: str) -> Column:
    """A constant of a nested type."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _gate(found_by: Sequence[tuple[str, ...]]) -> list[str]:
    """Single words of which every match holds one, as a substring of the raw text."""
    return sorted({max(keyword.split(), key=len) for keywords in found_by for keyword in keywords})


def _with(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _spans(canon: Column, pattern: Column) -> Column:
    """Numbers of the first and last word of every match of a pattern, from left to right.

    Matches begin and end at words: signs that no word has mark both ends, and words are looked
    through once for each, so that the work grows with the text and not with the matches' square.
    """
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    numbered = lambda words: F.transform(words, lambda w, i: F.struct((i - 1).alias("at"), w.alias("word")))
    ends = lambda words: F.zip_with(
        F.filter(words, lambda w: F.startswith(w["word"], F.lit(_OPEN))),
        F.filter(words, lambda w: F.endswith(w["word"], F.lit(_CLOSE))),
        lambda a, b: F.struct(a["at"].alias("first"), b["at"].alias("last")),
    )
    return _with(
        F.regexp_replace(canon, bounded, F.lit(f"{_OPEN}$0{_CLOSE}")),
        lambda text: F.when(
            F.contains(text, F.lit(_OPEN)), _with(numbered(F.split(text, " ", -1)), ends)
        ).otherwise(F.array().cast(_SPAN)),
    )


def _labelled(label: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(label).alias("label"), s["first"].alias("first"), s["last"].alias("last")))


def _reached(reach: Column, d: Column) -> Column:
    """How far each priority reaches, a detection included."""
    return F.transform(reach, lambda r, i: F.when(i + 1 >= d["priority"], F.greatest(r, -d["back"])).otherwise(r))


def _kept(found: Column) -> Column:
    """Detections that none of the same or a stronger priority spans.

    In the order of start, then longest, then strongest, whatever spans a detection comes before
    it; it is enough to carry how far each priority has reached. Detections go in blocks, so that
    no list is extended more than a block's or the blocks' number of times.
    """
    nothing = F.array_repeat(F.lit(-1), _LEVELS)
    blocks = lambda d: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(d) - 1) / _BLOCK).cast("int")), lambda b: F.slice(d, b * _BLOCK + 1, _BLOCK)
    )

    def carried(parts: Column) -> Column:
        """How far each priority reaches before every block."""
        before = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda block: F.aggregate(block, nothing, _reached))
        return F.aggregate(
            before,
            F.array(nothing),
            lambda acc, reach: F.concat(
                acc, F.array(F.zip_with(F.element_at(acc, -1), reach, lambda x, y: F.greatest(x, y)))
            ),
        )

    def step(acc: Column, d: Column) -> Column:
        covered = F.element_at(acc["reach"], d["priority"]) >= -d["back"]
        return F.struct(
            _reached(acc["reach"], d).alias("reach"),
            F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"),
        )

    def within(block: Column, reach: Column) -> Column:
        start = F.struct(reach.alias("reach"), F.array().cast(_FOUND).alias("kept"))
        return F.aggregate(block, start, step, lambda acc: acc["kept"])

    return _with(
        F.array_sort(found),
        lambda d: F.when(F.size(d) == 0, F.array().cast(_FOUND)).otherwise(
            _with(blocks(d), lambda parts: F.flatten(F.zip_with(parts, carried(parts), within)))
        ),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signatures: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: ``n_words``, ``base`` places and ``detections``.

    ``base`` holds (label, first, last) of the places of the base phrases; ``detections`` holds
    (rule, label, first, last, priority, score) of what is left of the rules' matches, by position.
    Words are numbered from 0. A null or empty text has no words and empty lists; repeated rows
    and null ids give a row each; other columns of the input are ignored.
    """
    signatures = rules() if signatures is None else list(signatures)
    # Base phrases are words alone, so that the longest word of each opens the gate.
    gate = _gate([(r.also,) if r.also else r.keywords for r in signatures] + [(phrase,) for _, _, phrase in BASE])
    table = _literal(
        [
            {"pattern": r.pattern, "label": r.label, "priority": r.priority, "rule": i, "score": r.score,
             "keywords": list(r.keywords), "also": r.also}
            for i, r in enumerate(signatures)
        ],
        "array<struct<pattern:string,label:string,priority:int,rule:int,score:double,keywords:array<string>,also:string>>",
    )
    keywords = _literal(sorted({k for r in signatures for k in (*r.keywords, r.also) if k}), "array<string>")
    names = _literal([r.name for r in signatures], "array<string>")
    raw = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    lower = raw.withColumn("lower", F.lower("text"))
    opened = F.lit(False)
    for word in gate:
        opened = opened | F.contains("lower", F.lit(word))
    canon = lower.select(
        "doc_id",
        F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n_words"),
        F.when(
            opened,
            F.concat(F.lit(" "), F.btrim(F.regexp_replace(ascii_lower(F.col("text")), GAP, " ")), F.lit(" ")),
        ).alias("canon"),
    )
    base = F.flatten(
        F.array(
            *[
                _labelled(
                    label,
                    F.when(
                        F.contains(F.col("canon"), F.lit(f" {phrase} ")), _spans(F.col("canon"), F.lit(phrase))
                    ).otherwise(F.array().cast(_SPAN)),
                )
                for label, _, phrase in BASE
            ]
        )
    )
    hits = F.filter(keywords, lambda k: F.contains(F.col("canon"), F.concat(F.lit(" "), k)))
    open_rules = F.transform(
        F.array(hits),
        lambda hit: F.filter(
            table,
            lambda r: F.arrays_overlap(r["keywords"], hit) & ((r["also"] == "") | F.array_contains(hit, r["also"])),
        ),
    )[0]
    found = F.flatten(
        F.transform(
            open_rules,
            lambda r: F.transform(
                _spans(F.col("canon"), r["pattern"]),
                lambda s: F.struct(
                    s["first"].alias("first"),
                    (-s["last"]).alias("back"),
                    r["priority"].alias("priority"),
                    r["rule"].alias("rule"),
                    r["label"].alias("label"),
                    r["score"].alias("score"),
                ),
            ),
        )
    )
    scanned = canon.select(
        "doc_id",
        "n_words",
        F.when(F.col("canon").isNotNull(), base).alias("base"),
        F.when(F.col("canon").isNotNull(), _kept(found)).alias("kept"),
    )
    return scanned.select(
        "doc_id",
        "n_words",
        F.coalesce("base", F.array().cast("array<struct<label:string,first:int,last:int>>")).alias("base"),
        F.coalesce(
            F.transform(
                "kept",
                lambda d: F.struct(
                    F.element_at(names, d["rule"] + 1).alias("rule"),
                    d["label"].alias("label"),
                    d["first"].alias("first"),
                    (-d["back"]).alias("last"),
                    d["priority"].alias("priority"),
                    d["score"].alias("score"),
                ),
            ),
            F.array().cast("array<struct<rule:string,label:string,first:int,last:int,priority:int,score:double>>"),
        ).alias("detections"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """The scan as plain columns; labels are distinct, sorted and comma-joined, score is the best rule's."""
    scan = scan_licenses(docs)
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    return scan.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").cast("long").alias("first_word"),
        F.array_max("base.first").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("detections.label"))), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max("detections.score"), F.lit(0.0)),
            F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)),
        ).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
