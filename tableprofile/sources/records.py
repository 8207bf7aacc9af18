"""Records of CSV files whose quoted fields contain line breaks, read in splits.

Whether a split begins inside a quoted field depends on all text before it. Each split therefore tells in
a first scan how it would end from either state, which is one small row. Those rows, taken in order per
file, give every split its state, and a second scan puts lines together to records. What a split has of a
record that begins or ends in another one is put together afterwards: two pieces per split at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprofile.sources.scratch import written

_PIECE = "file long, start long, place long, begins boolean, ends boolean, first boolean, value string"
_PIECE_ARROW = pa.schema(
    [("file", pa.int64()), ("start", pa.int64()), ("place", pa.int64())]
    + [(c, pa.bool_()) for c in ("begins", "ends", "first")]
    + [("value", pa.string())]
)


def quoted_after(line: str, inside: bool) -> bool:
    """Whether the text after a line is inside a quoted field, given whether the line begins in one.

    A field is quoted if a quote is its first character; in it two quotes are one. Quotes elsewhere
    are text, and so is the rest of a field whose closing quote is not followed by a comma.
    """
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            close = line.find('"', at)
            if close < 0:
                return True
            if line.startswith('"', close + 1):
                at = close + 2
                continue
            inside, at = False, close + 1
        else:
            if at == n or line[at] != '"' or at and line[at - 1] != ",":
                comma = line.find(",", at)
                if comma < 0:
                    return False
                at = comma + 1
                if at == n:
                    return False
            if line[at] == '"':
                inside, at = True, at + 1


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    """The split and text of every line of a task, in order."""
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        for file, start, value in zip(files, starts, values):
            yield (file, start), value.removesuffix("\r")


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split ends if it begins outside, and inside, a quoted field."""
    ends: dict[tuple[int, int], tuple[bool, bool]] = {}
    for split, line in _rows(batches):
        out, in_ = ends.get(split, (False, True))
        ends[split] = quoted_after(line, out), quoted_after(line, in_)
    if ends:
        rows = [(*s, *e) for s, e in ends.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "start", "from_outside", "from_inside"])


def _states(table: pa.Table) -> pa.Table:
    """The splits of a file that begin inside a quoted field."""
    inside, found = False, []
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "from_outside", "from_inside"))))
    for start, from_outside, from_inside in rows:
        if inside:
            found.append(start)
        inside = from_inside if inside else from_outside
    return pa.table({"file": pa.array([table["file"][0].as_py()] * len(found), pa.int64()), "start": pa.array(found, pa.int64())})


def _pieces(begin_inside):
    """For a task: its records, and what it has of records that other splits share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = begin_inside.value
        out: list[dict] = []
        split, held, inside, begins, place = None, [], False, True, 0

        def close(ends: bool) -> None:
            first = begins and split[1] == 0 and place == 0
            out.append(
                {"file": split[0], "start": split[1], "place": place, "begins": begins, "ends": ends, "first": first, "value": "\n".join(held)}
            )

        for own, line in _rows(batches):
            if own != split:
                if held:
                    close(not inside)
                split, held, place = own, [], 0
                inside = own in known
                begins = not inside
            held.append(line)
            inside = quoted_after(line, inside)
            if not inside:
                close(True)
                held, begins, place = [], True, place + 1
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)
                    out = []
        if held:
            close(not inside)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)

    return run


class _Known:
    """The splits that begin inside a quoted field, 16 bytes each."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def __contains__(self, split: tuple[int, int]) -> bool:
        lo = np.searchsorted(self.rows["file"], split[0], "left")
        hi = np.searchsorted(self.rows["file"], split[0], "right")
        at = lo + np.searchsorted(self.rows["start"][lo:hi], split[1])
        return bool(at < hi and self.rows["start"][at] == split[1])


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``first`` (whether it is the header of its file) and ``value``, the text of every record but empty lines.

    Line breaks in quoted fields become line feeds. The records are written once to the scratch folder.
    """
    ends = _lines(spark, path).mapInArrow(_endings, "file long, start long, from_outside boolean, from_inside boolean")
    found = ends.groupBy("file").applyInArrow(_states, "file long, start long").collect()  # two numbers per split
    table = np.array(sorted((r["file"], r["start"]) for r in found), dtype=[("file", np.int64), ("start", np.int64)])
    known = spark.sparkContext.broadcast(_Known(table))
    pieces = written(_lines(spark, path).mapInArrow(_pieces(known), _PIECE), "records")
    whole = pieces.where("begins AND ends").select("first", "value")
    order = Window.partitionBy("file").orderBy("start", "place")
    parts = pieces.where("NOT (begins AND ends)").withColumn("record", F.sum(F.col("begins").cast("int")).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("start", "place", "value")))
    joined = parts.groupBy("file", "record").agg(
        F.max("first").alias("first"), F.concat_ws("\n", F.transform(ordered, lambda p: p["value"])).alias("value")
    )
    return whole.unionByName(joined.select("first", "value")).where("value <> ''")
