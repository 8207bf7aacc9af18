"""Turns of conversations in order, in blocks of bounded size, so that no task holds a whole one.

Rows are ordered by range over (conversation, turn, role, text): one conversation with a large share
of the rows is spread over many tasks. Each task cuts what it has of a conversation into blocks, and
what depends on the whole conversation is folded over one small summary per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns and characters of a block; a longer text is a block of its own.
TURNS, CHARS = 1024, 1 << 20
TURN = "struct<turn:long,role:string,text:string,again:boolean>"
BLOCK = f"conv string, conv_id long, part long, block long, head boolean, turns array<{TURN}>"
_TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("again", pa.bool_())]))
_BLOCK = pa.schema(
    [("conv", pa.string()), ("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("head", pa.bool_()), ("turns", _TURNS)]
)


def conversation_key(conv_id: Column) -> Column:
    """A text that is never null and differs for every id, and for no id."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def blocks(rows: DataFrame, turns: int = TURNS, chars: int = CHARS) -> DataFrame:
    """Blocks of consecutive turns, from ``conv``, ``conv_id``, ``turn``, ``role`` and ``text`` (the last two never null).

    Within a conversation blocks follow one another by ``part`` and ``block``. Turns are ordered by
    turn, nulls first, then role and text. ``again`` marks a turn equal to the one before it; equal
    turns are in one part. ``head`` marks blocks that are surely the first of their conversation: all
    first ones but one per task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done: list[dict] = []
        held: list[dict] = []
        key: str | None = None
        last: tuple = ()
        size = weight = block = seen = 0

        def close() -> None:
            done.append({"conv": key, "conv_id": conv_id, "part": part, "block": block, "head": block == 0 and seen > 1, "turns": held})

        for batch in batches:
            for row in batch.to_pylist():
                new, own = row["conv"] != key, len(row["text"])
                if held and (new or len(held) >= turns or size + own > chars):
                    close()
                    weight += size + 64 * len(held)
                    block, held, size = block + 1, [], 0
                if weight >= chars:
                    yield pa.RecordBatch.from_pylist(done, schema=_BLOCK)
                    done, weight = [], 0
                if new:
                    block, seen = 0, seen + 1
                key, conv_id = row["conv"], row["conv_id"]
                now = (key, row["turn"], row["role"], row["text"])
                held.append({"turn": row["turn"], "role": row["role"], "text": row["text"], "again": now == last})
                last, size = now, size + own
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_BLOCK)

    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    ranged = rows.select("conv", "conv_id", "turn", "role", "text").withColumn("begin", F.substring("text", 1, 32))
    # The bounds of the ranges hold the begin of a text only; the order within a range is by all of it.
    ranged = ranged.repartitionByRange(*order, "begin").drop("begin")
    return ranged.sortWithinPartitions(*order, "text").mapInArrow(cut, BLOCK)


def folded(
    rows: DataFrame, columns: list[str], fold: Callable[[Iterator[dict]], Iterator[dict]], schema: str, arrow: pa.Schema, per_batch: int = 256
) -> DataFrame:
    """Runs ``fold`` over the rows of every conversation in block order, read as a stream.

    ``fold`` gets the rows of one conversation as an iterator, one at a time, and gives rows back, so
    what a task holds does not grow with the conversation but with what ``fold`` remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
        out: list[dict] = []
        for _, own in groupby(stream, key=lambda r: r["conv"]):
            for row in fold(own):
                out.append(row)
                if len(out) >= per_batch:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            for _ in own:  # whatever the fold left unread
                pass
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select(*columns).repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(run, schema)
