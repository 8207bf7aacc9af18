"""Repair of the turn structure of conversations by Knuth's lightest derivation.

An item (i, q) says that the first i turns, as edited, lead to state q of the role pattern
``(s?(ua)+)?``. Keeping, re-roling or deleting turn i + 1, or inserting a turn, deduces a further
item at a weight (cost, audit): costs add, audits are strung together. These functions are superior
- no result is below its antecedent - and keep the order of two derivations of the same item, as of
equal cost neither audit can begin with the other. So items leave the agenda in order of weight, the
first derivation that leaves it for an item is its lightest, and the search ends with the goal items.

A conversation is derived in blocks of turns, each from every state it may be entered in. The blocks'
lightest derivations are strung together by a fold that remembers one derivation per state.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.llm import conversations
from tableprofile.llm.classes import with_first
from tableprofile.llm.scratch import written

#: Costs of the edits, and of a turn that stays truncated.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: Role whose turn a state awaits, and the state after it; states: begin, after system, user, assistant.
AWAITS = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
AFTER = {"u": 2, "a": 3}
ACCEPTED = (0, 3)
#: Blocks of few turns are alike; their derivations are remembered by each process.
SHORT, REMEMBERED = 24, 1 << 15

Weight = tuple[int, str]


def agenda(turns: str, begin: int, goals: frozenset[int]) -> dict[int, Weight]:
    """The lightest derivation of every goal state at the end of ``turns``, from state ``begin`` on.

    A turn is two letters: the initial of its role (``s``, ``u``, ``a`` or other) and its fault (``x``
    for one that must go, ``t`` for truncated, else a dot). States that cannot be reached have none.
    """
    end = len(turns) // 2
    final: dict[tuple[int, int], Weight] = {}
    found: dict[int, Weight] = {}
    items = [(0, "", 0, begin)]
    while items and len(found) < len(goals):
        cost, audit, i, q = heapq.heappop(items)
        if (i, q) in final:
            continue
        final[i, q] = (cost, audit)
        if i == end and q in goals:
            found[q] = (cost, audit)
        role = AWAITS[q]
        heapq.heappush(items, (cost + COST["I"], audit + "I", i, AFTER[role]))
        if i == end:
            continue
        heapq.heappush(items, (cost + COST["D"], audit + "D", i + 1, q))
        own, fault = turns[2 * i], turns[2 * i + 1]
        if fault != "x":
            cost += TRUNCATED if fault == "t" else 0
            if own == role:
                heapq.heappush(items, (cost + COST["K"], audit + "K", i + 1, AFTER[role]))
            else:
                heapq.heappush(items, (cost + COST["R"], audit + "R", i + 1, AFTER[role]))
                if own == "s" and q == 0:
                    heapq.heappush(items, (cost + COST["K"], audit + "K", i + 1, 1))
    return found


_remembered = lru_cache(REMEMBERED)(agenda)


def derive(turns: str, begin: int = 0, goals: tuple[int, ...] = (0, 1, 2, 3)) -> dict[int, Weight]:
    return (_remembered if len(turns) <= 2 * SHORT else agenda)(turns, begin, frozenset(goals))


def applied(turns: list[dict], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of the turns that an audit leaves, and of deleted ones with their own role."""
    left = iter(turns)
    for edit in audit:
        role = ROLES[AWAITS[state]]
        if edit == "I":
            state = AFTER[AWAITS[state]]
            yield edit, role, ""
            continue
        turn = next(left)
        if edit == "R":
            state = AFTER[AWAITS[state]]
            yield edit, role, turn["text"]
        elif edit == "K":
            state = 1 if turn["role"][:1] == "s" else AFTER[AWAITS[state]]
            yield edit, turn["role"], turn["text"]
        else:
            yield edit, turn["role"], turn["text"]


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` of conversations, damaged by a checksum of id and turn.

    Of twenty rows one is dropped, one loses its text, one its ``.!?``, one comes twice, and one gets
    the role of a user. A null counts as one space in the checksum, the role and the text.
    """
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _signatures(cut: DataFrame) -> DataFrame:
    """Per block its turns, roles' initials and faults, without the texts."""
    turn = F.col("own")
    slim = cut.select("conv", "part", "block", "head", F.posexplode("turns").alias("pos", "own")).select(
        "conv",
        "part",
        "block",
        "head",
        "pos",
        F.struct(turn["turn"].alias("turn")).alias("at"),
        turn["role"].alias("role"),
        F.sha2(turn["text"].cast("binary"), 256).alias("digest"),
        turn["again"].alias("again"),
        (~turn["text"].rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~turn["text"].rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    # A turn repeats an earlier one if its role and text have an earlier turn, or stand just before it.
    slim = with_first(slim, ["conv", "role", "digest"], "at")
    initial = F.substring("role", 1, 1)
    fault: Column = (
        F.when(F.col("blank"), "b").when(F.col("again") | (F.col("first") < F.col("at")), "d").when(F.col("truncated"), "t").otherwise(".")
    )
    own = F.struct("pos", F.col("at.turn").alias("turn"), F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault"))
    return slim.groupBy("conv", "part", "block", "head").agg(F.sort_array(F.collect_list(own)).alias("own"))


_SUMMARY = (
    "conv string, part long, block long, n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "low long, high long, distinct_turns long, first_turn long, last_turn long, edges array<struct<begin:int,end:int,cost:long,audit:string>>"
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: what the fold over a conversation needs."""
    edge = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds.get(k, edge)) for n, k in (x.strip().split(" ", 1) for x in _SUMMARY.split(", "))])
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            out = []
            for row in batch.slice(k, 64).to_pylist():
                own = row["own"]
                initials = "".join(t["initial"] for t in own)
                faults = "".join(t["fault"] for t in own)
                turns = "".join(i + ("x" if f in "bd" else f) for i, f in zip(initials, faults))
                known = [t["turn"] for t in own if t["turn"] is not None]
                edges = [
                    {"begin": p, "end": q, "cost": cost, "audit": audit}
                    for p in ((0,) if row["head"] else range(4))
                    for q, (cost, audit) in derive(turns, p).items()
                ]
                out.append(
                    {
                        **{c: row[c] for c in ("conv", "part", "block")},
                        "n": len(own),
                        **{name: faults.count(f) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))},
                        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                        "first_initial": initials[0],
                        "last_initial": initials[-1],
                        "low": min(known, default=None),
                        "high": max(known, default=None),
                        "distinct_turns": len(set(known)),
                        "first_turn": own[0]["turn"],
                        "last_turn": own[-1]["turn"],
                        "edges": edges,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PLAN = pa.schema(
    [
        ("conv", pa.string()),
        *[(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")],
        ("audit", pa.string()),
        ("path", pa.list_(pa.struct([("part", pa.int64()), ("block", pa.int64()), ("begin", pa.int32()), ("audit", pa.string())]))),
    ]
)
_PLAN_SQL = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "path array<struct<part:long,block:long,begin:int,audit:string>>"
)


def _strung(own: Iterator[dict]) -> Iterator[dict]:
    """Strings the blocks of a conversation together."""
    live: dict[int, Weight] = {0: (0, "")}
    back: list[tuple[int, int, dict[int, tuple[int, int]]]] = []
    total = dict.fromkeys(_COUNTS, 0)
    low = high = last_turn = last_initial = None
    different = 0
    for row in own:
        best: dict[int, tuple[Weight, int, int]] = {}
        for e in row["edges"]:
            if e["begin"] in live:
                cost, audit = live[e["begin"]]
                cost += e["cost"]
                if e["end"] not in best or cost <= best[e["end"]][0][0]:
                    way = ((cost, audit + e["audit"]), e["begin"], len(e["audit"]))
                    best[e["end"]] = min(best.get(e["end"], way), way)
        live = {q: w[0] for q, w in best.items()}
        back.append((row["part"], row["block"], {q: w[1:] for q, w in best.items()}))
        for c in _COUNTS:
            total[c] += row[c]
        if last_initial is not None:
            total["illegal"] += last_initial + row["first_initial"] not in ("su", "ua", "au")
        last_initial = row["last_initial"]
        if row["low"] is not None:
            low = row["low"] if low is None else low
            high = row["high"]
            different += row["distinct_turns"] - (last_turn is not None and last_turn == row["first_turn"])
        last_turn = row["last_turn"]
        conv = row["conv"]
    (cost, audit), state = min((live[q], q) for q in ACCEPTED if q in live)
    path, left = [], len(audit)
    for part, block, ways in reversed(back):
        state, edits = ways[state]
        path.append({"part": part, "block": block, "begin": state, "audit": audit[left - edits : left]})
        left -= edits
    gaps = 0 if low is None else high - low + 1 - different
    yield {"conv": conv, "gaps": gaps, **total, "cost": cost, "audit": audit, "path": path[::-1]}


def repair(rows: DataFrame, turns: int = conversations.TURNS) -> tuple[DataFrame, DataFrame]:
    """The plan of every conversation, and its blocks with their edits.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; a null role or text counts as one space,
    rows without an id are one conversation, other columns are ignored. Turns are taken by turn, nulls
    first, then by role and text. The plan has a row per conversation with ``conv``, ``gaps``,
    ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``; blocks have
    ``turns``, ``begin`` (the state they are entered in) and their part of the ``audit``. A text of any length
    is one turn; an empty table gives no rows.
    """
    space = F.lit(" ")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        conversations.conversation_key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    cut = written(conversations.blocks(rows, turns), "blocks")
    summaries = _signatures(cut).mapInArrow(_summaries, _SUMMARY)
    plan = written(conversations.folded(summaries, summaries.columns, _strung, _PLAN_SQL, _PLAN), "plan")
    steps = plan.select("conv", F.inline("path"))
    return plan.drop("path"), cut.join(steps, ["conv", "part", "block"])


def repaired_turns(edited: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``block``, ``pos``, ``edit``, ``role`` and ``text`` of every turn, from the blocks of ``repair``.

    Turns follow one another by ``part``, ``block`` and ``pos``. Deleted turns are there, with edit ``D``.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist(
                    [
                        {"conv_id": row["conv_id"], "part": row["part"], "block": row["block"], "pos": pos, "edit": e, "role": r, "text": t}
                        for pos, (e, r, t) in enumerate(applied(row["turns"], row["audit"], row["begin"]))
                    ],
                    schema=schema,
                )

    return edited.mapInArrow(run, "conv_id long, part long, block long, pos long, edit string, role string, text string")


def _digest(own: Iterator[dict]) -> Iterator[dict]:
    """The digest of a conversation's repaired turns, read as a stream."""
    sha, first = hashlib.sha256(), True
    for row in own:
        for edit, role, text in applied(row["turns"], row["audit"], row["begin"]):
            if edit != "D":
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
    yield {"conv": row["conv"], "repaired_sha256": sha.hexdigest()}


def repair_digest(rows: DataFrame, turns: int = conversations.TURNS) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation of ``rows`` after damage; see ``repair``."""
    plan, edited = repair(damaged(rows), turns)
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    digests = conversations.folded(
        edited, ["conv", "part", "block", "begin", "audit", "turns"], _digest, "conv string, repaired_sha256 string", schema
    )
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = ids.withColumn("conv", conversations.conversation_key(F.col("conv_id")))
    told = ids.join(plan, "conv", "left").join(digests, "conv", "left")
    return told.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
