import hashlib
import itertools
import random
import re
import zlib

import pytest

from tableprofile.llm import repair

ROLES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def every_repair(rows, kinds, inserts):
    """All (cost, audit, repaired) of at most ``inserts`` insertions, by trying every edit."""
    def go(i, used):
        if used < inserts:
            for c, a, rest in go(i, used + 1):
                for role in ("user", "assistant"):
                    yield c + 3, "I" + a, [(role, ""), *rest]
        if i == len(rows):
            yield 0, "", []
            return
        _, role, text = rows[i]
        for c, a, rest in go(i + 1, used):
            yield c + 4, "D" + a, rest
            if kinds[i] not in "bd":
                more = 3 * (kinds[i] == "t")
                yield c + more, "K" + a, [(role, text), *rest]
                for to in ("user", "assistant"):
                    yield c + 3 + more, "R" + a, [(to, text), *rest]

    for c, a, rest in go(0, 0):
        if re.fullmatch("(s?(ua)+)?", "".join((r[:1] or "-") if (r[:1] or "-") in "sua" else "-" for r, _ in rest)):
            yield c, a, rest


def simple(rows, kinds):
    """The cheapest repair by a plain table over turns and states."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", ())}

    def insert(best):
        for _ in range(4):
            for q, (c, a, t) in list(best.items()):
                for r in "ua":
                    if r in after[q]:
                        w = (c + 3, a + "I", (*t, (ROLES[r], "")))
                        best[after[q][r]] = min(best.get(after[q][r], w), w)
        return best

    best = insert(best)
    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for q, (c, a, t) in best.items():
            ways = [(q, (c + 4, a + "D", t))]
            if kind not in "bd":
                more = 3 * (kind == "t")
                if role[:1] in after[q]:
                    ways.append((after[q][role[:1]], (c + more, a + "K", (*t, (role, text)))))
                ways += [(after[q][r], (c + 3 + more, a + "R", (*t, (ROLES[r], text)))) for r in "ua" if r in after[q]]
            for p, w in ways:
                new[p] = min(new.get(p, w), w)
        best = insert(new)
    return min(best[q] for q in (0, 3) if q in best)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds = faults(mine)
        cost, audit, kept = simple(mine, kinds)
        turns = {t for t, _, _ in mine if t is not None}
        first = [r[:1] for _, r, _ in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[kinds.count(k) for k in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string, part string, block string, turns string, audit string"


def got(spark, rows, turns=1024):
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    out = [tuple(r) for r in repair.repair_digest(df, turns).collect()]
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: r[1:] for r in out}


def made(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unit"])
            text = rng.choice(["Well.", "Yes!  \n", "no end", " ", "", None, "Really?", "a" * 40 + rng.choice("xyz") + "."])
            rows += [(conv, rng.choice([turn, turn, 2 * turn, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("turns", [1024, 3, 1])
def test_equals_brute_force(spark, turns):
    rows = [*made(turns, 60, 9), (None, 1, "user", "Hm."), (None, None, "assistant", None), (None, 1, "user", "Hm.")]
    assert got(spark, rows, turns) == brute(rows)


def test_one_long_conversation(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "two", f"Text {t}."])) for t in range(3000)] + made(5, 30, 4)
    assert got(spark, rows, 50)[7] == brute(rows)[7]
    assert got(spark, rows)[7] == brute(rows)[7]


def test_agenda_equals_all_repairs():
    for n in range(4):
        for turns in itertools.product(["user", "assistant", "system", "tool"], repeat=n):
            for kinds in itertools.product(".td", repeat=n):
                if n == 3 and zlib.crc32(repr((turns, kinds)).encode()) % 4:
                    continue
                rows = [(i, r, f"{i}.") for i, r in enumerate(turns)]
                want = min(every_repair(rows, kinds, 2 if n < 3 else 1))[:2]
                code = "".join((r[0] if r[0] in "sua" else "-") + ("x" if k == "d" else k) for r, k in zip(turns, kinds))
                goals = repair.agenda(code, 0, frozenset({0, 3}))
                assert min(goals.values()) <= want and (n == 3 or min(goals.values()) == want)


def test_all_dropped_and_no_rows(spark):
    gone = next((c, t) for c in range(9) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert got(spark, [(*gone, "user", "Hi.")]) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (2, 0, "assistant", "Hm.")]
    _, edited = repair.repair(spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA))
    out = sorted((r["conv_id"], r["pos"], r["edit"], r["role"], r["text"]) for r in repair.repaired_turns(edited).collect())
    assert out == [(1, 0, "K", "user", "Hello."), (1, 1, "R", "assistant", "Again."), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Hm.")]


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a b " * 600_000 + "."), (1, 1, "assistant", "x" * 3_000_000), (1, 2, "assistant", "Yes.")]
    assert got(spark, rows) == brute(rows)
