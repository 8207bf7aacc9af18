import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tableprofile.llm import arrays, jaccard
from tableprofile.llm.components import connected_components


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in jaccard.jaccard_components(df, **options).collect()), key=repr)


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p] = "edit"
    return " ".join(words)


def test_against_brute_force(documents, prose):
    rows = [(k, prose(k, 40 + k)) for k in range(25)]
    rows += [(100 + k, edited(prose(k, 80), k % 80)) for k in range(10) for _ in range(1)]
    rows += [(200 + k, edited(prose(3, 80), (7 * k) % 80)) for k in range(12)]
    rows += [(300, prose(3, 80).upper()), (301, "a b"), (302, "A  b"), (303, "a b c"), (304, "b a")]
    assert found(documents(rows)) == brute(rows)


def test_chain_and_copies(documents, prose):
    """Neighbours of a chain are alike, its ends are not; copies are one class."""
    base = prose(1, 120, 5000)
    rows = [(k, edited(base, *range(10, 10 + 4 * k))) for k in range(15)]
    rows += [(50 + k, rows[4][1]) for k in range(20)]
    assert found(documents(rows)) == brute(rows)


def test_many_near_copies(documents, prose):
    base = prose(1, 100, 5000)
    rows = [(k, edited(base, (13 * k) % 100, (29 * k) % 100)) for k in range(150)]
    assert found(documents(rows)) == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_threshold_is_exact(documents, percent):
    words = [f"t{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 3 : k * 3 + 54])) for k in range(20)]
    assert found(documents(rows), percent=percent) == brute(rows, percent)


def test_odd_rows(documents, odd_rows):
    assert found(documents(odd_rows)) == brute(odd_rows)
    assert found(documents(odd_rows).limit(0)) == []


def test_keep_one_each(documents, prose):
    docs = documents([(5, prose(1)), (3, prose(1)), (4, prose(2)), (None, prose(1))])
    out = jaccard.keep_one_each(docs)
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "4", "None"]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(10, 60)] + [(1, 5), (5, 9), (9, 1), (7, 7), (200, 199)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {k: 10 for k in range(10, 61)} | {1: 1, 5: 1, 9: 1, 7: 7, 199: 199, 200: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def thue_morse(n):
    """A text and its complement: a polynomial hash modulo a power of two cannot tell them apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_built_to_collide(documents):
    x, y = thue_morse(2048)
    rows = [(1, " ".join([x] * 6)), (2, " ".join([y] * 6)), (3, f"{x} one two three four five"), (4, f"{y} one two three four five")]
    assert found(documents(rows)) == brute(rows)


@pytest.mark.parametrize("block", [2048, 5])
def test_crowds_near_the_threshold(documents, prose, monkeypatch, block):
    """Members of large buckets that are alike, nearly alike, or share a passage only; blocks of few members."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    base, passage = prose(1, 90, 5000), prose(2, 30, 5000)
    rows = [(k, edited(base, *[(17 * k + 11 * e * (k % 5 + 1)) % 90 for e in range(1 + k % 4)])) for k in range(60)]
    rows += [(200 + k, passage + " " + prose(300 + k, 5 + k % 30, 5000)) for k in range(60)]
    assert found(documents(rows)) == brute(rows)


@pytest.mark.parametrize("together", [0, 16])
def test_open_pairs_of_cut_batches(monkeypatch, together):
    """Buckets are whole, however batches are cut, and every unconnected pair that may be alike comes out."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rng = random.Random(8)
    sets = [np.unique(np.array([rng.randrange(1 << 62) if rng.random() < 0.1 else 1000 + k for k in range(60)], np.uint64)) for _ in range(40)]
    rows, want = [], set()
    for token in range(12):
        members = sorted(rng.sample(range(40), rng.choice([2, 3, 9, 25])))
        for d in members:
            rows.append((token, 0, 0, 0, d, (len(sets[d]) << 32) | 0, d % 7, jaccard._bitmap(sets[d])))
        for k, x in enumerate(members):
            for y in members[:k]:
                a, b = sets[x], sets[y]
                if x % 7 != y % 7 and 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b)):
                    want.add((y, x))
    names = ["token", "i", "j", "own", "doc", "place", "component", "bits"]
    table = pa.table({n: pa.array(c, pa.binary() if n == "bits" else pa.int64()) for n, c in zip(names, zip(*rows))})
    for size in (1, 4, 1000):
        got, some = (
            {
                (a, b)
                for batch in jaccard._open_pairs(80, sparse)(iter(table.to_batches(max_chunksize=size)))
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            }
            for sparse in (False, True)
        )
        assert want <= got and len(got) < 1.2 * len(want) + 10
        assert some <= got and (len(some) < len(got) or together)


def test_one_row_of_repeated_ones_stays(documents, prose):
    rows = [(1, prose(1)), (1, prose(1)), (2, prose(2)), (None, prose(3)), (None, prose(3)), (None, None), (None, None)]
    kept = jaccard.keep_one_each(documents(rows))
    assert kept.columns == documents(rows).columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == 4 and set(got) == {(1, prose(1)), (2, prose(2)), (None, prose(3)), (None, None)}


def test_prefixes_in_company(prose):
    """Packed prefixes hold the first shingles in the global order, and parts keep the tokens that others have, too."""
    sets_of = [prose(k // 2, 5 + 7 * k % 120) + " end" * (k % 4) for k in range(60)] + [None, "", "a b", "A b", "a b c d e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets_of)), pa.int64()), pa.array(sets_of)], ["doc_id", "text"])
    sets = list(jaccard._shingle_sets(*arrays.texts(batch.column("text")), 5))
    counts = Counter(x for s in sets for x in s.tolist())
    frequent = np.array(sorted(x for x, n in counts.items() if n > 1), np.uint64)
    rank = np.random.default_rng(1).permutation(len(frequent)).astype(np.uint64) + np.uint64(1)
    place = dict(zip(frequent.tolist(), ((1 << 63) | rank.astype(object)).tolist()))
    expected, seen = [], set()
    for k, s in enumerate(sets):
        if len(s) and tuple(s.tolist()) not in seen:
            seen.add(tuple(s.tolist()))
            order = sorted(place.get(x, x) for x in s.tolist())[: int(jaccard.prefix_length(np.array(len(s))))]
            expected += [(x, k, (len(s) << 32) | p) for p, x in enumerate(order)]
    for n_parts in (1, 5, 70_000):
        out = pa.Table.from_batches(jaccard._prefixes(5, 80, SimpleNamespace(value=(frequent, rank)), n_parts)(iter([batch])))
        rows = [tuple(r) for b in out.column("body").to_pylist() for r in np.frombuffer(b, np.uint64).reshape(-1, 3).tolist()]
        assert sorted(rows) == sorted(expected) and len(set(out.column("part").to_pylist())) == out.num_rows
        kept = [jaccard._in_company(out.slice(k, 1)) for k in range(out.num_rows)]
        met = Counter(x for x, _, _ in expected)
        wanted = sorted((x, d, p) for x, d, p in expected if met[x] > 1 or x >= 1 << 63)
        assert sorted((t % (1 << 64), d, p) for part in kept for t, d, p in zip(*part.to_pydict().values())) == wanted
