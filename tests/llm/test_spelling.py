import random
import re
import zlib
from collections import Counter

import pytest

from tableprofile.llm import spelling


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    vocab = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in vocab.items():
        others = [v for v in vocab if v != w and near(w, v)]
        best = min(others, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * n else None
        out[w] = [n, len(others)]
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, out[w][0], out[w][1], vocab.get(form[w]))
    return sorted(out.values())


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    """Words of two lengths and more, their misspellings, and ties."""
    rng = random.Random(4)
    letters = "abcdeéÿ÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(30)]
    bag = []
    for w in words:
        bag += [w] * rng.choice([2, 20, 40, 400])
        for _ in range(12):
            i = rng.randrange(len(w))
            bag += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])] * rng.choice([1, 2, 2, 30])
    # A chain of three forms, doubled letters, signs next to letters.
    bag += ["colour" + c * k + "s" for c, k in (("x", 2), ("x", 3))] * 2 + ["Abcdefg"] * 600 + ["abcdefgh"] * 50 + ["abcdefghi"] * 4
    rng.shuffle(bag)
    return [(i, " ".join(bag[k : k + 40]) + rng.choice(["", "!", "×9"])) for i, k in enumerate(range(0, len(bag), 40))]


@pytest.mark.parametrize("limit", [spelling.BROADCAST, 640, 64])
def test_equals_brute_force(documents, texts, limit):
    rows = [*texts, *texts[:3], (None, texts[4][1]), (None, None), (77, ""), (78, "  ")]
    assert got(spelling.variants(documents(rows), limit=limit)) == brute(rows)


def test_chain_and_ties(documents):
    rows = [(1, " ".join(["abcdefg"] * 900 + ["abcdefgh"] * 60 + ["abcdefghi"] * 4 + ["zzzzzzzz"] * 40 + ["zzzzzzza"] * 40 + ["zzzzzzzb"] * 3))]
    out = {r[0]: r for r in got(spelling.variants(documents(rows)))}
    assert out["abcdefghi"][1:3] == ("abcdefgh", "abcdefg")
    assert out["zzzzzzzb"][1] == "zzzzzzza"
    assert out["zzzzzzzz"][1:3] == (None, "zzzzzzzz")


def test_no_rows_and_no_words(documents, odd_rows):
    assert got(spelling.variants(documents([(1, "a")]).limit(0))) == []
    assert got(spelling.variants(documents(odd_rows))) == []


def test_very_long_words(documents):
    long = "ab" * 2_000
    rows = [(i, f"{long} {long}a {long[:1000]}c{long[1001:]}") for i in range(4)]
    assert got(spelling.variants(documents(rows))) == brute(rows)


def test_edits_of_a_filter_are_never_missed():
    import numpy as np

    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(8)) for _ in range(300)]
    x = spelling.hashes(spelling.codes(words))
    assert len(set(x.tolist())) == len(set(words))
    bits = np.zeros(8 * 4, np.uint64)
    block = spelling._place(x, 4) * np.uint64(8)
    for lane, mask in spelling._lanes(x):
        np.bitwise_or.at(bits, block + lane, mask)
    assert len(spelling.known(bits, [(0, 1, 0, 4)], x)) == len(words)
