import random
from collections import Counter
from itertools import product

import numpy as np

from tableprofile.llm import quality


def base(text):
    text = text or ""
    words = text.encode().split()
    counts = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + d for k in range(len(words) - 7) if counts[tuple(words[k : k + 8])] > 1 for d in range(8)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts(documents, prose, odd_rows):
    texts = [prose(k, 25 + k) for k in range(10)] + ["a b c d e f g h " * 5, prose(1, 100) + " " + prose(1, 12)]
    texts += ["é ü|#\n" * 12, "x\nx\n\n x\nx", prose(3, 30_000, 9)]
    rows = [(100 + k, t) for k, t in enumerate(texts)] + odd_rows
    out = quality.judge(documents(rows), None).collect()
    expected = sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], *[r[n] for n in NAMES]) for r in out), key=repr) == expected
    assert all(r["kept"] == (not r["base_failed"]) for r in out)
    assert quality.judge(documents(rows).limit(0), None).collect() == []


def test_viterbi_is_the_best_sequence():
    rng = random.Random(1)
    for _ in range(100):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randrange(1, 7))]
        moves = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]

        def value(labels):
            return sum(s for s, y in zip(scores, labels) if y) + sum(moves[a][b] for a, b in zip(labels, labels[1:]))

        best = max(product((0, 1), repeat=len(scores)), key=value)
        assert abs(value(quality.viterbi(scores, moves)) - value(best)) < 1e-9
    assert quality.viterbi([], [[0, 0], [0, 0]]) == []


def test_field_tells_lines_apart():
    rng = np.random.default_rng(1)
    texts = [rng.normal(2.0 * (k % 2), 1, (1 + k % 5, 3)) for k in range(60)]
    field = quality.fit_field(texts, [k % 2 for k in range(60)])
    right = sum((field.scores(x).sum() > 0) == bool(k % 2) for k, x in enumerate(texts))
    assert right >= 54 and field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0]


def test_learns_from_labels(spark, documents, prose):
    rows = [(k, "\n".join(prose(k * 9 + j, 15) + "." for j in range(4))) for k in range(40)]
    rows += [(100 + k, "\n".join(" ".join(f"{w}$$$ |" for w in prose(k, 15).split()) for j in range(4))) for k in range(40)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows[::2]], "doc_id long, quality int")
    out = quality.judge(docs, quality.train(docs, labels)).collect()
    assert all(r["kept"] == (r["doc_id"] < 100) for r in out if not r["base_failed"])
    assert quality.train(docs, labels.limit(0)) is None


def test_stretches_spread_over_the_text():
    lines = np.arange(1000)[:, None]
    assert [x.tolist() for x in quality.stretches(lines[:130], 64, 16)] == [lines[:64].tolist(), lines[64:128].tolist(), lines[128:130].tolist()]
    found = quality.stretches(lines, 10, 5)
    assert [int(x[0, 0]) for x in found] == [0, 250, 500, 740, 990] and all(len(x) == 10 for x in found)
    assert quality.stretches(lines[:0]) == []


def test_learns_from_texts_of_very_many_lines(spark, documents, prose):
    """Fitting has a bound on its lines; counts and decoding have none."""
    clean = "\n".join(prose(j, 8) + "." for j in range(40)) + "\n"
    junk = "\n".join(f"$$$ | {prose(j, 3)} |||" for j in range(40)) + "\n"
    rows = [(1, clean * 2500), (2, junk * 2500), (3, clean), (4, junk)]
    docs = documents(rows)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    out = {r["doc_id"]: r for r in quality.judge(docs, field).collect()}
    assert out[1]["n_dup_lines"] == 99_960 and out[2]["n_boilerplate"] == 100_000 and out[1]["n_boilerplate"] == 0
    assert out[3]["content_share"] == 1 and out[4]["content_share"] == 0
