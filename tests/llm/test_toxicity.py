import itertools
import time

import pytest

from tableprofile.llm import toxicity as tox

BAD = ["idiot", "moron", "scumbag"]


@pytest.fixture(scope="module")
def model(spark, documents, prose):
    clean = " the quick brown story of rain and wind over the long green hill "
    rows = [(k, f"{clean}{prose(k, 5)} {BAD[k % 3] if k % 2 else ''}{clean}") for k in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    return tox.train(documents(rows), labels)


@pytest.mark.parametrize("text", ["1d10t", "id!ot", "i d i o t", "m0r0n", "m.o.r.o.n", "scumb@g", "5cumbag", "idiooooot", "m*ron", "MORON!!!", "$cumbag"])
def test_obfuscated_words_are_found(documents, model, text):
    out = tox.score(documents([(1, f"over the hill {text} and wind"), (2, "over the hill and wind")]), model).collect()
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[1] >= 0.5 > scores[2]


def test_plain_tokens_are_not_decoded():
    assert [tox._suspect(t) for t in ("hill", "er***", "end.", "3.14", "---", "it's"[:2])] == [None] * 6
    assert tox._suspect("$tupid!") == "$tupid" and tox._suspect("st*pid,") == "st*pid"


def test_odd_rows(documents, odd_rows, model):
    rows = [*odd_rows, (60, "hill " * 50_000 + "idi0t"), (61, "€" * 3000 + "a1" * 2000)]
    out = tox.score(documents(rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] >= 0.5 for r in out if r["doc_id"] == 60} == {True}
    assert tox.score(documents(rows).limit(0), model).collect() == []


def test_without_labels(spark, documents):
    docs = documents([(1, "idiot"), (2, None)])
    digest = tox.toxicity_digest(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r["predicted"] for r in digest] == [0, 0]


def test_trigrams_are_counted_over_all_texts(documents):
    counts = tox.count_trigrams(documents([(1, "ab"), (2, "AB ab"), (3, None)]))
    assert counts[(0 * 28 + 1) * 28 + 2] == 3 and counts[(1 * 28 + 2) * 28] == 3 and counts[(2 * 28) * 28 + 1] == 1


@pytest.mark.parametrize("text", ["iidiot", "iddiot", "mooron", "mmoron", "sscumbag", "idio+", "moro*", "idio+!", "(moro#),"])
def test_doubled_letters_and_trailing_signs_are_decoded(documents, model, text):
    out = tox.score(documents([(1, f"over the hill {text} and wind"), (2, "over the hill! and** wind$ all+")]), model).collect()
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[1] >= 0.5 > scores[2]


def test_signs_at_the_end_reach_the_decoder():
    assert [tox._signed(t) for t in ("a$$", "dumba$$", "worthles$.", "idio+", "scu*)")] == ["a$$", "dumba$$", "worthles$", "idio+", "scu*"]
    assert [tox._signed(t) for t in ("hill", "end.", "$$$", "!?", "1+")] == [None] * 5


def best_readings(decoder, token):
    """All likeliest readings of a short token, by trying every one."""
    log, found = decoder._log, {}
    for choice in itertools.product(*decoder._steps(token)):
        x, y, z, total, text = 0, 0, 0, 0.0, ""
        for symbols, p in choice:
            total += p
            for s in symbols:
                if s or z:
                    total += float(log[x, y, z, s])
                    text += tox._LETTERS[s]
                    x, y, z = y, z, s
        found[text] = max(found.get(text, -1e9), total + float(log[x, y, z, 0]))
    top = max(found.values())
    return {t for t, v in found.items() if v > top - 1e-4}


@pytest.mark.parametrize("token", ["id1ot", "5tup1d", "a$$", "f*o#x", "w.o.r.d", "!!x1", "b00*k%", "sss", "t*e%", "*#%", "a1*", "h*#%t", "%%a**"])
def test_decoding_equals_all_readings(model, token):
    """Both ways of decoding find a likeliest reading of the lattice."""
    decoder = tox.Decoder(model)
    want, steps = best_readings(decoder, token), decoder._steps(token)
    for read in (decoder._by_states, decoder._by_arrays):
        assert "".join(tox._LETTERS[s] for s in read(steps)) in want
    assert decoder.read(token) in want


@pytest.mark.parametrize("token", ["a*#%*#%" * 1500, "a*b#c%" * 1700, "1!0|5$" * 1700])
def test_long_tokens_of_signs_end(model, token):
    began = time.time()
    tox.Decoder(model).read(token)
    assert time.time() - began < 20


def test_equal_texts_with_two_labels_count_as_toxic(spark, documents):
    """The label of copies does not depend on which of them is met first."""
    rows = [(i, "you are a zorkal fool") for i in range(1, 30)] + [(i, f"good words {i}") for i in range(30, 90)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0 and i < 30)) for i in range(1, 90)], "doc_id long, toxic int")
    models = [tox.train(documents(r), labels) for r in (rows, rows[::-1])]
    assert models[0].weights == models[1].weights and models[0].offset == models[1].offset
