import math
import zlib

import numpy as np

from tableprofile.llm import language
from tableprofile.llm.queries import documents as table
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    docs = table(spark, DATA.replace("0.001", "0.01"))
    out = language.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents([(k, "der und die das nicht" if k % 2 else "the and of that", "de" if k % 2 else "en", "s") for k in range(30)])
    model = language.train(docs)
    assert model.families == {"germanic": ["de", "en"]}
    rows = documents([*odd_rows, (50, "123 !?"), (51, "und nicht die " * 20_000), (52, "the")])
    out = {(r["doc_id"], r["text"] and r["text"][:9]): (r["__lang"], r["__score"]) for r in language.identify(rows, model).collect()}
    assert out[1, None] == out[2, ""] == out[50, "123 !?"] == ("und", 0.0)
    assert out[51, "und nicht"][0] == "de" and out[52, "the"][0] == "en"
    assert language.identify(rows, model).columns == [*rows.columns, "__lang", "__score"]
    assert language.identify(rows.limit(0), model).collect() == []
    none = language.train(docs.limit(0))
    assert {r["__lang"] for r in language.identify(rows, none).collect()} == {"und"}


def test_unknown_codes_are_families_and_labels_do_not_matter(documents):
    texts = {"qq": "zyx wvu tsr", "en": "the and of that", "de": "der und die das"}
    docs = documents([(k, texts[lang], lang, "s") for k, lang in enumerate(list(texts) * 15)])
    model = language.train(docs)
    assert model.families == {"germanic": ["de", "en"], "qq": ["qq"]}
    blind = documents([(k, texts["qq"], None, None) for k in range(3)])
    assert {r["__lang"] for r in language.identify(blind, model).collect()} == {"qq"}


def test_prediction_is_the_vote_of_all_machines(documents, prose):
    """Every text's language and score, from the machines by hand, one text and machine at a time."""
    words = {"en": "the and of that with", "de": "der und die das nicht", "nl": "het een van niet voor", "fr": "le et les des une", "it": "il e che non per"}
    docs = documents([(k, " ".join(np.random.default_rng(k).permutation(words[lang].split() * 3)), lang, "s") for k, lang in enumerate(list(words) * 12)])
    model = language.train(docs)
    assert sorted(model.families) == ["germanic", "romance"] and len(model.sides) == 5
    rows = documents([(k, f"{words[a].split()[k % 5]} {words[b]} {k}") for k in range(20) for a in words for b in words])

    def votes(margins, names, prefix):
        """The name with most duels won, the closest vote of which says how sure it is."""
        won, sure = {n: 0.0 for n in names}, {n: 1.0 for n in names}
        for (a, b), z in zip(model.sides, margins):
            if a in [prefix + n for n in names] and b in [prefix + n for n in names]:
                p = 1 / (1 + math.exp(-2 * max(-20, min(20, z))))
                for side, q in ((a, p), (b, 1 - p)):
                    name = side.removeprefix(prefix)
                    won[name] += (q > 0.5 or (q == 0.5 and side == a)) + q * 1e-3
                    sure[name] = min(sure[name], q)
        best = max(names, key=lambda n: won[n])
        return best, sure[best]

    for r in language.identify(rows, model).collect():
        x = language._features(r["text"])
        margins = (x / x.sum()) @ model.weights + model.offsets
        family, sure = votes(margins, sorted(model.families), "")
        lang, inner = votes(margins, model.families[family], "/")
        assert r["__lang"] == lang and math.isclose(r["__score"], sure * inner, rel_tol=1e-4, abs_tol=1e-6)


def test_a_repeated_id_does_not_crowd_out_languages(documents):
    rows = [(1, f"the and of that {k % 3}", "en", "s") for k in range(300)]
    rows += [(2 + k, t, lang, "s") for k, (lang, t) in enumerate([("de", "der und die das"), ("fr", "le et les des")] * 20)]
    model = language.train(documents(rows), sample=5, sample_all=12)
    assert sorted(x for members in model.families.values() for x in members) == ["de", "en", "fr"]
