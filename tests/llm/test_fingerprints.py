import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tableprofile.llm import fingerprints as fp


def sketch(text, scale=fp.SCALE):
    words = (text or "").encode().split()
    hashes = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w, seed=h)
        hashes.add(h)
    low = sorted(h for h in hashes if h < 2**64 // scale)
    return low or sorted(hashes)[:1]


def near(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_against_plain_python(documents, prose):
    texts = {k: prose(k % 7, 10 + 13 * k) for k in range(40)} | {50: "é" * 9, 51: "", 53: "a b", -2: None}
    got = by_id(fp.edited_fingerprints(documents(texts.items())))
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h:016x}" for h in a)
        assert r["edited_fingerprint"] == "".join(f"{h:016x}" for h in b)
        assert (r["near_edited"], r["near_next"]) == (near(a, b), near(a, c))


@pytest.mark.parametrize("blocks", [1, 2, 7, 50])
def test_next_across_blocks(documents, blocks):
    ids = [3, 8, 9, 14, 100, 101, 5000, -7]
    rows = documents([(i, f"t{i}") for i in ids]).select("doc_id", "text")
    got = {r["doc_id"]: r["next_text"] for r in fp.with_next(rows, lambda d: d, ["text"], blocks).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_odd_rows(documents, odd_rows):
    out = fp.edited_fingerprints(documents(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in out)
    assert fp.edited_fingerprints(documents(odd_rows).limit(0)).collect() == []
    alone = fp.edited_fingerprints(documents([(7, "a b c d e f")])).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 11


def test_merge_and_containment(spark, prose):
    a, b = prose(1, 3000, 5000), prose(2, 300, 5000)
    rows = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    s = {c: fp.scaled_sketch(fp.shingle_hashes(F.col(c))) for c in ("a", "b", "ab")}
    r = rows.select(
        fp.merge(s["a"], s["b"]).alias("m"), s["ab"].alias("ab"), fp.containment(s["b"], s["ab"]).alias("c")
    ).first()
    assert set(r["m"]) <= set(r["ab"]) and len(r["ab"]) - len(r["m"]) <= 4 and r["c"] == 1.0
    with pytest.raises(ValueError):
        fp.scaled_sketch(F.array(), 3)
