import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tableprofile.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [
    "", " ", "a", "it's they're  we'll\n\n\n x", "naïve 東京 🙂🙂 \t tab", "<|endoftext|>", "x" * 900, " " * 700 + "y",
    "word " * 300, "'re" * 200, "1234 " * 100 + "\n" * 90, "a'" * 301, "é" * 333 + " ’ " * 200, "end  ",
]


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}


@pytest.mark.parametrize("chunk,overlap", [(7, 5), (50, 20), (97, 33), (1 << 15, 1 << 9)])
def test_equals_tiktoken(spark, documents, ranks, chunk, overlap):
    own = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(TEXTS), (100, None), (7, TEXTS[7]), (None, TEXTS[8])]
    sent = bpe.load_ranks(spark, PATH)
    out = bpe.decode(bpe.encode(documents(rows), sent, PATTERN, chunk, overlap), sent, PATTERN).collect()
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in out), key=repr)
    want = sorted(((i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)
    assert got == want


def test_no_rows(spark, documents):
    assert bpe.round_trip_digest(documents([(1, "a")]).limit(0), PATH, PATTERN).collect() == []


def test_very_long_text(spark, documents, ranks, prose):
    text = "\n".join(prose(k, 400) for k in range(60)) + "z" * 70_000 + prose(1, 9000)
    own = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(documents([(1, text)]), bpe.load_ranks(spark, PATH), PATTERN).first()
    assert np.frombuffer(out["ids"], "<u4").tolist() == own.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 4000, "ab c" * 30 + "y" * 3000 + " tail of words" * 40, "=" * 1500 + "q" * 1500])
def test_a_run_over_many_chunks_is_cut_again_a_few_times_only(ranks, monkeypatch, text):
    """Chunks that agree nowhere are joined by doubling: the characters cut again are a few times the text's."""
    own = bpe.Codec(ranks, PATTERN)
    chunk, overlap = 50, 20
    chunks = []
    for start in range(0, max(1, len(text) - overlap), chunk):
        part = text[start : start + chunk + overlap]
        chars, counts, ids = bpe._ends(part, own)
        edge = (chars <= overlap) | (chars >= len(part) - overlap)
        chunks.append((start, part, chars[edge] + start, counts[edge], ids))
    cut = []
    again = bpe._ends
    monkeypatch.setattr(bpe, "_ends", lambda t, own: cut.append(len(t)) or again(t, own))
    want = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert np.frombuffer(bpe.stitch(chunks, own), "<u4").tolist() == want
    assert sum(cut) <= 4 * len(text) and len(cut) <= 24
