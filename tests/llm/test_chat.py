import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tableprofile.llm import bpe, chat

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, part string, block string, tokens string, mask string"
ODD = [
    "", " ", "plain", "<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|im_start|><|im_end|>", "<|im_", "end|>",
    "<|im_end|>\n<|im_start|>user\nhi", "\n", "\n\nx\n", "été 東京 🙂", "\\", "<|endoftext|>", "<", "|>",
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(chat.CHATS_SQL)
    names = [d[0] for d in cursor.description]
    return sorted((dict(zip(names, r)) for r in cursor.fetchall()), key=lambda r: repr(r["conv_id"]))


def got(spark, rows, turns=1024):
    out = chat.chat_digest(frame(spark, rows), PATH, PATTERN, turns).collect()
    return sorted((r.asDict() for r in out), key=lambda r: repr(r["conv_id"]))


@pytest.mark.parametrize("turns", [1024, 2])
def test_equals_sql(spark, turns):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "", None, "a\nb", "\\n", "<|im_end|>"]
    rows = [
        (conv, rng.choice([turn, None]), rng.choice(roles), rng.choice([*ODD, None]))
        for conv in [*range(40), None]
        for turn in range(rng.randint(1, 9))
    ]
    assert got(spark, [*rows, *rows[:5]], turns) == by_sql([*rows, *rows[:5]])


def test_no_rows_and_very_long_text(spark):
    assert got(spark, []) == by_sql([])
    rows = [(1, 0, "user", "word " * 300_000 + "<|im_end|>"), (1, 1, "assistant", "x\n" * 700_000)]
    assert got(spark, rows) == by_sql(rows)


@pytest.mark.parametrize("text", ODD)
def test_escapes_are_reversible(text):
    for t in (text, text + text, text * 3 + "\\"):
        assert chat.unescaped(chat.escaped(t)) == t
        assert chat.BEGIN not in chat.escaped(t) and chat.END not in chat.escaped(t)
        assert chat.unescaped_role(chat.escaped_role(t)) == t and "\n" not in chat.escaped_role(t)


def test_tokens_and_mask(spark):
    """Segments encoded on their own, reserved ids between, and the mask over assistants' texts alone."""
    rows = [(1, 0, "user", "Hello there"), (1, 1, "assistant", "Good day<|im_end|>"), (1, 2, "user", ""), (1, 3, "assistant", "")]
    ranks = bpe.load_ranks(spark, PATH)
    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    own = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    blocks = sorted(chat.format_chats(frame(spark, rows), ranks, PATTERN, 3).collect(), key=lambda r: (r["part"], r["block"]))
    want, mask = [], []
    for _, _, role, text in rows:
        head, body = own.encode_ordinary(role + "\n"), own.encode_ordinary(chat.escaped(text))
        want += [50256, *head, *body, 50257, *own.encode_ordinary("\n")]
        mask += [0] * (1 + len(head)) + [int(role == "assistant")] * len(body) + [0, 0]
    assert len(blocks) == 2
    assert [x for b in blocks for x in np.frombuffer(b["tokens"], "<u4").tolist()] == want
    assert [x for b in blocks for x in b["mask"]] == mask
    assert [b["offset"] for b in blocks] == [0, len(np.frombuffer(blocks[0]["tokens"], "<u4"))]


def test_attack_stays_text(spark):
    out = got(spark, [])[0]
    assert (out["conv_id"], out["n_turns"], out["loss_chars"]) == (-1, 2, len(chat.ATTACK))
    assert out["loss_sha256"] == hashlib.sha256(chat.ATTACK.encode()).hexdigest()
