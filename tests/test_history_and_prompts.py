import pytest

import tableprofile as tp
from tableprofile.plans import messages as M
from tests.conftest import column, dicts

TURNS = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(30)]
TURNS += [(2, 0, "user", "only"), (3, 5, "user", "a"), (3, 2, "user", None)]


def expected_history():
    out = {}
    for conv, turn, _, _ in TURNS:
        before = sorted((t, r, x) for c, t, r, x in TURNS if c == conv and t < turn)
        out[conv, turn] = "\n".join(f"{r}: {x or ''}" for _, r, x in before)
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1024])
def test_history_does_not_depend_on_blocks(spark, block):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["history"] for r in tp.chat_history(df, block).collect()}
    assert got == expected_history()


def test_history_of_times_and_of_tied_turns(spark):
    """Turns far apart make few blocks; lines of one turn are in order of their text."""
    rows = [(1, 1_700_000_000_000 + 6_000_000 * k, "user", f"t{k}") for k in range(20)]
    rows += [(2, 5, "b", "x"), (2, 5, "a", "y"), (2, 2_000_000, "c", "z")]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"], r["history"].count("\n")): r["history"] for r in tp.chat_history(df).collect()}
    last = max(k for k in got if k[0] == 1)
    assert got[last] == "\n".join(f"user: t{k}" for k in range(19))
    assert got[2, 2_000_000, 1] == "a: y\nb: x"


QUESTIONS = [
    ("What is MISSING here?", "missing"),
    ("any Pattern?", "pattern"),
    ("pattern of missing values", "missing"),
    ("feature pattern", "pattern"),
    ("engineering tips", "feature"),
    ("how is it distributed", "distribution"),
    ("correlated columns in the model", "correlation"),
    ("relationship", "correlation"),
    ("prepare", "prepare"),
    ("which model", "prepare"),
    ("hello", "generic"),
]


def test_answers(spark):
    table = spark.createDataFrame([(1, None, None), (2, None, 1)], "a int, b int, c int")
    asked = spark.createDataFrame([(q,) for q, _ in QUESTIONS], "question string")
    got = {r["question"]: r for r in tp.answer_questions(asked, table).collect()}
    for question, intent in QUESTIONS:
        assert got[question]["intent"] == intent, question
        if intent != "missing":
            assert got[question]["answer"] == M.ANSWERS[intent]
    assert got["What is MISSING here?"]["answer"] == M.ANSWERS["missing"].format(
        n=3, columns=["b", "c", "a"]
    )
    assert set(column(tp.answer_questions(asked, None), "answer")) == {M.ANSWERS["no_table"]}


def responses(spark, rows):
    return spark.createDataFrame(rows, "request_id int, task string, text string")


def test_response_lengths(spark):
    rows = [(1, "eda", None), (2, "eda", "x" * 50), (3, "eda", "x" * 51), (4, "eda", " " * 30 + "y" * 21)]
    df = responses(spark, rows)
    assert dicts(tp.valid_responses(df), "request_id") == [
        {"request_id": 3, "task": "eda", "text": "x" * 51},
        {"request_id": 4, "task": "eda", "text": "y" * 21},
    ]
    chat = responses(spark, [(1, "", "x" * 10), (2, "", "x" * 11), (3, "", None)])
    assert [r["request_id"] for r in tp.valid_responses(chat, "chat").collect()] == [2]
    with pytest.raises(ValueError):
        tp.valid_responses(df, "other")


def test_other_tasks_need_a_good_exploration(spark):
    long = "z" * 60
    df = responses(
        spark, [(1, "eda", long), (1, "feature", long), (1, "quality", "z"), (2, "eda", "z"), (2, "quality", long)]
    )
    got = {(r["request_id"], r["task"]) for r in tp.valid_responses(df).collect()}
    assert got == {(1, "eda"), (1, "feature")}


def test_context_and_prompts(spark):
    df = spark.createDataFrame(
        [(i, float(i * 2), None if i < 2 else "x") for i in range(8)], "id int, v double, s string"
    )
    context = tp.profile_context(df, ["id"])
    row = context.first()
    assert row["shape"] == "8 rows, 3 columns"
    assert row["columns_info"] == "- id (int64)\n- v (float64)\n- s (object)"
    assert row["missing_info"] == "- s: 2 missing values (25.0%)"
    assert row["correlations"] == "v and id: 1.000"
    assert row["basic_stats"].split("\n")[1].startswith("v: count=8, mean=7.0000, std=4.8990, min=0.0000")
    assert row["sample_data"].split("\n") == ["id | v | s", "0 | 0.0 | NaN", "1 | 2.0 | NaN"] + [
        f"{i} | {i * 2.0} | x" for i in (2, 3, 4)
    ]
    tasks = {r["task"]: r["prompt"] for r in tp.task_prompts(context).collect()}
    assert set(tasks) == {"eda", "feature", "quality"}
    assert row["sample_data"] in tasks["eda"] and row["missing_info"] in tasks["quality"]
    assert row["missing_info"] not in tasks["feature"] and row["correlations"] in tasks["feature"]

    asked = spark.createDataFrame([("why?", ""), ("and?", "user: why?")], "question string, history string")
    got = {r["question"]: r for r in tp.question_prompts(asked, context).collect()}
    assert (got["why?"]["task"], got["and?"]["task"]) == ("qa", "memory")
    assert "user: why?" in got["and?"]["prompt"] and "Question: and?" in got["and?"]["prompt"]
    assert set(column(tp.question_prompts(asked.drop("history"), context), "task")) == {"qa"}


def test_context_without_numbers(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    row = tp.profile_context(df, ["s"]).first()
    assert row["basic_stats"] == "s: count=3, unique=2, top=a, freq=2"
    assert row["correlations"] == M.CONTEXT["no_pairs"]
    assert row["missing_info"] == M.CONTEXT["no_missing"]
    long = tp.profile_context(df, ["s"], "profile").first()
    assert long["correlations"] == M.CONTEXT["profile_too_few"]
    assert long["basic_stats"].endswith("s top values: a=2, b=1")
    with pytest.raises(ValueError):
        tp.profile_context(df, ["s"], "other")
