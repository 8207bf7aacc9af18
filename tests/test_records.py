import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tableprofile as tp
from tableprofile.sources.records import quoted_after, records


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text('a,"\n ', max_size=6), min_size=2, max_size=4), min_size=1, max_size=5))
def test_states_follow_the_records(rows):
    """The lines at which the state is outside are the ends of the records that a CSV writer made."""
    ends, text = [], io.StringIO()
    for row in rows:
        csv.writer(text, lineterminator="\n").writerow(row)
        ends.append(text.getvalue().count("\n"))
    inside, found = False, []
    for i, line in enumerate(text.getvalue().split("\n")[:-1], 1):
        inside = quoted_after(line, inside)
        if not inside:
            found.append(i)
    assert found == ends


@pytest.mark.parametrize("line,out", [('5" pipe,a', False), ('a,"b""', True), ('"a" x,"b', True), ('a,"b",', False), ('x"y,"z"', False)])
def test_quotes_in_unquoted_fields_are_text(line, out):
    assert quoted_after(line, False) is out


@pytest.fixture
def broken(tmp_path):
    """Files with line breaks, commas and quotes in fields; one field is longer than many splits."""
    rng = random.Random(6)
    rows = []
    for k in range(3):
        own = []
        for i in range(120):
            note = "".join(rng.choice(['a', 'b c', '\n', '"', ',', '\r\n', 'x' * 9]) for _ in range(rng.randint(0, 12)))
            own.append([str(k * 1000 + i), "n" + note + ("line\n" * 900 if i == 60 else ""), str(i / 2)])
        with open(tmp_path / f"part-{k}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if k == 1 else "\n")
            out.writerow(["id", "the\nnote", "half"])
            out.writerows(own)
        rows += own
    return str(tmp_path), rows


@pytest.mark.parametrize("split", ["64m", "300b"])
def test_split_files_give_the_same_rows(spark, broken, split):
    path, rows = broken
    options = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        if split == "300b":
            assert spark.read.text(path).rdd.getNumPartitions() > 40
        assert records(spark, path).where("first").count() == 3
        df = tp.read_csv(spark, path)
        assert df.dtypes == [("id", "bigint"), ("the\nnote", "string"), ("half", "double")]
        got = sorted((r[0], r[1], r[2]) for r in df.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((int(a), b.replace("\r\n", "\n"), float(c)) for a, b, c in rows)
