import pytest

from tableprofile.llm import substrings as sub


def brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def found(df, **options):
    rows = sub.remove_shared_passages(df, **options).collect()
    for r in rows:
        assert sum(s["last"] - s["first"] + 1 for s in r["__removed"]) == r["__n_removed"]
    return sorted(((r["doc_id"], r["__n_words"], r["__n_removed"], r["__kept"]) for r in rows), key=repr)


@pytest.mark.parametrize("width,period,block", [(13, 7, 4 << 20), (13, 7, 700), (5, 3, 300), (6, 1, 999), (4, 4, 50)])
def test_against_brute_force(documents, prose, width, period, block):
    passage, line = prose(99, 20), prose(98, 13)
    rows = [(k, prose(k, 30)) for k in range(20)]
    rows += [(100 + k, f"{prose(k, 7)} {passage} {prose(k + 50, 3 + k)}") for k in range(15)]
    rows += [(200, f"{line}\t{line}\n{line}"), (201, line), (202, f"x {line}"), (203, " ".join(line.split()[:12]))]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, "é ü " * 40), (302, "é ü " * 9)]
    assert found(documents(rows), width=width, period=period, block=block) == brute(rows, width)


def test_odd_rows(documents, odd_rows, prose):
    text = prose(5, 40)
    rows = [*odd_rows, (9, text), (None, text), (10, text), (8, text)]
    assert found(documents(rows)) == brute(rows, 13)
    assert found(documents(rows).limit(0)) == []
    with pytest.raises(ValueError):
        sub.remove_shared_passages(documents(rows), width=3, period=4)


def test_one_very_long_text(documents, prose):
    long = prose(1, 200_000, 50_000)
    rows = [(1, long), (2, " ".join(long.split()[70_000:90_000]) + " tail")]
    got = found(documents(rows))
    assert got[1][1:] == (20_001, 20_000, "tail")


def test_columns_stay(documents, prose):
    docs = documents([(1, prose(1)), (2, prose(1))])
    out = sub.passages_removed(docs)
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} == {prose(1), ""}


@pytest.mark.parametrize("period", range(1, 14))
def test_difference_cover(period):
    cover = sub.difference_cover(period)
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def test_words_built_to_collide(documents):
    """Words that a polynomial hash cannot tell apart are not the same."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    tail = " ".join(f"k{i}" for i in range(12))
    out = {r["doc_id"]: r["n_removed"] for r in sub.substring_digest(documents([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{y} {tail}")])).collect()}
    assert out == {1: 0, 2: 0, 3: 13}
