"""What texts look like: prose, and dates by the shape of their characters."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame

from tableprofile.functions.columns import quoted, text

TEXT_SHARE = 0.5
# Four words with white space between them: more than three words.
FOUR_WORDS = r"(?U)[^\s\x1c-\x1f]+[\s\x1c-\x1f]+[^\s\x1c-\x1f]+[\s\x1c-\x1f]+[^\s\x1c-\x1f]+[\s\x1c-\x1f]+[^\s\x1c-\x1f]"

# Accepted date formats by shape, where 9 is a digit, a is a letter and ? makes the character
# before it optional. The first pattern that fits a value counts, so a day above twelve may come first.
DATE_SHAPES = (
    ("9999-99-99", "yyyy-MM-dd"),
    ("9999/99/99", "yyyy/MM/dd"),
    ("99?/99?/9999", "M/d/yyyy", "d/M/yyyy"),
    ("99?-99?-9999", "M-d-yyyy", "d-M-yyyy"),
    ("99?.99?.9999", "M.d.yyyy", "d.M.yyyy"),
    ("99999999", "yyyyMMdd"),
    ("99?/99?/9999 99:99", "M/d/yyyy HH:mm", "d/M/yyyy HH:mm"),
    ("99?/99?/9999 99:99:99", "M/d/yyyy HH:mm:ss", "d/M/yyyy HH:mm:ss"),
    ("9999-99-99 99:99", "yyyy-MM-dd HH:mm"),
    ("9999-99-99 99:99:99", "yyyy-MM-dd HH:mm:ss"),
    ("9999-99-99 99:99:99.99?9?9?9?9?", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    ("9999-99-99a99:99:99", "yyyy-MM-dd'T'HH:mm:ss"),
    ("9999-99-99a99:99:99a", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    ("9999-99-99a99:99:99.99?9?9?9?9?", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    ("9999-99-99a99:99:99.99?9?9?9?9?a", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    ("9999-99-99a99:99:99+99:99", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    ("9999-99-99a99:99:99-99:99", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    ("9999-99-99 99:99:99+99:99", "yyyy-MM-dd HH:mm:ssXXX"),
    ("9999-99-99 99:99:99-99:99", "yyyy-MM-dd HH:mm:ssXXX"),
    ("aaa 99?, 9999", "MMM d, yyyy"),
    ("aaaaa?a?a?a?a? 99?, 9999", "MMMM d, yyyy"),
    ("99? aaa 9999", "d MMM yyyy"),
    ("99?-aaa-9999", "d-MMM-yyyy"),
)
#: A date of eight digits is of these centuries.
CENTURIES = ("19", "20")
_COMPACT = "99999999"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def shapes(template: str) -> list[str]:
    """All shapes that a template stands for."""
    parts: list[tuple[str, ...]] = []
    for c in template:
        if c == "?":
            parts[-1] = (parts[-1][0], "")
        else:
            parts.append((c,))
    return sorted({"".join(p) for p in product(*parts)})


_ALL_SHAPES = sorted({s for template, *_ in DATE_SHAPES for s in shapes(template)})
_LONGEST = max(map(len, _ALL_SHAPES))


def _shape_sql(col: str) -> str:
    """SQL: the shape of a text; missing for one that is longer than any date, which is not looked through."""
    digits_and_letters, codes = "0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS)
    return f"CASE WHEN octet_length({col}) <= {_LONGEST} THEN translate({col}, {text(digits_and_letters)}, {text(codes)}) END"


def date_shaped_sql(name: str) -> str:
    """SQL aggregate: whether every known text has the shape of a date; true without known values."""
    col = quoted(name)
    listed = ", ".join(map(text, _ALL_SHAPES))
    return f"coalesce(bool_and(CASE WHEN {col} IS NOT NULL THEN coalesce({_shape_sql(col)} IN ({listed}), false) END), true)"


def parsed_as_dates(df: DataFrame, names: Sequence[str]) -> list[bool]:
    """Whether every known text of the columns is a date, from one scan; for columns of texts shaped like dates."""
    if not names:
        return []
    shaped = df.selectExpr(*[x for i, n in enumerate(names) for x in (f"{quoted(n)} AS t{i}", f"{_shape_sql(quoted(n))} AS s{i}")])
    tests = []
    for i in range(len(names)):
        branches = []
        for template, *formats in DATE_SHAPES:
            own = ", ".join(map(text, shapes(template)))
            parsed = " OR ".join(f"try_to_timestamp(t{i}, {text(f)}) IS NOT NULL" for f in formats)
            if template == _COMPACT:
                parsed = f"left(t{i}, 2) IN ({', '.join(map(text, CENTURIES))}) AND ({parsed})"
            branches.append(f"WHEN s{i} IN ({own}) THEN {parsed}")
        tests.append(f"coalesce(bool_and(CASE WHEN t{i} IS NULL THEN NULL {' '.join(branches)} ELSE false END), true)")
    return list(shaped.selectExpr(*tests).first())


def all_dates(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the text columns whose every known value is a date.

    One scan looks at shapes, which rules out most columns; one more parses those that are left.
    """
    if not names:
        return []
    row = df.selectExpr(*[date_shaped_sql(n) for n in names]).first()
    shaped = [n for n, ok in zip(names, row) if ok]
    return [n for n, ok in zip(shaped, parsed_as_dates(df, shaped)) if ok]


def prose_sql(name: str) -> str:
    """SQL aggregate: whether more than half of all rows have over three words; it stops at the fourth word."""
    return f"try_divide(DOUBLE(count_if({quoted(name)} RLIKE {text(FOUR_WORDS)})), count(1)) > {TEXT_SHARE}D"
