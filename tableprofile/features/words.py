"""Features of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprofile.functions.columns import ref, require_columns


def _plain(value: Column) -> Column:
    spaced = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " ")
    return F.trim(spaced)


def normalise_text(df: DataFrame, name: str) -> DataFrame:
    """All columns, ``name`` in lower case with one space for every run of other than letters and digits."""
    require_columns(df, [name], "object")
    return df.select(*[_plain(ref(c)).alias(c) if c == name else ref(c) for c in df.columns])


def text_size(df: DataFrame, name: str) -> DataFrame:
    """All columns, ``<name>_length`` in characters and ``<name>_words``; missing for a missing text."""
    require_columns(df, [name], "object")
    words = F.filter(F.split(_plain(ref(name)), " "), lambda w: w != "")
    return df.select(
        "*",
        F.char_length(ref(name)).alias(f"{name}_length"),
        F.when(ref(name).isNotNull(), F.size(words)).alias(f"{name}_words"),
    )


def _words(name: str) -> Column:
    """The words of a row's normalised text; missing for a missing text."""
    return F.array_remove(F.split(_plain(ref(name)), " "), "")


def _counted(df: DataFrame, key: str, name: str) -> DataFrame:
    """``<key>``, ``word`` and ``n`` of every row by itself, without a shuffle: runs of its sorted words."""
    split = F.sort_array(_words(name))
    rows = df.select(ref(key).alias("__key"), split.alias("w")).where(F.size("w") > 0)
    # Places where a run begins, and the end.
    begins = F.expr("filter(sequence(0, size(w) - 1), i -> i = 0 OR w[i] <> w[i - 1])")
    rows = rows.select("__key", "w", begins.alias("b"))
    counts = F.expr("transform(b, (x, i) -> named_struct('word', w[x], 'n', bigint(coalesce(get(b, i + 1), size(w)) - x)))")
    return rows.select(F.col("__key").alias(key), F.inline(counts))


def _repeats(df: DataFrame, key: str) -> bool:
    """Whether two rows have one key. Only keys are read and sent."""
    return df.groupBy(ref(key)).count().where("count > 1").limit(1).count() > 0


def bag_of_words(df: DataFrame, key: str, name: str) -> DataFrame:
    """``<key>``, ``word`` and ``n``: how often the row's normalised text has the word.

    A row's words are counted where the row lies. Only if keys repeat are the counts of equal keys,
    missing ones among them, added up in a shuffle.
    """
    require_columns(df, [key])
    require_columns(df, [name], "object")
    return _bag(df, key, name, _repeats(df, key))


def _bag(df: DataFrame, key: str, name: str, repeats: bool) -> DataFrame:
    counted = _counted(df, key, name)
    return counted.groupBy(ref(key), "word").agg(F.sum("n").alias("n")) if repeats else counted


def tf_idf(df: DataFrame, key: str, name: str) -> DataFrame:
    """``bag_of_words`` with ``weight``: n times ln((1 + rows) / (1 + rows with the word)) + 1.

    Rows are those whose text is not missing, and rows of one key are one. The bag is sent once, to the
    words' numbers of rows, which tasks count before they send them; a word of very many rows is a
    skewed key of a plain join, which adaptive execution splits.
    """
    require_columns(df, [key])
    require_columns(df, [name], "object")
    repeats = _repeats(df, key)
    bag = _bag(df, key, name, repeats)
    rows = df.select(F.count(ref(name)).alias("n")).scalar()
    # Where keys are unique the bag need not be made for the numbers of rows.
    found = bag.select(F.col("word").alias("__word")) if repeats else df.select(F.explode(F.array_distinct(_words(name))).alias("__word"))
    spread = found.groupBy("__word").agg(F.count("*").alias("__rows"))
    joined = bag.join(spread, F.col("word") == F.col("__word"))
    idf = F.log((rows + 1) / (F.col("__rows") + 1)) + 1
    return joined.select(ref(key), "word", "n", (F.col("n") * idf).alias("weight"))
