"""From raw documents to packed training sequences, in five stages.

Each stage is given what the stage before it kept, as a table, and all but the last return the
columns of ``documents``. ``run`` writes every stage's rows to the folder that executors share and
reads them again, so that a lost executor costs a task and not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprofile.llm import jaccard, language, lines, packing, substrings
from tableprofile.llm.scratch import written

#: The least score with which a document's language counts as told. Only votes in a circle get below it.
MIN_LANGUAGE_SCORE = 0.2
#: The least likeness to the language that won. The least of all labelled rows of sf0.1 is -7.5.
MIN_LANGUAGE_LIKENESS = -8.0


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` stays as it is.

    Documents without a letter, with a null text, or unlike the language that won the votes go:
    junk and texts of languages that no row is labelled with. A text of a few words, or one that
    shares its letters and endings with a learnt language, can be too near to tell and stays.
    """
    found = language.identify(docs, language.train(docs), MIN_LANGUAGE_LIKENESS)
    kept = (F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)
    return found.filter(kept).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share; a document left without a word goes.

    The first document, by id, that has such a line keeps it.
    """
    cleaned = lines.drop_boilerplate(docs)
    return cleaned.filter((F.col("__n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies."""
    return jaccard.keep_one_each(docs)


def without_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document of smaller id has; one left without a word goes."""
    cleaned = substrings.remove_shared_passages(docs)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    left = cleaned.filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_words")))
    return left.withColumn("text", text).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: which words of which document stand where."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", without_near_copies),
    ("substring_dedup", without_shared_passages),
    ("packing", packed),
]

#: Language identification and packing cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
