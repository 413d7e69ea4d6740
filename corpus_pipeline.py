"""The corpus pipeline: quality, lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the
stage before it kept, written as Parquet and read again.  All stages but the last return the
columns of ``documents``.

Rows with a null id, null, empty and blank texts are scored like any other and otherwise pass every
stage; rows that repeat an id stay or go together, but for their own texts' scores and passages.
Empty tables stay empty, a column that is missing is not made up, and further columns, whatever
their names, are carried to the last stage, which has columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, decontaminate, line_dedup, minhash_near_dedup, quality
from quarryline.llm.common import materialise, read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, doesn't reject."""
    machine = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that a smaller one holds; one of which nothing else is left
    goes, as all of it is in others."""
    kept = line_dedup.drop_repeated_lines(docs, drop_emptied=True)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id."""
    return minhash_near_dedup.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), mode="documents")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its identifiers and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", own_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
