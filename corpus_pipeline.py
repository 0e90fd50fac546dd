"""A training corpus from documents: language ID, line dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four
return the columns of documents; the last returns the pieces of the packed sequences with their ids.

Defined results: an empty table gives no rows at any stage. Null text has no language and goes in the
first stage, as does text without letters; null lang is not learned from; null doc_id, source and
n_chars are passed on, and null source is a source. Repeated rows, also of null doc_id, are copies of
each other, of which the third stage keeps one. Ties go as the operators say. Columns that documents
do not have in the given data pass through all stages but the last, unless they have the name of a
column that a stage adds for its own use (lang_pred, score, n_lines, n_dropped, keep, n_shingles,
component_id, kept, copy, rate, place), which then hold what that stage computed, or are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, minhash, mixing, packing
from tidemark.llm.common import cut, drop, table

#: A document goes if its language can't be told, or if its best score is less than this many times that of a
#: text which fits all languages of the model alike. Few texts with letters are: this is for noise only.
LEAST_GAIN = 1.2
#: Mean size of the mixed corpus in copies of what came before.
EPOCHS = 1.0


def _own(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns of docs, as far as a stage has left them."""
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c in df.columns])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language of those that the labelled ones are in."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model)
    least = LEAST_GAIN * language_id.chance(model) if len(model[0]) > 1 else 0.0
    return _own(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars is that of what stays. Those of which nothing
    stays go."""
    kept = line_dedup.keep_bitmaps(docs)
    text = line_dedup.kept_text(F.col("text"), F.col("keep"))
    kept = kept.withColumn("text", text).where(F.length("text") > 0)
    return _own(kept.withColumn("n_chars", F.length("text").cast("long")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Rows are told apart by where they are in the table."""
    return _own(minhash.near_dedup(docs, key=F.monotonically_increasing_id()).where("kept"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares, in shuffled order; copies of a document are equal rows."""
    return _own(mixing.mix(docs, epochs=EPOCHS), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids. Pieces of one row have its number in row, so copies
    of a document are told apart, and sequence_id and offset put them in their places."""
    return packing.pack(docs, with_ids=True)


STAGES = [("language_id", languages), ("line_dedup", lines), ("minhash", near_copies), ("mixing", mixture), ("packing", packed)]

#: Naive Bayes, MinHash and the tokenizer are beyond SQL; tests/llm holds stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, before = cut(stage(spark, docs, sf_dir)), docs
        drop(before)  # written by this function, or not at all
    return STAGES[-1][1](spark, docs, sf_dir)
