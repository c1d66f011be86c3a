"""Stages of the corpus pipeline. Each takes the documents that its predecessor kept; all but the last return their columns.

Decisions are joined to rows by id and text, so rows that repeat an id are told apart; nothing is joined where a decision
follows from the text alone. A null text has no words and goes in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permaway.llm import language, neardup, packing, quality, substrings
from permaway.llm.store import short_batches

#: Ridge score that a text's language must reach; texts without a letter are `und` and go.
LEAST_LANGUAGE_SCORE = 0.2
#: Words that a worker remembers when it packs: fewer than by default, as it keeps them into what it works on next.
WORDS = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content lines hold enough of their words."""
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _where(docs, quality.verdict(F.col("row.text"), field), lambda x: quality.kept(x, field))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known well enough."""
    model = language.fit(*language.training_sample(docs, F.col("doc_id").isNotNull() & ~language.held_out(4, 2)))
    return _where(docs, language.prediction(F.col("row.text"), model), lambda x: (F.col(f"{x}.lang_pred") != "und") & (F.col(f"{x}.score") >= LEAST_LANGUAGE_SCORE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    gone = neardup.near_duplicates(docs, percent=80, shingle=5).where("NOT kept").select("doc_id", "text_hash").distinct()
    return _rows(docs).join(gone.hint("merge"), _own_row(), "left_anti").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that one with a smaller id has too; the words that stay are joined by spaces."""
    cut = substrings.repeated_substrings(docs, 50).where("kept_text IS NOT NULL").select("doc_id", "text_hash", "kept_text").dropDuplicates(["doc_id", "text_hash"])
    text = F.coalesce("kept_text", "row.text")
    changed = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text)).cast("long")}
    joined = _rows(docs).join(cut.hint("merge"), _own_row(), "left")
    return joined.select(*(changed.get(x, F.col("row")[x]).alias(x) for x in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    short_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, remember=WORDS)


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, so that their names cannot clash with others."""
    short_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"))


def _own_row() -> Column:
    return (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_hash"))


def _where(docs: DataFrame, verdict: Column, stays: Callable[[str], Column]) -> DataFrame:
    return _rows(docs).withColumn("verdict", verdict).where(stays("verdict")).select("row.*")
