"""The corpus pipeline: documents through the stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from permaway.llm import stages
from permaway.llm.store import Scratch, documents

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("packing", stages.packing_stage),
]

#: SQL cannot express the trained models and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of what the stages keep of the documents."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        after = Scratch(spark)
        docs = after.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
