"""Labelled texts for training: bounded samples, and all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from permaway.llm.store import text_of


def smallest_hashes(ids: DataFrame, group: str, most: int) -> DataFrame:
    """At most `most` rows of each value of `group` (a few values), those with the smallest hash of doc_id, with their rank.

    Counts by value tell under which hash so many rows and some more are expected; only those are ranked, so that what a
    task gathers does not grow with the rows.
    """
    counts = {r[group]: r["count"] for r in ids.groupBy(group).count().collect()}
    if not counts:
        return ids.withColumn("rank", F.lit(1))
    wanted = (most + 6 * most**0.5 + 10) * float(1 << 32)
    limits = F.create_map(*(F.lit(x) for value, n in counts.items() for x in (value, wanted / n)))
    low = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < limits[F.col(group)])
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), "doc_id"))
    return low.withColumn("rank", rank).where(F.col("rank") <= most)


def labelled(documents: DataFrame, labels: DataFrame, column: str, most: int, admit: Column) -> list[Row]:
    """doc_id, text and label of at most `most` documents of each label 0 and 1, picked by the hash of the id.

    Only ids travel until the picks are made. An id with several texts or labels gives the least of each.
    """
    ids = text_of(documents).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & admit).select("doc_id").distinct()
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("label IN (0, 1)")
    label = label.groupBy("doc_id").agg(F.min("label").alias("label")).join(ids, "doc_id", "left_semi")
    picked = smallest_hashes(label, "label", most)
    rows = text_of(documents).where(admit).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "rank").agg(F.min("text").alias("text"))
    return sorted(rows.collect(), key=lambda r: (r["label"], r["rank"]))


def every_labelled(documents: DataFrame, labels: DataFrame, column: str, task_texts: int) -> DataFrame:
    """doc_id, text and label of every document with label 0 or 1, about `task_texts` to a partition, mixed by the hash of the id.

    An id with several texts or labels gives the least of each.
    """
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    label = label.groupBy("doc_id").agg(F.min("label").alias("label"))
    parts = max(1, -(-label.count() // task_texts))
    texts = text_of(documents).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).repartition(parts, "doc_id")
    joined = texts.join(label.repartition(parts, "doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return joined.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
