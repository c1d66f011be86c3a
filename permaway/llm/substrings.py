"""Substring deduplication by level-wise doubling.

The lengths double from one of LEAST words or more up to the wanted one. Below it not every window is looked at: of all
windows of a level's length that lie in a wanted window, the one with the smallest hash stands for it, so that equal wanted
windows choose equal ones wherever they occur. One pass over the texts gives the chain of what each wanted window chose at every
level. Level by level, chains whose window is found in one document only are dropped, and what is left is extended to twice
the length, until no candidate survives or the wanted length is reached: there, of the documents that hold survivors, each
wanted window around one is compared, and those that also start in a document with a smaller id decide. Doubling ends there, as
longer windows cannot change the result.

Documents of equal word sequence are one before level 1: of these only the smallest id is searched; the others repeat it
whole. Texts travel once, and only counted hashes do otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm.store import Scratch, list_array, map_batches, text_hash, text_of
from permaway.llm.words import Words, grams, inside, runs, slices, split_words, text_bytes

#: No level below the wanted length has fewer words: windows that short repeat by chance.
LEAST = 12


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words, list[bytes]]]:
    """Row ranges of a batch with their words, and each text's words joined by one space."""
    data, offsets = text_bytes(batch.column("text"))
    for low, high in slices(offsets):
        own = offsets[low : high + 1] - offsets[low]
        words = split_words(data[offsets[low] : offsets[high]], own)
        raw, own = words.data.tobytes(), own.tolist()
        yield low, high, words, [b" ".join(raw[i:j].split()) for i, j in zip(own[:-1], own[1:], strict=True)]


def _running(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best of each run of `size` values, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def levels(length: int, least: int = LEAST) -> list[int]:
    """Window lengths up to the wanted one, each half of the next, rounded up."""
    sizes = [length]
    while sizes[0] > 1 and (half := -(-sizes[0] // 2)) >= least:
        sizes.insert(0, half)
    return sizes


def _chains(words: Words, sizes: list[int], length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct chains of each text, in its order: the text, and the hash that is chosen at each level below the wanted one."""
    hashes = words.hashes()
    text, place = inside(words.first, length)
    lows = [_running(runs(hashes, size), length - size + 1, np.minimum)[place] for size in sizes] if len(place) else [place.astype(np.uint64)] * len(sizes)

    def distinct(text, lows):
        new = np.ones(len(text), bool)
        if len(text):
            new[1:] = text[1:] != text[:-1]
            for low in lows:
                new[1:] |= low[1:] != low[:-1]
        return text[new], [low[new] for low in lows]

    text, lows = distinct(text, lows)  # neighbours mostly choose the same
    order = np.lexsort((*lows, text))
    return distinct(text[order], [low[order] for low in lows])


def _lower_levels(sizes: list[int], length: int):
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for low, high, words, joined in _sliced(batch):
            text, lows = _chains(words, sizes, length)
            bounds = np.searchsorted(text, np.arange(high - low + 1))
            yield {
                "doc_id": batch.column("doc_id")[low:high],
                "text_hash": batch.column("text_hash")[low:high],
                "n_words": pa.array(words.counts(), pa.int64()),
                "words_sha256": pa.array([hashlib.sha256(x).digest() for x in joined], pa.binary()),
                **{f"level_{k}": list_array(bounds, pa.array(x.view(np.int64))) for k, x in enumerate(lows)},
            }

    return work


def _last_level(half: int, length: int):
    """The distinct windows of the wanted length around the survivors of each document."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [x.view(np.uint64) for x in batch.column("survivors").to_numpy(zero_copy_only=False)]
        for low, high, words, joined in _sliced(batch):
            hashes = words.hashes()
            halves, half_text, half_place = grams(hashes, words.first, half)
            wholes, text, place = grams(hashes, words.first, length)
            half_first, first = (np.searchsorted(x, np.arange(high - low + 1)) for x in (half_text, text))
            near = np.zeros(len(hashes) + 1, np.int64)
            for d in range(high - low):
                own = slice(half_first[d], half_first[d + 1])
                hit = half_place[own][np.isin(halves[own], found[low + d])]
                # A wanted window around a survivor at p starts at p - (length - half) .. p.
                np.add.at(near, np.maximum(hit - (length - half), words.first[d]), 1)
                np.add.at(near, hit + 1, -1)
            around = np.cumsum(near)[place] > 0
            lists = [np.unique(wholes[i:j][around[i:j]]) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield {
                "doc_id": batch.column("doc_id")[low:high],
                "words_sha256": pa.array([hashlib.sha256(x).digest() for x in joined], pa.binary()),
                "text": batch.column("text")[low:high],
                "wholes": list_array(np.cumsum([0, *map(len, lists)]), pa.array(np.concatenate(lists).view(np.int64))),
            }

    return work


def _removed(length: int):
    """The texts without the words that the repeated windows cover."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [x.view(np.uint64) for x in batch.column("repeated").to_numpy(zero_copy_only=False)]
        for low, high, words, _ in _sliced(batch):
            wholes, text, place = grams(words.hashes(), words.first, length)
            first = np.searchsorted(text, np.arange(high - low + 1))
            edges = np.zeros(len(words.starts) + 1, np.int64)
            for d in range(high - low):
                own = slice(first[d], first[d + 1])
                hit = place[own][np.isin(wholes[own], found[low + d])]
                edges[hit] += 1
                edges[hit + length] -= 1
            keep = np.cumsum(edges)[:-1] == 0
            raw, starts, ends, begins = words.data.tobytes(), words.starts.tolist(), words.ends.tolist(), words.first.tolist()
            kept = [np.flatnonzero(keep[i:j]) + i for i, j in zip(begins[:-1], begins[1:], strict=True)]
            yield {
                "doc_id": batch.column("doc_id")[low:high],
                "words_sha256": batch.column("words_sha256")[low:high],
                "n_removed": pa.array(words.counts() - [len(x) for x in kept], pa.int64()),
                "kept_text": pa.array([b" ".join([raw[starts[i] : ends[i]] for i in x.tolist()]).decode() for x in kept], pa.string()),
            }

    return work


def _found_twice(windows: DataFrame, column: str) -> DataFrame:
    """Windows that documents of different ids hold, and the smallest of these ids."""
    return windows.groupBy(column).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(column, "low")


def repeated_substrings(documents: DataFrame, length: int = 50, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, kept_text and words_sha256 of every row.

    Words covered by a window of `length` words whose sequence also starts in a document with a smaller id are removed;
    kept_text joins the others by one space and is null where nothing is removed; words_sha256 (binary) is of all words so
    joined. Texts that are null or shorter than a window lose nothing. Rows without an id neither lose words nor make others
    lose them. Of rows that repeat an id, each is judged by its own words; an equal id is not a smaller one. Levels start at
    `least` words or more; with `length` under twice that, the windows of half the length are the only level before the last.
    """
    sizes = levels(length, least)[:-1] or [-(-length // 2)]
    names = [f"level_{k}" for k in range(len(sizes))]
    texts, scratch = text_of(documents), Scratch(documents.sparkSession)
    first = scratch.table(map_batches(
        texts.withColumn("text_hash", text_hash()), _lower_levels(sizes, length),
        "doc_id long, text_hash long, n_words long, words_sha256 binary, " + ", ".join(f"{x} array<long>" for x in names),
    ), "op2-first")

    # Of equal word sequences the smallest id stands for all.
    whole = first.where(f"doc_id IS NOT NULL AND n_words >= {length}")
    smallest = whole.groupBy("words_sha256").agg(F.min("doc_id").alias("smallest_id"), F.count("*").alias("copies"))
    stand = whole.join(smallest.withColumnRenamed("smallest_id", "doc_id"), ["words_sha256", "doc_id"], "left_semi")
    live = scratch.table(stand.select("doc_id", F.inline(F.arrays_zip(*names))), "op2-chains")
    for level, name in enumerate(names):
        live = scratch.table(live.join(_found_twice(live, name).select(name), name).select("doc_id", *names[level:]), f"op2-survivors{level}")
        if live.isEmpty():
            break
    survivors = live.groupBy("doc_id").agg(F.collect_set(names[-1]).alias("survivors"))
    second = scratch.table(map_batches(
        texts.join(survivors, "doc_id"), _last_level(sizes[-1], length), "doc_id long, words_sha256 binary, text string, wholes array<long>"
    ).where(F.size("wholes") > 0), "op2-second")

    wholes = second.select("doc_id", F.explode("wholes").alias("whole"))
    lost = wholes.join(_found_twice(wholes, "whole"), "whole").where("low < doc_id").groupBy("doc_id").agg(F.collect_set("whole").alias("repeated"))
    cut = map_batches(
        second.join(lost, "doc_id").select("doc_id", "words_sha256", "text", "repeated"),
        _removed(length), "doc_id long, words_sha256 binary, n_removed long, kept_text string",
    ).dropDuplicates(["doc_id", "words_sha256"])
    copied = smallest.where("copies > 1").select("words_sha256", "smallest_id")
    rows = first.select("doc_id", "text_hash", "n_words", "words_sha256").join(cut, ["doc_id", "words_sha256"], "left").join(copied, "words_sha256", "left")
    copy = F.col("smallest_id") < F.col("doc_id")
    return scratch.result(rows.select(
        "doc_id", "text_hash", "n_words", "words_sha256",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    ), "op2-kept")
