"""Near-duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

A first pass over the texts gives each row the hash of its shingle set and the hashes of its signature's bands. Sets that
share a band with another set are mates; all others are done. Mates are dealt into chunks of a bounded number of shingles,
components of the graph of shared bands side by side, and two chunks meet in a task only if a band has members of both. There,
candidates (pairs that share a band) are compared by batches of signature values: after each batch a pair is dropped when,
by the posterior of its similarity under a uniform prior, it reaches the threshold with less than the miss probability.
What survives is verified on the full sets, except where both are already in one component of the task. A task puts out
one link for each member at most, never all pairs. Links become components by stars, in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm.store import Scratch, map_batches, text_hash, text_of
from permaway.llm.words import GRAM, LOWER, grams, mix, slices, split_words, text_bytes

#: A pair at similarity 0.85 shares no band once in 40 million, one at 0.80 (the pipeline's threshold) once in 150,000.
BANDS, BAND_ROWS = 30, 5
VALUES = BANDS * BAND_ROWS
#: Signature values that are compared between two looks at the posterior.
BATCH = 25
#: Posterior probability under which a candidate is dropped.
MISS = 1e-9
#: Shingles in a chunk, on average; each set counts SET_WEIGHT more.
CHUNK_SHINGLES, SET_WEIGHT = 200_000, 200

_seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(GRAM))
FLIP, FACTOR = (_seeds[:VALUES] >> np.uint64(32)).astype(np.uint32), (_seeds[VALUES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one text after the other, and where each text's begin."""
    words = split_words(LOWER[data], offsets)
    hashes, counts = words.hashes(), words.counts()
    shingles, text, _ = grams(hashes, words.first, size)
    begins = np.searchsorted(text, np.arange(len(counts) + 1))
    sets = [np.unique(shingles[i:j]) if j > i else shingles[:0] for i, j in zip(begins[:-1], begins[1:], strict=True)]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        sets[d] = grams(hashes[words.first[d] : words.first[d + 1]], np.array([0, counts[d]]), int(counts[d]))[0]
    return np.concatenate([shingles[:0], *sets]), np.cumsum([0, *map(len, sets)])


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets: one row for each permutation."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((VALUES, len(first) - 1), np.uint32)
    for k in range(VALUES):
        out[k] = np.minimum.reduceat((short ^ FLIP[k]) * FACTOR[k], first[:-1])
    return out


def set_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each non-empty set."""
    return mix(np.add.reduceat(mix(values), first[:-1]) + np.diff(first).astype(np.uint64)).view(np.int64)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of each set, that differs between bands: sets by bands."""
    out = np.zeros((BANDS, signature.shape[1]), np.uint64)
    for row in range(BAND_ROWS):
        out = out * np.uint64(GRAM) + signature[row::BAND_ROWS] + np.uint64(1)
    return mix(out + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(GRAM)).T


def _banded(size: int):
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in slices(offsets):
            values, first = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
            counts = np.diff(first)
            some = np.flatnonzero(counts)
            node, bands = np.zeros(high - low, np.int64), np.zeros((0, BANDS), np.uint64)
            if len(some):
                begins = np.append(first[some], len(values))
                node[some] = set_hashes(values, begins)
                bands = band_hashes(signatures(values, begins))
            yield {
                "doc_id": batch.column("doc_id")[low:high],
                "text_hash": batch.column("text_hash")[low:high],
                "n_shingles": pa.array(counts, pa.int64()),
                "node": pa.array(node, mask=counts == 0),
                "bands": pa.ListArray.from_arrays(
                    pa.array(np.cumsum(np.append(0, (counts > 0) * BANDS)), pa.int32()), pa.array(bands.ravel().view(np.int64))
                ),
            }

    return work


def _mate_sets(size: int):
    """Sets and signatures of the mates; rows that repeat a mate's id with another set go."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = text_bytes(batch.column("text"))
        asked = batch.column("node").to_numpy(zero_copy_only=False)
        for low, high in slices(offsets):
            values, first = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
            some = np.flatnonzero(np.diff(first))
            if not len(some):
                continue
            begins = np.append(first[some], len(values))
            right = np.flatnonzero(set_hashes(values, begins) == asked[low:high][some])
            compact = (signatures(values, begins) & np.uint32(0xFFFF)).astype(np.uint16).T
            rows = pa.array(some[right] + low)
            yield {
                "node": batch.column("node").take(rows), "chunk": batch.column("chunk").take(rows),
                "signature": pa.array([compact[i].tobytes() for i in right], pa.binary()),
                "shingles": pa.array([values[begins[i] : begins[i + 1]].tobytes() for i in right], pa.binary()),
            }

    return work


def least_matches(percent: int) -> np.ndarray:
    """Matches needed after each batch for the posterior of similarity >= percent / 100 to reach MISS."""
    t, out = percent / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        # Under a uniform prior, P(S >= t | m of n) = P(Binomial(n + 1, t) <= m).
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _candidates(one: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share a band; within one side if there is no other."""
    keys = [np.zeros((BANDS, len(x)), np.uint64) for x in (one, one if other is None else other)]
    for key, side in zip(keys, (one, one if other is None else other), strict=True):
        for row in range(BAND_ROWS):
            key *= np.uint64(GRAM)
            key += side[:, row::BAND_ROWS].T
    shared = np.zeros((keys[0].shape[1], keys[1].shape[1]), bool)
    for a, b in zip(*keys, strict=True):
        shared |= a[:, None] == b[None, :]
    return np.nonzero(np.triu(shared, 1) if other is None else shared)


def links_of(nodes: np.ndarray, sides: np.ndarray, signature: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The members of a block that verified links join, each with the smallest node of its component."""
    here, there = np.flatnonzero(sides == sides.min()), np.flatnonzero(sides != sides.min())
    a, b = _candidates(signature[here], signature[there] if len(there) else None)
    a, b = here[a], (there if len(there) else here)[b]
    lengths = np.array([len(x) for x in sets])
    fit = 100 * np.minimum(lengths[a], lengths[b]) >= percent * np.maximum(lengths[a], lengths[b])
    a, b = a[fit], b[fit]
    matched = np.zeros(len(a), np.int64)
    for k, needed in enumerate(least_matches(percent)):
        own = slice(k * BATCH, (k + 1) * BATCH)
        matched += (signature[a, own] == signature[b, own]).sum(1)
        stays = matched >= needed
        a, b, matched = a[stays], b[stays], matched[stays]
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    order = np.argsort(-matched, kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (lengths[i] + lengths[j] - common):
                parent[max(x, y, key=lambda k: nodes[k])] = min(x, y, key=lambda k: nodes[k])
    roots = np.array([find(i) for i in range(len(nodes))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[roots[moved]]])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label, the smallest node it is joined with, of links (node, low) with low < node: rounds of large and small stars."""
    rounds = Scratch(scratch.spark)

    def large(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = both.groupBy("node").agg(F.least(F.min("low"), F.first("node")).alias("least"))
        return both.join(least, "node").where("low > node").select(F.col("low").alias("node"), F.col("least").alias("low")).where("low < node").distinct()

    def small(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("node").agg(F.min("low").alias("least"))
        moved = edges.join(least, "node").where("low > least").select(F.col("low").alias("node"), F.col("least").alias("low"))
        return moved.unionByName(least.withColumnRenamed("least", "low")).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first())

    before, edges = None, rounds.table(links.distinct(), "links")
    now = mark(edges)
    while now != before and now[0]:
        edges = rounds.table(small(large(edges)), "links")
        before, now = now, mark(edges)
    done = scratch.table(edges.withColumnRenamed("low", "label"), "labels")
    rounds.drop()
    return done


def _chunked(shared: DataFrame, reached: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """node, doc_id and chunk of each mate.

    Whole components of the bucket graph share chunks with others while they are small. Large ones are cut so that members of
    their most crowded bucket stay together.
    """
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("size"))
    homes = shared.join(sizes, "bucket").groupBy("node").agg(F.max(F.struct("size", "bucket"))["bucket"].alias("home"))
    homes = homes.join(reached, "node", "left").join(reps, "node").select(
        "node", "home", F.coalesce("label", "node").alias("group"), F.col("rep_id").alias("doc_id"), (F.col("n_shingles") + SET_WEIGHT).alias("weight")
    )
    homes = scratch.table(homes, "op6-homes")
    by_home = homes.groupBy("home", "group").agg(F.sum("weight").alias("home_weight"))
    by_group = homes.groupBy("group").agg(F.sum("weight").alias("group_weight"))
    small = max(1, -(-(homes.agg(F.sum("weight")).first()[0] or 0) // CHUNK_SHINGLES))
    part_of_home = F.pmod(F.xxhash64("node"), F.ceil(F.col("home_weight") / CHUNK_SHINGLES))
    piece = F.pmod(F.xxhash64("home", part_of_home), F.ceil(F.col("group_weight") / CHUNK_SHINGLES))
    chunk = F.when(F.col("group_weight") <= CHUNK_SHINGLES, F.pmod(F.xxhash64("group"), F.lit(small))).otherwise(F.xxhash64("group", piece))
    return scratch.table(homes.join(by_home, ["home", "group"]).join(by_group, "group").select("node", "doc_id", chunk.alias("chunk")), "op6-mates")


def near_duplicates(documents: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row.

    A text's set is its distinct shingles of so many words, ASCII letters in lower case; a text with fewer words is one
    shingle. Rows link when 100 * intersection >= percent * union. component_id is the smallest id that links reach. Rows
    without words are linked with nothing and are their own component; rows without an id are linked with nothing, have no
    component and are kept. Rows that repeat an id are judged by their own texts.
    """
    texts, scratch = text_of(documents), Scratch(documents.sparkSession)
    rows = scratch.table(map_batches(
        texts.withColumn("text_hash", text_hash()), _banded(shingle), "doc_id long, text_hash long, n_shingles long, node long, bands array<long>"
    ), "op6-bands")
    known = rows.where("doc_id IS NOT NULL AND node IS NOT NULL")
    banded = known.select("node", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket", "low")
    shared = scratch.table(banded.join(crowded, "bucket").distinct(), "op6-shared")

    reps = known.groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.first("n_shingles").alias("n_shingles"))
    reached = components(shared.where("low < node").select("node", "low"), scratch)
    mates = _chunked(shared, reached, reps, scratch)
    meeting = shared.join(mates.select("node", "chunk"), "node").select("bucket", "chunk").distinct()
    blocks = meeting.join(meeting.withColumnRenamed("chunk", "other"), "bucket").where("chunk <= other").select("chunk", "other").distinct()
    blocks = blocks.select(F.xxhash64("chunk", "other").alias("block"), F.explode(F.array_distinct(F.array("chunk", "other"))).alias("chunk"))
    sets = scratch.table(map_batches(
        # One way of joining at every size: the texts travel once.
        texts.join(mates.hint("merge"), "doc_id").select("text", "node", "chunk"), _mate_sets(shingle), "node long, chunk long, signature binary, shingles binary"
    ).dropDuplicates(["node"]), "op6-sets")

    def verify(table: pa.Table) -> pa.Table:
        signature = np.stack([np.frombuffer(x, np.uint16) for x in table["signature"].to_pylist()])
        shingles = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        node, low = links_of(table["node"].to_numpy(), table["chunk"].to_numpy(), signature, shingles, percent)
        return pa.table({"node": node, "low": low})

    links = sets.join(blocks, "chunk").select("block", "node", "chunk", "signature", "shingles").groupBy("block").applyInArrow(verify, "node long, low long")
    labels = components(links, scratch)
    tops = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct()).join(reps.select("node", "rep_id"), "node")
    lowest = tops.groupBy("label").agg(F.min("rep_id").alias("lowest"))
    of_node = reps.select("node", "rep_id").join(tops.join(lowest, "label").select("node", "lowest"), "node", "left").select(
        "node", F.coalesce("lowest", "rep_id").alias("lowest")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return scratch.result(rows.select("doc_id", "text_hash", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    ), "op6-components")
