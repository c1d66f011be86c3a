"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams of three lengths that occur in both, over the root of the numbers in
each: a blended spectrum of presence bits, hashed into buckets. Landmarks from a bounded sample give Nyström features, and
one-versus-rest kernel ridge regression the weights. Since the kernel is a product of presence rows, landmarks and weights
are multiplied once into one matrix of buckets by languages; texts are scored by products of batches of rows with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm.samples import smallest_hashes
from permaway.llm.store import text_column, text_of
from permaway.llm.words import LOWER, slices, text_bytes

#: Lengths of the n-grams, and the buckets of each length (a power of two).
LENGTHS, BUCKET_BITS = (3, 4, 5), 14
WIDTH = len(LENGTHS) << BUCKET_BITS
#: Texts that are scored by one product; buckets that are unpacked at once when the model is fitted.
ROWS, BLOCK = 64, 1 << 12
#: Bounds of the training sample: texts a language, landmarks of these, bytes of a text. Longer texts are not learned from.
SAMPLE, LANDMARKS, SAMPLE_BYTES = 300, 100, 20_000
RIDGE = 1e-2


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets by languages


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence bits of the n-grams of texts, ASCII letters in lower case: texts by buckets."""
    out = np.zeros((len(offsets) - 1, WIDTH), np.uint8)
    flat = out.reshape(-1)
    text = np.repeat(np.arange(len(offsets) - 1) * WIDTH, np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(len(data))
    value = np.zeros(len(data), np.uint64)
    low = LOWER[data].astype(np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        value = value[: len(data) - n + 1] | low[n - 1 :] << np.uint64(8 * (n - 1)) if len(data) >= n else value[:0]
        if n in LENGTHS:
            bucket = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (LENGTHS.index(n) << BUCKET_BITS)
            whole = place[: len(value)] + n <= end[: len(value)]
            flat[(text[: len(value)] + bucket)[whole]] = 1
    return out


def _normal(bits: np.ndarray) -> np.ndarray:
    """One over the root of each row's own kernel; 0 for rows without n-grams."""
    own = bits.sum(1, dtype=np.int64)
    return np.where(own > 0, 1 / np.sqrt(np.maximum(own, 1)), 0).astype(np.float32)


def _unpacked(packed: np.ndarray, low: int) -> np.ndarray:
    """One block of buckets of packed presence rows."""
    return np.unpackbits(packed[:, low // 8 : (low + BLOCK) // 8], axis=1).astype(np.float32)


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS) -> LanguageModel:
    """Nyström features from the first landmarks of each language, then ridge regression of one language against the rest."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((WIDTH, 0), np.float32))
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    # Presence rows are held packed, and the kernel is summed up over blocks of buckets: one block of all rows is unpacked at a time.
    packed, norm = [], []
    for i, j in slices(offsets, rows=ROWS):
        bits = presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        packed.append(np.packbits(bits, axis=1))
        norm.append(_normal(bits))
    packed, norm = np.concatenate(packed), np.concatenate(norm)
    kinds = np.array([names.index(x) for x in languages])
    marks = np.concatenate([np.flatnonzero(kinds == k)[:landmarks] for k in range(len(names))])
    kernel = np.zeros((len(packed), len(marks)))
    for low in range(0, WIDTH, BLOCK):
        kernel += _unpacked(packed, low) @ _unpacked(packed[marks], low).T
    kernel *= norm[:, None] * norm[marks]
    values, vectors = np.linalg.eigh(kernel[marks])
    large = values > 1e-6 * values[-1]
    project = vectors[:, large] / np.sqrt(values[large])
    features = kernel @ project
    share = 1 / np.maximum(np.bincount(kinds, minlength=len(names)), 1)
    weighted = features * share[kinds][:, None]  # each language counts alike
    ridge = weighted.T @ features + RIDGE * np.eye(features.shape[1]) / len(names)
    solved = np.linalg.solve(ridge, weighted.T @ (kinds[:, None] == np.arange(len(names))))
    solved = norm[marks, None] * (project @ solved)
    return LanguageModel(names, np.concatenate([_unpacked(packed[marks], low).T @ solved for low in range(0, WIDTH, BLOCK)]).astype(np.float32))


def scores(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ridge scores of at most ROWS texts: texts by languages."""
    bits = presence(data, offsets)
    return bits.astype(np.float32) @ model.weights * _normal(bits)[:, None]


def training_sample(documents: DataFrame, learn: Column, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts and languages of at most `most` ids a language, picked by the hash of the id, among those that `learn` admits.

    An id with several texts or languages gives the least of each.
    """
    admitted = documents.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= SAMPLE_BYTES))
    picked = smallest_hashes(admitted.groupBy("doc_id").agg(F.min("lang").alias("lang")), "lang", most)
    rows = admitted.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], r["rank"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def prediction(text: Column, model: LanguageModel) -> Column:
    """A struct of lang_pred and score of a text."""
    names = pa.array([*model.languages, "und"])

    def work(texts: pa.Array, lettered: pa.Array) -> Iterator[dict]:
        data, offsets = text_bytes(texts)
        letters = lettered.to_numpy(zero_copy_only=False).astype(bool)
        for low, high in slices(offsets, rows=ROWS):
            got = scores(model, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            known = letters[low:high] & bool(model.languages)
            best = np.where(known, got.argmax(1), len(model.languages)) if model.languages else np.zeros(high - low, np.int64)
            top = np.where(known, np.clip(got.max(1, initial=0), 0, 1), 0.0)
            yield {"lang_pred": names.take(pa.array(best)), "score": pa.array(top, pa.float64())}

    return text_column(work, "lang_pred string, score double")(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    Texts that are null or have no letter are `und` with score 0, as is every text if no language was learned. Of equal
    scores the first language by name wins. Repeated rows and null ids are rows like any other; no rows give no rows.
    """
    return text_of(documents).select("doc_id", prediction(F.col("text"), model).alias("found")).select("doc_id", "found.*")


def held_out(parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) falls into the part; an absent id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))
