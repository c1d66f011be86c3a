"""Toxicity by a convolutional text classifier in NumPy.

A word's embedding is the sum of hashed rows for the word and for two of its beginnings. Filters of several widths run over
the words of a text, max pooling keeps each filter's strongest answer, and a logistic layer scores them. Training is
stochastic gradient descent on every labelled text; the gradient of a pooled value goes to the window that gave it. Tasks
train side by side on their own texts, and after each round Spark averages their parameters. For each language the threshold
that separates a part of the texts kept from training best becomes score 0.5; the language of a text is predicted from the
text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm import language
from permaway.llm.samples import every_labelled
from permaway.llm.store import Scratch, list_array, map_batches, text_of
from permaway.llm.words import LOWER, slices, span_hashes, split_words, text_bytes
from permaway.operators.scan import following, ordered_scan, running_sum, total

#: Rows of the embedding (a power of two), its size, filter widths, filters of each, and bytes of the beginnings of a word.
HASH_BITS, SIZE, WIDTHS, FILTERS, PREFIXES = 16, 16, (1, 2, 3), 8, (4, 6)
#: Share of the texts that sets thresholds, and positive texts a language needs there for one of its own.
CALIBRATION, LEAST_POSITIVES = 0.25, 12
FALSE_ALARM = 4
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 32, 0.05, 1e-4, 11
#: Passes over a slice of texts before a task goes on to its next one, and labelled texts that a task trains on.
PASSES, TASK_TEXTS = 2, 4096

PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}*%$&#-_|<>"))


@dataclass
class Filter:
    weights: np.ndarray  # width * SIZE by FILTERS
    bias: np.ndarray


@dataclass
class ToxicityModel:
    embedding: np.ndarray
    filters: list[Filter]
    out: np.ndarray
    bias: float
    thresholds: np.ndarray  # by language, the last for texts of none
    languages: language.LanguageModel


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words by 1 + prefixes), punctuation at its end cut, and where each text's words begin."""
    low = LOWER[data]
    words = split_words(low, offsets)
    ends = words.ends.copy()
    for _ in range(4):
        ends -= PUNCTUATION[low[ends - 1]] & (ends - 1 > words.starts)
    spans = [ends, *(np.minimum(words.starts + n, ends) for n in PREFIXES)]
    kinds = np.arange(len(spans), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = [(span_hashes(low, words.starts, e) ^ k) >> np.uint64(64 - HASH_BITS) for e, k in zip(spans, kinds, strict=True)]
    return np.stack(rows, axis=1).astype(np.int32), words.first


def _answers(embedded: np.ndarray, kind: Filter, width: int) -> np.ndarray:
    """Answers of the filters at each word; beyond the end of a text stand zeros. embedded: padded words by SIZE."""
    n = len(embedded) - width + 1
    out = embedded[:n] @ kind.weights[:SIZE]
    for step in range(1, width):
        out += embedded[step : step + n] @ kind.weights[step * SIZE : (step + 1) * SIZE]
    return out


def _padded(model_embedding: np.ndarray, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded words with zeros after each text, and the place of each word."""
    gap = max(WIDTHS) - 1
    place = np.arange(len(rows)) + np.repeat(np.arange(len(first) - 1) * gap, np.diff(first))
    embedded = np.zeros((len(rows) + gap * len(first), SIZE), np.float32)
    for k in range(rows.shape[1]):
        embedded[place] += model_embedding[rows[:, k]]
    return embedded, place


def pooled(embedding: np.ndarray, filters: list[Filter], rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Strongest answers of each text before the bias; texts without words get -inf."""
    embedded, place = _padded(embedding, rows, first)
    some = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    if len(some):
        for k, (width, kind) in enumerate(zip(WIDTHS, filters, strict=True)):
            out[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(_answers(embedded, kind, width)[place], first[some])
    return out


def logits(embedding: np.ndarray, filters: list[Filter], out: np.ndarray, bias: float | np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    strongest = pooled(embedding, filters, rows, first) + np.concatenate([x.bias for x in filters])
    return np.maximum(strongest, 0) @ out + bias


#: Shapes of the parameters after the embedding, which lie one after another in rows of SIZE numbers.
SHAPES = [x for w in WIDTHS for x in ((w * SIZE, FILTERS), (FILTERS,))] + [(len(WIDTHS) * FILTERS,), (1,)]
ROWS = (1 << HASH_BITS) + -(-sum(int(np.prod(x)) for x in SHAPES) // SIZE)


def _views(table: np.ndarray) -> tuple[np.ndarray, list[Filter], np.ndarray, np.ndarray]:
    """Embedding, filters, output weights and bias as views of a table of ROWS by SIZE."""
    flat, at, found = table.reshape(-1), SIZE << HASH_BITS, []
    for shape in SHAPES:
        n = int(np.prod(shape))
        found.append(flat[at : at + n].reshape(shape))
        at += n
    return table[: 1 << HASH_BITS], [Filter(*found[2 * k : 2 * k + 2]) for k in range(len(WIDTHS))], found[-2], found[-1]


def _start() -> tuple[np.ndarray, np.ndarray]:
    """Drawn parameters, and the sums of squared gradients before any."""
    draw = np.random.default_rng(SEED)
    table = np.zeros((ROWS, SIZE), np.float32)
    embedding, filters, out, _ = _views(table)
    embedding[:] = draw.normal(0, 0.1, embedding.shape)
    for kind in filters:
        kind.weights[:] = draw.normal(0, 0.3, kind.weights.shape)
    out[:] = draw.normal(0, 0.3, out.shape)
    return table, np.full_like(table, 1e-3)


def _descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, first: np.ndarray, toxic: np.ndarray, order: np.ndarray) -> None:
    """One pass over the texts in `order`, in batches; moves the parameters and the sums of squared gradients in place."""
    embedding, filters, out, bias = _views(table)
    past_embedding, past_filters, past_out, past_bias = _views(seen)

    def move(param: np.ndarray, past: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        gradient = gradient + DECAY * param[at]
        past[at] += gradient**2
        param[at] -= RATE * gradient / np.sqrt(past[at])

    for low in range(0, len(order), BATCH):
        own = order[low : low + BATCH]
        own_rows = np.concatenate([rows[first[d] : first[d + 1]] for d in own])
        own_first = np.concatenate([[0], np.cumsum(first[own + 1] - first[own])])
        embedded, place = _padded(embedding, own_rows, own_first)
        word_at = np.full(len(embedded), -1)
        word_at[place] = np.arange(len(own_rows))
        best, value = [], []
        for width, kind in zip(WIDTHS, filters, strict=True):
            answers = _answers(embedded, kind, width)[place]
            top = np.stack([answers[i:j].argmax(0) + i for i, j in zip(own_first[:-1], own_first[1:], strict=True)])
            best.append(place[top])
            value.append(np.take_along_axis(answers, top, 0) + kind.bias)
        hidden = np.maximum(np.concatenate(value, axis=1), 0)
        wrong = (1 / (1 + np.exp(-(hidden @ out + bias))) - toxic[own]) / len(own)
        back = wrong[:, None] * out * (hidden > 0)
        touched, change = [], []
        for k, (width, kind) in enumerate(zip(WIDTHS, filters, strict=True)):
            slope = back[:, k * FILTERS : (k + 1) * FILTERS]
            weights = np.zeros_like(kind.weights)
            for step in range(width):
                part = slice(step * SIZE, (step + 1) * SIZE)
                at = best[k] + step
                weights[part] = np.einsum("dfs,df->sf", embedded[at], slope)
                word = word_at[at]
                real = word >= 0
                touched.append(own_rows[word[real]])
                change.append((slope[:, :, None] * kind.weights[part].T)[real])
            move(kind.weights, past_filters[k].weights, weights)
            move(kind.bias, past_filters[k].bias, slope.sum(0))
        move(out, past_out, hidden.T @ wrong)
        move(bias, past_bias, wrong.sum(keepdims=True))
        row, by_row = np.concatenate(touched).ravel(), np.repeat(np.concatenate(change), own_rows.shape[1], axis=0)
        order_of_rows = np.argsort(row, kind="stable")
        changed, begin = np.unique(row[order_of_rows], return_index=True)
        if len(changed):
            move(embedding, past_embedding, np.add.reduceat(by_row[order_of_rows], begin), changed)


def _train(rows: np.ndarray, first: np.ndarray, toxic: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Parameters after EPOCHS passes over texts that are at hand."""
    table, seen = _start()
    draw = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        _descend(table, seen, rows, first, toxic, draw.permutation(texts))
    return table


#: Columns of a row's parameters and of its sums of squared gradients.
NAMES = [f"{kind}{i}" for kind in ("p", "s") for i in range(SIZE)]


def _weighed_means(moves: DataFrame) -> DataFrame:
    """Of what tasks made of a row (row, n, values), the mean by n, a column for each value.

    A task sends a row once, so sums on its side would save none: single numbers in an array travel, and are weighed where they meet.
    """
    weighed = lambda i: F.sum(F.get("values", i).cast("double") * F.col("n"))
    return moves.repartition("row").groupBy("row").agg(*((weighed(i) / F.sum("n")).cast("float").alias(x) for i, x in enumerate(NAMES)))


def _round(texts: DataFrame, table: np.ndarray, seen: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Every task goes over its own texts from the same parameters; a row becomes the mean of the tasks that moved it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, past, n = table.copy(), seen.copy(), 0
        draw = np.random.default_rng([SEED, number])
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            truth = batch.column("label").to_numpy()
            for low, high in slices(offsets):
                rows, first = word_rows(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                some = np.flatnonzero(np.diff(first))
                for _ in range(PASSES):
                    _descend(own, past, rows, first, truth[low:high], draw.permutation(some))
                n += len(some)
        moved = np.flatnonzero((own != table).any(1))
        if n:
            values = np.concatenate([own[moved], past[moved]], axis=1)
            lists = list_array(np.arange(len(moved) + 1) * values.shape[1], pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(moved), pa.array(np.full(len(moved), n)), lists], ["row", "n", "values"])

    mean = _weighed_means(texts.mapInArrow(work, "row long, n long, values array<float>")).toArrow()
    at = mean.column("row").to_numpy()
    values = np.stack([mean.column(x).to_numpy() for x in NAMES], axis=1) if len(at) else np.zeros((0, 2 * SIZE))
    table, seen = table.copy(), seen.copy()
    table[at], seen[at] = values[:, :SIZE], values[:, SIZE:]
    return table, seen


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """Two thirds up the widest of the gaps at which errors cost least; a clean text lost costs FALSE_ALARM times a toxic one missed."""
    order = np.argsort(scores, kind="stable")
    ranked, truth = scores[order], toxic[order]
    share = np.maximum([np.sum(truth == 0), np.sum(truth == 1)], 1)
    missed = np.concatenate([[0], np.cumsum(truth == 1)]) / share[1]
    wrong = 1 - np.concatenate([[0], np.cumsum(truth == 0)]) / share[0]
    edges = np.concatenate([[ranked[0] - 2], ranked, [ranked[-1] + 2]])
    errors = missed + FALSE_ALARM * wrong
    at = np.flatnonzero(errors == errors.min())
    at = at[np.argmax(edges[at + 1] - edges[at])]
    return float(edges[at] + 2 * edges[at + 1]) / 3


def fit(texts: list[str], toxic: list[int], languages: language.LanguageModel) -> ToxicityModel:
    """Train on most of the texts and set thresholds on the others. Without texts of both labels every score is 0.5 or under."""
    none = [Filter(np.zeros((w * SIZE, FILTERS), np.float32), np.zeros(FILTERS, np.float32)) for w in WIDTHS]
    n_languages = len(languages.languages)
    if len(set(toxic)) < 2:
        constant = np.full(n_languages + 1, 1.0)
        return ToxicityModel(np.zeros((1 << HASH_BITS, SIZE), np.float32), none, np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, constant, languages)
    truth = np.array(toxic)
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    parts = [word_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    rows, first = np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in parts]))])
    kept = np.arange(len(texts)) % round(1 / CALIBRATION) == 0
    some = np.diff(first) > 0
    embedding, filters, out, bias = _views(_train(rows, first, truth, np.flatnonzero(~kept & some)))
    found = np.concatenate([
        logits(embedding, filters, out, bias, rows[first[i] : first[min(i + 64, len(texts))]], first[i : i + 65] - first[i]) for i in range(0, len(texts), 64)
    ])
    own = _languages(languages, data, offsets)
    held = kept & some if len(set(truth[kept & some])) == 2 else some
    overall = best_threshold(found[held], truth[held])
    thresholds = np.full(n_languages + 1, overall)
    for k in range(n_languages):
        mine = held & (own == k)
        if truth[mine].sum() >= LEAST_POSITIVES and (truth[mine] == 0).sum() >= LEAST_POSITIVES:
            thresholds[k] = best_threshold(found[mine], truth[mine])
    return ToxicityModel(embedding, filters, out, float(bias[0]), thresholds, languages)


def best_thresholds(scored: DataFrame) -> dict[int, tuple[float, int, int]]:
    """`best_threshold` of every `part` of scored (part, margin, label), with its clean and toxic texts.

    Texts are counted by margin, and counts added up in order, so that no part is gathered anywhere.
    """
    counts = scored.groupBy("part", "margin").agg(F.count_if(F.col("label") == 1).alias("_t"), F.count_if(F.col("label") == 0).alias("_c"))
    seen = ordered_scan(counts, ["part"], ["margin"], [
        running_sum("_t", "toxic_to"), running_sum("_c", "clean_to"), total("_t", "toxic"), total("_c", "clean"), following("margin", "next"),
    ])
    cost = lambda toxic, clean: toxic / F.greatest("toxic", F.lit(1)) + FALSE_ALARM * (1 - clean / F.greatest("clean", F.lit(1)))
    low = (F.col("toxic_to") == F.col("_t")) & (F.col("clean_to") == F.col("_c"))
    gap = lambda a, b, c: F.struct(c.alias("cost"), (a - b).alias("narrow"), a.alias("a"), b.alias("b"))
    m = F.col("margin")
    own = gap(m, F.coalesce("next", m + 2), cost(F.col("toxic_to"), F.col("clean_to")))
    under = F.when(low, gap(m - 2, m, cost(F.lit(0), F.lit(0))))
    best = seen.groupBy("part").agg(F.least(F.min(own), F.min(under)).alias("g"), F.first("clean").alias("clean"), F.first("toxic").alias("toxic"))
    return {r["part"]: ((r["g"]["a"] + 2 * r["g"]["b"]) / 3, r["clean"], r["toxic"]) for r in best.collect()}


def _languages(model: language.LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The predicted language of each text by index; one past the last where none is known."""
    if not model.languages:
        return np.zeros(len(offsets) - 1, np.int64)
    found = [language.scores(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, rows=language.ROWS)]
    scores = np.concatenate(found)
    return np.where(scores.max(1) > 0, scores.argmax(1), len(model.languages))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted (1 from score 0.5) of every row.

    A null or empty text scores what no answer of any filter gives. Repeated rows and null ids are rows like any other; no
    rows give no rows.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in slices(offsets, rows=language.ROWS):
            own, begins = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            margin = logits(model.embedding, model.filters, model.out, model.bias, *word_rows(own, begins)) - model.thresholds[_languages(model.languages, own, begins)]
            chance = 1 / (1 + np.exp(-margin.astype(np.float64)))
            yield {"doc_id": batch.column("doc_id")[low:high], "score": pa.array(chance), "predicted": pa.array((chance >= 0.5).astype(np.int32))}

    return map_batches(text_of(documents), work, "doc_id long, score double, predicted int")


def _margins(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """kept, label, part (predicted language) and margin of every text with words."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in slices(offsets, rows=language.ROWS):
            own, begins = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            rows, first = word_rows(own, begins)
            some = np.flatnonzero(np.diff(first))
            margin = logits(model.embedding, model.filters, model.out, model.bias, rows, first).astype(np.float64)
            yield {
                "kept": batch.column("kept")[low:high].take(pa.array(some)), "label": batch.column("label")[low:high].take(pa.array(some)),
                "part": pa.array(_languages(model.languages, own, begins)[some].astype(np.int32)), "margin": pa.array(margin[some]),
            }

    return map_batches(texts, work, "kept boolean, label int, part int, margin double")


def train(documents: DataFrame, labels: DataFrame, learn: Column) -> ToxicityModel:
    """Fit on all labelled documents that `learn` admits; their languages, where given, train the predictor of languages."""
    languages = language.fit(*language.training_sample(documents, learn))
    scratch = Scratch(documents.sparkSession)
    kept = F.pmod(F.xxhash64("doc_id"), F.lit(round(1 / CALIBRATION))) == 0
    texts = scratch.table(every_labelled(documents.where(learn), labels, "toxic", TASK_TEXTS).withColumn("kept", kept), "toxicity-texts")
    if texts.select("label").distinct().count() < 2:
        scratch.drop()
        return fit([], [], languages)
    table, seen = _start()
    for number in range(EPOCHS // PASSES):
        table, seen = _round(texts.where(~F.col("kept")), table, seen, number)
    embedding, filters, out, bias = _views(table)
    model = ToxicityModel(embedding, filters, out, float(bias[0]), np.zeros(len(languages.languages) + 1), languages)
    scored = scratch.table(_margins(texts, model), "toxicity-margins")
    if scored.where("kept").select("label").distinct().count() == 2:
        scored = scored.where("kept")
    found = best_thresholds(scored.select(F.explode(F.array(F.col("part"), F.lit(-1))).alias("part"), "margin", "label"))
    scratch.drop()
    overall = found.pop(-1, (1.0, 0, 0))[0]
    model.thresholds[:] = overall
    for k, (threshold, clean, toxic) in found.items():
        if k < len(languages.languages) and min(clean, toxic) >= LEAST_POSITIVES:
            model.thresholds[k] = threshold
    return model
