"""Quality rules and line sequence labelling by a linear-chain conditional random field.

Plain counts of each text decide first. Of the others, Viterbi decoding labels each line as content or boilerplate by
features of the line and the label of the line before; a text stays if content lines hold enough of its words. The field is
trained on a bounded sample of labelled texts. Labels of lines are not given: lines of good texts are content, those of bad
ones hidden, one of them boilerplate at least. They start from what each line's features alone say, and the field is fitted
again to the labels that it decodes itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm.samples import labelled
from permaway.llm.store import text_column, text_of
from permaway.llm.words import SPACE, Words, block_hashes, grams, mix, slices, split_words, text_bytes

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(ord("A"), ord("Z") + 1)))
LETTER = UPPER | np.isin(np.arange(256), list(range(ord("a"), ord("z") + 1))) | (np.arange(256) >= 0x80)
DIGIT = np.isin(np.arange(256), list(range(ord("0"), ord("9") + 1)))
LOUD = np.isin(np.arange(256), list(b"!?"))
STOP = np.isin(np.arange(256), list(b".!?:;"))

#: Bounds of the training sample: texts of each label, bytes and lines of a text. Others are not learned from.
SAMPLE, SAMPLE_BYTES, SAMPLE_LINES = 600, 20_000, 200
ROUNDS, RATE, DECAY = 500, 0.1, 1e-4
#: Decay of the transitions: whole texts of one label overstate how seldom labels change, so the features of a line should say more.
CHAIN_DECAY = 0.005
#: How often the lines of bad texts are labelled anew, and the steps after each time.
RELABELS, LATER_ROUNDS = 3, 40
#: Texts of more lines are decoded line by line, others side by side.
LONG = 2000
#: Share of the words in content lines from which a text stays, if the sample does not tell, and bounds of the share that it tells.
CONTENT_SHARE, LEAST_SHARE, MOST_SHARE = 0.5, 0.25, 0.85

CONTENT, BOILERPLATE = 0, 1
#: Places of features: symbols, exclamation marks and capitals; repeated lines and words.
LOOKS, REPEATS = [5, 6, 7, 8, 10], [13, 14, 15, 16, 17]


@dataclass
class Lines:
    """Lines of a slice of texts; first[d] is the index of text d's first line, first[-1] the count of all."""

    first: np.ndarray
    words: np.ndarray  # words in each line
    features: np.ndarray  # lines by features, 0 or 1


@dataclass
class Field:
    """Weights of the conditional random field; a positive emission speaks for boilerplate."""

    emission: np.ndarray
    transition: np.ndarray  # from label by to label
    start: np.ndarray
    share: float = CONTENT_SHARE  # of the words in content lines, from which a text stays


def _counter(data: np.ndarray, of: np.ndarray):
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(of[data], out=total[1:])
    return lambda starts, ends: total[ends] - total[starts]


def repeated_words(hashes: np.ndarray, words: Words) -> np.ndarray:
    """Which words lie in a five-word window that its text has twice or more."""
    five, text, place = grams(hashes, words.first, 5)
    keys = five ^ mix(text.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    edges = np.zeros(len(hashes) + 1, np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = place[twice[at] == keys]
        edges[hit] += 1
        edges[hit + 5] -= 1
    return np.cumsum(edges)[:-1] > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], Lines]:
    """Counts of each text, and its lines."""
    words = split_words(data, offsets)
    hashes = words.hashes()
    repeated = repeated_words(hashes, words)
    breaks = np.flatnonzero(data == 0x0A)
    text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(text_of_break, minlength=len(offsets) - 1) + 1)])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    word_first, word_last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    n_words = word_last - word_first

    keys = block_hashes(data, starts, ends) ^ mix(text.astype(np.uint64) + np.uint64(1))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    again &= n_words > 0

    inside = _counter(data, ~SPACE)(starts, ends)
    letters, upper = _counter(data, LETTER)(starts, ends), _counter(data, UPPER)(starts, ends)
    symbols, loud, digits = (_counter(data, x)(starts, ends) for x in (SYMBOLS, LOUD, DIGIT))
    points = _counter(data, ~SPACE & ((np.arange(256) & 0xC0) != 0x80))(offsets[:-1], offsets[1:])
    in_repeat = np.concatenate([[0], np.cumsum(repeated)])
    same = np.concatenate([[0, 0], np.cumsum(hashes[1:] == hashes[:-1])])[: len(hashes) + 1]
    some = np.maximum(n_words, 1)
    last = np.where(word_last > word_first, data[np.minimum(words.ends[np.maximum(word_last - 1, 0)] - 1, len(data) - 1)] if len(words.ends) else 0, 0)
    place = np.arange(len(starts)) - first[text]
    repeat_share = (in_repeat[word_last] - in_repeat[word_first]) / some
    same_share = (same[word_last] - same[np.minimum(word_first + 1, len(hashes))]) / some if len(hashes) else np.zeros(len(starts))
    features = np.stack([
        np.ones(len(starts), bool), n_words == 0, (n_words > 0) & (n_words < 4), n_words > 30, letters < 0.6 * inside,
        symbols > 0, symbols > 0.03 * inside, symbols > 0.1 * inside, loud > 0.05 * inside, digits > 0.1 * inside, upper > 0.5 * np.maximum(letters, 1),
        inside > 12 * some, ~STOP[last.astype(np.uint8)] & (n_words > 0), again, repeat_share > 0.2, repeat_share > 0.6, same_share > 0.1, same_share > 0.4, place == 0,
    ], axis=1).astype(np.float64)
    per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    counts = {
        "n_words": words.counts(), "word_chars": points, "n_symbols": per_text(symbols), "n_dup_lines": per_text(again),
        "n_repeat_words": np.diff(in_repeat[words.first]),
    }
    return counts, Lines(first, n_words, features)


@dataclass
class Sample:
    """Lines of the texts of a sample, side by side."""

    x: np.ndarray  # texts by lines by features
    there: np.ndarray  # which lines there are
    length: np.ndarray
    weight: np.ndarray  # of a line of each text


def _steps(params: np.ndarray, rounds: int, gradient: Callable[[np.ndarray], np.ndarray], decay: np.ndarray | float = DECAY) -> np.ndarray:
    """Steps along the gradient, with decay, each weight at its own pace."""
    first_moment, second_moment = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        uphill = gradient(params) - decay * params
        first_moment, second_moment = 0.9 * first_moment + 0.1 * uphill, 0.99 * second_moment + 0.01 * uphill**2
        params = params + RATE * first_moment / (1 - 0.9**step) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    return params


def _line_gradient(sample: Sample, bad: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of the likelihood of the texts' labels at each line alone, by the weights of its features."""
    x = sample.x[sample.there]
    text = np.nonzero(sample.there)[0]
    label, weight = bad[text], sample.weight[text] / len(bad)
    return lambda emission: (weight * (label - 1 / (1 + np.exp(-x @ emission)))) @ x


def _chain_gradient(sample: Sample, label: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of the likelihood of the lines' labels, by forward and backward sums."""
    x, there, length, weight = sample.x, sample.there, sample.length, sample.weight
    n, most, n_features = x.shape
    true = (label[:, :, None] == np.arange(2)) & there[:, :, None]
    true_pair = (true[:, :-1, :, None] & true[:, 1:, None, :]).astype(float)

    def gradient(params: np.ndarray) -> np.ndarray:
        field = _field(params)
        score = np.zeros((n, most, 2))
        score[:, :, 1] = x @ field.emission
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = score[:, 0] + field.start
        for t in range(1, most):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + field.transition, axis=1) + score[:, t]
        for t in range(most - 2, -1, -1):
            after = np.logaddexp.reduce(field.transition + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], after, 0)
        total = np.logaddexp.reduce(forward[np.arange(n), length - 1], axis=1)
        single = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        pair = forward[:, :-1, :, None] + field.transition + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(pair) * there[:, 1:, None, None]
        return np.concatenate([
            np.einsum("n,nt,ntf->f", weight, true[:, :, 1] - single[:, :, 1], x),
            np.einsum("n,ntij->ij", weight, true_pair - pair).ravel(), weight @ (true[:, 0] - single[:, 0]),
        ]) / n

    return gradient


def _field(params: np.ndarray) -> Field:
    return Field(params[:-6], params[-6:-2].reshape(2, 2), params[-2:])


def _relabel(field: Field, sample: Sample, bad: np.ndarray) -> np.ndarray:
    """Labels of all lines: decoded in bad texts, of which the line with the strongest features is boilerplate anyway."""
    score = np.where(sample.there, sample.x @ field.emission, -np.inf)
    label = np.zeros(score.shape, int)
    label[sample.there] = viterbi(field, score[sample.there], np.concatenate([[0], np.cumsum(sample.length)]))
    label[np.arange(len(bad)), score.argmax(axis=1)] = BOILERPLATE
    return label * bad[:, None]


def _least_share(share: np.ndarray, bad: np.ndarray) -> float:
    """The share that tells good texts from bad ones best, a lost good one as bad as three kept bad ones; the middle of equals."""
    cuts = np.linspace(LEAST_SHARE, MOST_SHARE, 61)
    lost = np.array([3 * np.mean(share[~bad] < c) + np.mean(share[bad] >= c) for c in cuts])
    best = cuts[lost <= lost.min() + 1e-12]
    return float(best[len(best) // 2])


def fit(texts: list[str], bad: list[bool]) -> Field:
    """Hard expectation maximisation of the field on texts that are good or bad as a whole; of both kinds there should be some."""
    n_features = measure(np.zeros(0, np.uint8), np.zeros(2, np.int64))[1].features.shape[1]
    if not texts:
        return Field(np.zeros(n_features), np.zeros((2, 2)), np.zeros(2))
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    parts = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1] for i, j in slices(offsets)]
    length = np.concatenate([np.diff(x.first) for x in parts])
    there = np.arange(int(length.max())) < length[:, None]
    x = np.zeros((*there.shape, n_features))
    x[there] = np.concatenate([p.features for p in parts])
    # Lines that look like boilerplate are learned from without their repetitions, so that either reason suffices alone.
    x[..., REPEATS] *= ~x[..., LOOKS].any(axis=2, keepdims=True)
    # A text counts by its words as much as another of its label; both labels have the same weight in all.
    bad = np.array(bad, bool)
    weight = (len(texts) / 2 / np.maximum(np.bincount(bad, minlength=2), 1))[bad.astype(int)] / length
    sample = Sample(x, there, length, weight)
    params = np.concatenate([_steps(np.zeros(n_features), ROUNDS, _line_gradient(sample, bad)), np.zeros(6)])
    decay = np.repeat([DECAY, CHAIN_DECAY], [n_features, 6])
    for _ in range(RELABELS):
        params = _steps(params, LATER_ROUNDS, _chain_gradient(sample, _relabel(_field(params), sample, bad)), decay)
    field = _field(params)
    words = np.concatenate([np.diff(np.concatenate([[0], np.cumsum(p.words)])[p.first]) for p in parts])
    share = np.concatenate([content_words(field, p) for p in parts]) / np.maximum(words, 1)
    if bad.any() and not bad.all():
        field.share = _least_share(share, bad)
    return field


def viterbi(field: Field, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label sequence of each text, given what each line adds for boilerplate; of equals, content."""
    length = np.diff(first)
    labels = np.zeros(len(emission), np.int8)
    order = np.argsort(-length, kind="stable")
    for d in order[length[order] > LONG]:
        labels[first[d] : first[d + 1]] = _viterbi_long(field, emission[first[d] : first[d + 1]].tolist())
    order = order[(length[order] <= LONG) & (length[order] > 0)]
    if not len(order):
        return labels
    begin, size = first[order], length[order]
    came = np.zeros((len(emission), 2), np.int8)
    # How much better boilerplate is than content as the label of the last line seen.
    lead = field.start[1] - field.start[0] + emission[begin]
    leads = np.zeros(len(emission))
    leads[begin] = lead
    (cc, cb), (bc, bb) = field.transition
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, side="left"))  # texts with a line t
        at, lead = begin[:n] + t, lead[:n]
        came[at, 0], came[at, 1] = lead + bc > cc, lead + bb > cb
        lead = np.maximum(cb, lead + bb) - np.maximum(cc, lead + bc) + emission[at]
        leads[at] = lead
    state = np.zeros(len(order), np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        at = begin[:n] + t
        last = size[:n] == t + 1
        state[:n] = np.where(last, leads[at] > 0, state[:n])
        labels[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return labels


def _viterbi_long(field: Field, emission: list[float]) -> list[int]:
    (cc, cb), (bc, bb) = field.transition.tolist()
    lead, came = float(field.start[1] - field.start[0]) + emission[0], []
    for x in emission[1:]:
        came.append((lead + bc > cc, lead + bb > cb))
        lead = max(cb, lead + bb) - max(cc, lead + bc) + x
    out = [int(lead > 0)]
    for step in reversed(came):
        out.append(int(step[out[-1]]))
    return out[::-1]


def content_words(field: Field, lines: Lines) -> np.ndarray:
    """Words of each text in lines that are labelled as content."""
    labels = viterbi(field, lines.features @ field.emission, lines.first)
    return np.diff(np.concatenate([[0], np.cumsum(lines.words * (labels == CONTENT))])[lines.first])


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field:
    """Fit on at most `most` texts of each value of `quality`, picked by the hash of the id."""
    short = (F.octet_length("text") <= SAMPLE_BYTES) & (F.size(F.split("text", "\n")) <= SAMPLE_LINES)
    picked = labelled(documents, labels, "quality", most, short)
    return fit([r["text"] for r in picked], [r["label"] == 0 for r in picked])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdict(text: Column, field: Field) -> Column:
    """A struct of the counts of a text and content_words, its words in content lines."""

    def work(texts: pa.Array) -> Iterator[dict]:
        data, offsets = text_bytes(texts)
        for low, high in slices(offsets):
            counts, lines = measure(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            yield {**{k: pa.array(counts[k], pa.int64()) for k in COUNTS}, "content_words": pa.array(content_words(field, lines), pa.int64())}

    return text_column(work, ", ".join(f"{x} long" for x in (*COUNTS, "content_words")))(text)


def failed(found: str) -> Column:
    """Whether the counts in the struct column fail."""
    return (F.col(f"{found}.n_words") < 10) | (100 * F.col(f"{found}.n_repeat_words") > 20 * F.col(f"{found}.n_words"))


def kept(found: str, field: Field) -> Column:
    """Whether a text stays by the struct column of its verdict."""
    return ~failed(found) & (F.col(f"{found}.content_words") >= field.share * F.col(f"{found}.n_words"))


def judge(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words and kept of every row.

    base_failed: fewer than 10 words, or over 20 % of them in repeated five-word windows. Others are kept if content lines
    hold the field's share of the words. A null or empty text has no words and fails. Repeated rows and null ids are rows like
    any other; no rows give no rows.
    """
    found = text_of(documents).select("doc_id", verdict(F.col("text"), field).alias("found"))
    return found.select("doc_id", *(f"found.{x}" for x in COUNTS), failed("found").alias("base_failed"), "found.content_words", kept("found", field).alias("kept"))
