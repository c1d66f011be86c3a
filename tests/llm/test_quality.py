import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from permaway.llm import quality
from permaway.llm.queries import QUERIES
from permaway.llm.words import text_bytes


def counts(text):
    """The base counts by plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(fives), set()
    for i, five in enumerate(fives):
        if often[five] > 1:
            covered |= set(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered), failed


def texts():
    pick = random.Random(7)
    out = [None, "", "\n", "\n\n a", "a b c d e f a b c d e f", "x " * 40, "é漢 #* <|>\n" * 5, "a\n\na\n \na", "\x0b\x0c\r z", "w\x1f v"]
    chars = ["a", "b", "é", "漢", " ", " ", "\n", "#", "%", ".", "!", "A", "7", "\t"]
    return out + ["".join(pick.choice(chars) for _ in range(pick.randint(0, 150))) for _ in range(300)]


def test_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "a b", 2), (3, "c d", 3), (3, "c d", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = quality.judge(df, quality.fit([], [])).collect()
    key = lambda r: (r[0], *counts(r[1]))
    assert sorted((tuple(r)[:6] + (r.base_failed,) for r in got), key=str) == sorted(map(key, rows), key=str)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(df.limit(0), quality.fit([], [])).count() == 0


@pytest.mark.parametrize("long", [quality.LONG, 3])
def test_viterbi_finds_the_best_path(monkeypatch, long):
    monkeypatch.setattr(quality, "LONG", long)
    draw = np.random.default_rng(4)
    field = quality.Field(np.zeros(1), draw.normal(size=(2, 2)), draw.normal(size=2))
    sizes = [0, 1, 7, 3, 0, 5, 9, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission = draw.normal(size=first[-1])
    got = quality.viterbi(field, emission, first)

    def score(path, own):
        return field.start[path[0]] + sum(own[i] * p for i, p in enumerate(path)) + sum(field.transition[a, b] for a, b in itertools.pairwise(path))

    for i, j in itertools.pairwise(first):
        if j > i:
            best = max(itertools.product((0, 1), repeat=int(j - i)), key=lambda p: score(p, emission[i:j]))
            assert tuple(got[i:j]) == best


def test_training_separates():
    good = ["Some words make a line here today.\nAnother line of plain words follows it." for _ in range(20)]
    bad = ["BUY!! NOW!! HERE!! ALL!! DAY!!\n### $$$ ### $$$" for _ in range(20)]
    field = quality.fit(good + bad, [False] * 20 + [True] * 20)
    lines = quality.measure(*text_bytes(pa.array(good[:1] + bad[:1])))[1]
    assert quality.content_words(field, lines).tolist() == [lines.words[:2].sum(), 0]


def sampled(spark):
    """A field fitted on half of the labelled texts, and the texts of the other half by label."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").where("quality IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").collect()
    good, bad = ([r.text for r in rows if r.quality == q and len(r.text) < 5000] for q in (1, 0))
    train = good[0:400:2] + bad[0:400:2]
    field = quality.fit(train, [False] * len(good[0:400:2]) + [True] * len(bad[0:400:2]))
    return field, good[1:400:2], bad[1:400:2]


def line_labels(field, texts):
    lines = quality.measure(*text_bytes(pa.array(texts, pa.string())))[1]
    return quality.viterbi(field, lines.features @ field.emission, lines.first), lines


def test_lines_are_labelled(spark):
    field, good, bad = sampled(spark)
    pick, planted, known = random.Random(8), [], []
    for text in good:
        lines = text.split("\n")
        words = [w for w in re.findall(r"[^\W\d_]+", text)] or ["word"]
        mark = [False] * len(lines)
        for make in (" | ".join, lambda w: " ".join(x + pick.choice(["###", "$$$", "%%%"]) for x in w), lambda w: " ".join(x.upper() + "!!" for x in w)):
            at = pick.randint(0, len(lines))
            lines.insert(at, make([pick.choice(words) for _ in range(pick.randint(8, 20))]))
            mark.insert(at, True)
        planted.append("\n".join(lines))
        known += mark
    label, known = line_labels(field, planted)[0] == quality.BOILERPLATE, np.array(known)
    assert label[known].mean() >= 0.9  # planted lines are found
    assert label[~known].mean() <= 0.05  # the lines around them stay content
    label, lines = line_labels(field, bad)
    mixed = [0 < label[i:j].mean() < 1 for i, j in itertools.pairwise(lines.first) if j - i > 1]
    assert np.mean(mixed) >= 0.2  # bad texts hold lines of both kinds


def test_verdict_by_plain_loops(spark):
    field, good, bad = sampled(spark)
    docs = [*good[:40], *bad[:40], None, "", "a\n" * 30, good[0] + "\n" + bad[0]]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), field).collect()}
    for i, text in enumerate(docs):
        lines = quality.measure(*text_bytes(pa.array([text or ""])))[1]
        emission, best = lines.features @ field.emission, [(0.0, [])]
        for t, e in enumerate(emission):
            step = lambda a, b, path: field.transition[a, b] if path else field.start[b]
            best = [max(((s + step(p[-1] if p else 0, b, p) + e * b, [*p, b]) for s, p in best), key=lambda x: x[0]) for b in (0, 1)]
        path = max(best, key=lambda x: x[0])[1]
        content = sum(len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line, b in zip((text or "").split("\n"), path, strict=True) if b == 0)
        n, failed = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), counts(text)[5]
        assert (got[i].content_words, got[i].kept) == (content, not failed and content >= field.share * n)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op4_line_field_quality"](spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: counts(t) for i, t in rows.items()}
    judged = [(r.kept, good[r.doc_id]) for r in got if r.doc_id in good and not r.base_failed]
    assert sum(k for k, g in judged if g) >= 0.99 * sum(g for _, g in judged)
    assert sum(k for k, g in judged if not g) <= 0.1 * sum(not g for _, g in judged)
