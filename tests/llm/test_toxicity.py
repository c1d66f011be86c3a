import random
import zlib

import numpy as np
import pyarrow as pa

from permaway.llm import language, toxicity
from permaway.llm.queries import QUERIES
from permaway.llm.samples import every_labelled
from permaway.llm.words import text_bytes

NO_LANGUAGE = language.fit([], [])


def made_texts(n, seed):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    toxic = [i % 2 for i in range(n)]
    texts = []
    for t in toxic:
        w = [pick.choice(words) for _ in range(pick.randint(20, 60))]
        for _ in range(2 * t):
            w[pick.randrange(len(w))] = pick.choice(["nastyone", "Nastytwo,", "vilest!"])
        texts.append(" ".join(w))
    return texts, toxic


def test_pooling_is_that_of_plain_loops():
    draw = np.random.default_rng(0)
    embedding = draw.normal(size=(1 << toxicity.HASH_BITS, toxicity.SIZE)).astype(np.float32)
    filters = [toxicity.Filter(draw.normal(size=(w * toxicity.SIZE, toxicity.FILTERS)).astype(np.float32), np.zeros(toxicity.FILTERS)) for w in toxicity.WIDTHS]
    rows, first = toxicity.word_rows(*text_bytes(pa.array(["a b c", "", "one", "d e d e f g", " "])))
    got = toxicity.pooled(embedding, filters, rows, first)
    for d in range(5):
        own = embedding[rows[first[d] : first[d + 1]]].sum(1)
        if not len(own):
            assert np.isneginf(got[d]).all()
            continue
        padded = np.concatenate([own, np.zeros((2, toxicity.SIZE))])
        want = [max(padded[i : i + w].ravel() @ f.weights[:, k] for i in range(len(own))) for w, f in zip(toxicity.WIDTHS, filters) for k in range(toxicity.FILTERS)]
        assert np.allclose(got[d], want, atol=1e-4)


def test_punctuation_and_case_do_not_count():
    rows, _ = toxicity.word_rows(*text_bytes(pa.array(["Word, WORD*** word ... ."])))
    assert (rows[0] == rows[1]).all() and (rows[1] == rows[2]).all() and len(rows) == 5


def test_learned_words_are_found(spark):
    model = toxicity.fit(*made_texts(400, 1), NO_LANGUAGE)
    texts, toxic = made_texts(200, 1)
    fresh = [f"{'plain words go here ' * 50}", f"{'plain words go here ' * 50} nastyone {'and on ' * 90} vilest"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, *fresh])], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert sum(got[i].predicted == t for i, t in enumerate(toxic)) >= 190
    assert got[200].predicted == 0 and got[201].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a"), (4, "b " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for model in (toxicity.fit([], [], NO_LANGUAGE), toxicity.fit(*made_texts(60, 2), NO_LANGUAGE)):
        got = toxicity.score(df, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(df.limit(0), model).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(df, toxicity.fit(["a"], [1], NO_LANGUAGE)).collect())


def test_threshold():
    assert toxicity.best_threshold(np.array([0.0, 1, 2, 6, 7]), np.array([0, 0, 0, 1, 1])) == 14 / 3
    assert toxicity.best_threshold(np.array([0.0, 1, 2, 3]), np.array([0, 1, 0, 1])) == 8 / 3


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op5_convolutional_toxicity"](spark, folder).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    high = [s for s, t in held if t]
    low = [s for s, t in held if not t]
    assert np.mean([[(a > b) + (a == b) / 2 for b in low] for a in high]) > 0.7


def test_every_labelled_text_is_learned_from(spark):
    texts, toxic = made_texts(800, 5)
    texts[0] = f"{'plain words go here ' * 6000} rarestone"  # a long text counts like any other
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(3, 1), (None, 1), (900, 1), (4, None)], "doc_id long, toxic int")
    got = {r.doc_id: (r.text, r.label) for r in every_labelled(docs, labels, "toxic", 64).collect()}
    assert got == {i: (texts[i], toxic[i]) for i in range(800)}
    model = toxicity.train(docs, labels, toxicity.F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert np.mean([found[i] == toxic[i] for i in range(800) if i % 5 == 0]) > 0.9


def test_thresholds_are_those_of_the_sorted_scores(spark):
    pick = random.Random(2)
    rows = [(k, pick.gauss(t, 0.8), t) for k in range(3) for t in (0, 1) for _ in range(150)]
    got = toxicity.best_thresholds(spark.createDataFrame(rows, "part int, margin double, label int"))
    for k in range(3):
        own = [(m, t) for p, m, t in rows if p == k]
        want = toxicity.best_threshold(np.array([m for m, _ in own]), np.array([t for _, t in own]))
        assert abs(got[k][0] - want) < 1e-9 and got[k][1:] == (150, 150)


def test_rows_meet_as_single_numbers_and_are_weighed(spark):
    draw = np.random.default_rng(5)
    values = draw.normal(size=(3, 2 * toxicity.SIZE)).astype(np.float32)
    moves = [(7, 3, values[0].tolist()), (7, 5, values[1].tolist()), (9, 2, values[2].tolist())]
    out = toxicity._weighed_means(spark.createDataFrame(moves, "row long, n long, values array<float>"))
    # One shuffle, and no sums in doubles before it.
    above, _, below = out._jdf.queryExecution().executedPlan().toString().partition("Exchange")
    assert "HashAggregate" in above and "Aggregate" not in below and "Exchange" not in below
    got = {r["row"]: np.array(r[1:]) for r in out.collect()}
    wide = values.astype(np.float64)
    assert np.array_equal(got[7], ((wide[0] * 3 + wide[1] * 5) / 8).astype(np.float32))
    assert np.array_equal(got[9], values[2])
