import random
import re

import numpy as np

from permaway.llm import neardup
from permaway.llm.queries import QUERIES
from permaway.llm.store import Scratch


def brute_force(rows, percent=85, size=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and None not in (rows[i][0], rows[j][0]) and 100 * len(x & y) >= percent * len(x | y):
                top[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[k][0] for k in range(len(rows)) if find(k) == find(i))
        out.append((d, len(sets[i]), c, d is None or c == d))
    return sorted(out, key=str)


def test_random_texts(spark):
    pick = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f"), (9, "a B c d e f"), (8, "x y"), (7, "X y"), (7, "q r"), (7, "X y")]
    base = [[f"w{pick.randint(0, 10**6)}" for _ in range(n)] for n in (6, 12, 60, 200)]
    for i in range(250):
        w = list(pick.choice(base))
        for _ in range(pick.randint(0, 4)):
            w[pick.randrange(len(w))] = f"v{pick.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, chunk int")
    got = neardup.near_duplicates(df, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute_force(rows)


def test_small_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 2000)
    test_random_texts(spark)


def test_chain_becomes_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 70)], "node long, low long")
    got = {r.node: r.label for r in neardup.components(links, Scratch(spark)).collect()}
    assert got == {**{i + 1: 0 for i in range(50)}, 100: 70}


def test_pruning_keeps_similar_pairs():
    needed = neardup.least_matches(85)
    agree = np.random.default_rng(0).random((20000, neardup.VALUES)) < 0.85
    sums = agree.cumsum(1)[:, neardup.BATCH - 1 :: neardup.BATCH]
    assert (sums >= needed).all()
    assert needed[-1] > 0.6 * neardup.VALUES


def test_no_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op6_near_duplicates"](spark, folder).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute_force(rows)
