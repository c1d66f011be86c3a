import hashlib
import random
import re

from permaway.llm import substrings
from permaway.llm.queries import QUERIES


def brute_force(rows, length):
    """(n_words, n_removed, sha of what is kept) of each row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[s : s + length])
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        keep = [True] * len(w)
        for s in range(len(w) - length + 1):
            if i is not None and least[tuple(w[s : s + length])] < i:
                keep[s : s + length] = [False] * length
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def sha(r):
    return hashlib.sha256(r.kept_text.encode()).hexdigest() if r.kept_text is not None else bytes(r.words_sha256).hex()


def test_random_texts(spark):
    pick = random.Random(5)
    parts = [[pick.choice("abcdé") for _ in range(n)] for n in (3, 8, 12, 20, 40)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, " ".join(parts[4])), (4, "a " * 60), (5, "a " * 30), (7, "x\x1fy " * 9), (7, "x\x1fy " * 9), (7, "q")]
    for i in range(60):
        w = []
        while len(w) < pick.choice([5, 20, 70]):
            w += pick.choice([pick.choice(parts), [pick.choice("pqrstuvw") for _ in range(pick.randint(1, 15))]])
        rows.append((pick.randint(10, 90), pick.choice([" ", "\n ", "\t"]).join(w)))
    df = spark.createDataFrame([(i, t, 3, "t") for i, t in rows], "doc_id long, text string, n_words int, window string")
    for length, least in ((1, 12), (2, 12), (7, 12), (10, 12), (10, 2)):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, sha(r)) for r in substrings.repeated_substrings(df, length, least).collect()), key=str)
        assert got == brute_force(rows, length)


def test_no_rows(spark):
    assert substrings.repeated_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op2_repeated_substrings"](spark, folder).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_force(rows, 50)
