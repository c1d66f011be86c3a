import hashlib
import random

import numpy as np
import pyarrow as pa

from permaway.llm import neardup, quality, substrings
from permaway.llm.words import block_hashes, split_words, text_bytes


def mirrored(bits=10):
    """Two words of 1,024 letters, a and b in the order of Thue and Morse, and the same with a and b exchanged."""
    order = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[x] for x in order), "".join("ba"[x] for x in order)


def test_hash_depends_on_the_bytes_of_the_span_only():
    pick = random.Random(2)
    spans = [bytes(pick.choice(b"ab\x00") for _ in range(pick.randint(0, 20))) for _ in range(3000)]
    data = b"".join(pick.choice([b"", b"x", b"yz"]) + s for s in spans)
    at, starts = 0, []
    for s in spans:
        at = data.index(s, at)
        starts.append(at)
        at += len(s)
    starts = np.array(starts)
    got = block_hashes(np.frombuffer(data, np.uint8), starts, starts + [len(s) for s in spans])
    by_span = {}
    for s, h in zip(spans, got.tolist()):
        assert by_span.setdefault(s, h) == h
    assert len(set(by_span.values())) == len(by_span)
    assert len(block_hashes(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def test_mirrored_words_differ(spark):
    for bits in (10, 11, 12):
        words = split_words(*text_bytes(pa.array([" ".join(mirrored(bits))])))
        assert len(set(words.hashes().tolist())) == 2
    one, other = ("\n".join([w] + [f"{w}{i}" for i in range(60)]) for w in mirrored())
    df = spark.createDataFrame([(1, one), (2, other), (3, "\n".join(mirrored()))], "doc_id long, text string")
    assert {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()} == {i: (i, True) for i in (1, 2, 3)}
    assert all(r.n_removed == 0 for r in substrings.repeated_substrings(df).collect())
    assert {r.doc_id: r.n_dup_lines for r in quality.judge(df, quality.fit([], [])).collect()} == {1: 0, 2: 0, 3: 0}


def test_levels_double():
    assert substrings.levels(50) == [13, 25, 50]
    assert substrings.levels(200) == [13, 25, 50, 100, 200]
    assert substrings.levels(10) == [10] and substrings.levels(10, 2) == [2, 3, 5, 10] and substrings.levels(1) == [1]


def test_long_texts_and_every_level(spark):
    """A text of 200,000 words that shares one passage with a short one, and levels from two words up."""
    pick = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(f"w{pick.randrange(50_000)}" for _ in range(100_000))
    rows = [(1, f"{long} {passage} {long[::-1]}"), (2, f"a b {passage} c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (2, 12, 50):
        got = {r.doc_id: r for r in substrings.repeated_substrings(df, least=least).collect()}
        assert (got[1].n_removed, got[2].n_removed, got[2].kept_text) == (0, 70, "a b c d")
        assert bytes(got[1].words_sha256) == hashlib.sha256(rows[0][1].encode()).digest()
