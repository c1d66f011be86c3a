import random
import re

import public_tokenizers
import pytest

from permaway.llm import wordpiece
from permaway.llm.queries import QUERIES


def greedy(word, vocabulary, longest):
    """Pieces of a word by plain longest match, or None."""
    at, n = 0, 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), None)
        if size is None:
            return None
        at, n = at + size, n + 1
    return n


def brute_force(text, vocabulary, marker):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    longest = max(map(len, vocabulary), default=0)
    counts = [greedy(marker + w, vocabulary, longest) for w in words]
    return len(words), sum(1 if c is None else c for c in counts), sum(c is None for c in counts)


@pytest.mark.parametrize("seed", range(30))
def test_random_vocabularies(seed):
    pick = random.Random(seed)
    vocabulary = {"".join(pick.choice("abcé") for _ in range(pick.randint(1, 6))) for _ in range(pick.randint(0, 25))}
    words = ["".join(pick.choice("abcé") for _ in range(pick.randint(0, 15))) for _ in range(200)]
    want = [greedy(w, vocabulary, 6) for w in words]
    got = wordpiece.Automaton(x.encode() for x in sorted(vocabulary)).counts([w.encode() for w in words])
    assert got == [wordpiece.UNKNOWN + 1 if c is None else c for c in want]


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "ab c"), (3, "ab ab\x0bz"), (3, "ab ab\x0bz"), (4, "ab" * 30000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_words int")
    got = sorted(map(tuple, wordpiece.count_tokens(df, ["_a", "b", "_c", "a"], "_").collect()), key=str)
    assert got == sorted([(i, *brute_force(t, {"_a", "b", "_c", "a"}, "_")) for i, t in rows], key=str)
    assert wordpiece.count_tokens(df.limit(0), ["a"]).count() == 0
    assert [r.n_unknown for r in wordpiece.count_tokens(df.where("doc_id = 3"), []).collect()] == [3, 3]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    vocabulary = set(wordpiece.sentence_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    want = sorted((r.doc_id, *brute_force(r.text, vocabulary, "▁")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op9_longest_match_counts"](spark, folder).collect())) == want
