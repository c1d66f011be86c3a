import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from permaway.llm import language
from permaway.llm.queries import QUERIES
from permaway.llm.samples import smallest_hashes
from permaway.llm.words import text_bytes

TEXTS = ["the cat and the dog", "der Hund und die Katze", "le chat et le chien", "the end of the day", "das Ende des Tages", "la fin du jour"]
LANGS = ["en", "de", "fr"] * 2


def buckets(text):
    """Presence buckets by plain slicing."""
    raw, out = "".join(c.lower() if c.isascii() else c for c in text).encode(), set()
    for k, n in enumerate(language.LENGTHS):
        for i in range(len(raw) - n + 1):
            value = int.from_bytes(raw[i : i + n], "little") * 0x9E3779B97F4A7C15 % (1 << 64)
            out.add((value >> 64 - language.BUCKET_BITS) + (k << language.BUCKET_BITS))
    return out


def test_presence():
    texts = [*TEXTS, "", "é", "ab", "A漢字 bcd"]
    bits = language.presence(*text_bytes(pa.array(texts)))
    for row, text in zip(bits, texts):
        assert set(np.flatnonzero(row).tolist()) == buckets(text)


def test_scores_are_those_of_the_kernel():
    """The folded matrix gives what landmarks and dual weights give."""
    model = language.fit(TEXTS, LANGS, landmarks=2)
    sets = [buckets(x) for x in TEXTS]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    y = np.array([[x == n for n in model.languages] for x in LANGS], float)
    order = [i for n in model.languages for i, x in enumerate(LANGS) if x == n]
    m = kernel[np.ix_(order, order)]
    got = language.scores(model, *text_bytes(pa.array(TEXTS)))
    assert [model.languages[k] for k in got.argmax(1)] == LANGS
    values, vectors = np.linalg.eigh(m)
    root = vectors / np.sqrt(values)
    features = kernel[:, order] @ root
    solved = np.linalg.solve(features.T @ features / 2 + language.RIDGE * np.eye(6) / 3, features.T @ y / 2)
    assert np.allclose(got, features @ solved, atol=1e-3)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "the dog and the cat"), (4, "der Hund"), (4, "der Hund"), (5, "le chien " * 3000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = sorted(map(tuple, language.identify(df, language.fit(TEXTS, LANGS)).select("doc_id", "lang_pred").collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "de"), (5, "fr")], key=str)
    none = language.identify(df, language.fit([], [])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identify(df.limit(0), language.fit(TEXTS, LANGS)).count() == 0


def test_sample_is_bounded_and_leaves_out_what_is_held(spark):
    df = spark.createDataFrame([(i, f"text {i}", "en" if i % 3 else None) for i in range(200)], "doc_id long, text string, lang string")
    texts, langs = language.training_sample(df, ~language.held_out(4, 2), 50)
    ids = [int(x.split()[1]) for x in texts]
    assert len(ids) == 50 and all(i % 3 and zlib.crc32(str(i).encode()) % 4 != 2 for i in ids) and set(langs) == {"en"}


def test_picks_are_the_smallest_hashes(spark):
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("lang"))
    got = {(r.lang, r.doc_id) for r in smallest_hashes(ids, "lang", 200).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    want = {("rare", r.doc_id) for r in ids.where("lang = 'rare'").orderBy(place).limit(200).collect()}
    want |= {("often", r.doc_id) for r in ids.where("lang = 'often'").orderBy(place).limit(200).collect()}
    assert got == want
    assert smallest_hashes(ids.limit(0), "lang", 5).count() == 0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", F.octet_length("text").alias("n"))
    got = QUERIES["op3_string_kernel_language"](spark, folder).join(docs, "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.n > 40]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
