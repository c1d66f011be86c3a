import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from permaway.llm import stages
from permaway.llm.queries import QUERIES
from tests.llm.test_neardup import brute_force as near_brute_force
from tests.llm.test_quality import counts
from tests.llm.test_substrings import brute_force as cut_brute_force

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "substring_dedup", "packing"]
    seen = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        seen[name] = rows
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(rows, docs.schema)
    text = lambda n: {r.doc_id: r.text for r in seen[n]}
    # Quality: what fails the base rules goes, and what the query keeps stays.
    kept = {r.doc_id for r in QUERIES["op4_line_field_quality"](spark, FOLDER).where("kept").collect()}
    assert set(text("quality_rules")) == kept and not any(counts(t)[-1] for t in text("quality_rules").values())
    assert len(text("language_id")) >= 0.97 * len(kept)
    near = near_brute_force(list(text("language_id").items()), percent=80)
    assert set(text("near_dedup")) == {r[0] for r in near if r[3]}
    cut = {r[0]: r for r in cut_brute_force(list(text("near_dedup").items()), 50)}
    assert set(text("substring_dedup")) == set(cut)
    for i, t in text("substring_dedup").items():
        assert hashlib.sha256(" ".join(t.encode().decode().split()).encode()).hexdigest() == cut[i][3] or cut[i][2] == 0
        assert (t == text("near_dedup")[i]) == (cut[i][2] == 0)
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"])
    pieces = {}
    for r in seen["packing"]:
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert set(pieces) == set(cut) and all(pieces[r.doc_id] == r.doc_tokens for r in seen["packing"])
    assert corpus_pipeline.run(spark, FOLDER).select(F.sum("length")).first()[0] == sum(pieces.values())


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, found string, kept_text string, gone_id long"
    long = " ".join(f"word{i}" for i in range(120))
    rows = [(1, None), (None, long), (2, long), (2, long), (2, "other " * 3), (3, long), (4, long + " and more"), (5, "")]
    df = spark.createDataFrame([(i, t, None, None, None, "x", "y", 7) for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, FOLDER)
        assert out.columns == df.columns
        assert stage(spark, df.limit(0), FOLDER).count() == 0
    near = sorted(((r.doc_id, r.text) for r in stages.near_dedup(spark, df, FOLDER).collect()), key=str)
    assert near == sorted([r for r in rows if r[0] not in (3, 4)], key=str)
    cut = {r.doc_id: r.text for r in stages.substring_dedup(spark, df, FOLDER).where("doc_id > 2").collect()}
    assert cut == {3: "", 4: "and more", 5: ""}
