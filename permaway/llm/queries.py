"""The queries of the operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permaway.llm import alignment, bpe, hamming, language, mixing, neardup, packing, quality, sharding, substrings, toxicity, whitening, wordpiece
from permaway.llm.store import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    """Register a function under its name."""
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes."""
    return sharding.shard_by_bytes(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document with a smaller id has too."""
    found = substrings.repeated_substrings(documents(spark, sf_dir), 50)
    kept = F.coalesce(F.sha2("kept_text", 256), F.lower(F.hex("words_sha256")))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their five-word shingles."""
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85, shingle=5).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the multilingual byte-level ranks, and what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"))
    return bpe.decode(digests, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 4096 tokens."""
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def language_model(docs: DataFrame, learn: Column) -> language.LanguageModel:
    return language.fit(*language.training_sample(docs, learn))


@query
def op3_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text, learned from three quarters of the ids."""
    docs, held = documents(spark, sf_dir), language.held_out(4, 2)
    found = language.identify(docs, language_model(docs, F.col("doc_id").isNotNull() & ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op4_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, and whether it is kept."""
    docs = documents(spark, sf_dir)
    found = quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from four fifths of the ids."""
    docs, held = documents(spark, sf_dir), language.held_out(5, 0)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("doc_id").isNotNull() & ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to each hundredth row, by the signs of their embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.nearest(rows, rows.where("id % 100 = 0"), 10)


ORACLES["op7_multi_index_hashing"] = """
WITH codes AS (
    SELECT vec_id, list_aggregate(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
    SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, r.code)) AS INTEGER) AS distance
    FROM codes q JOIN codes r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs) WHERE rank <= 10
"""


@query
def op9_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match tokens of every text by the pieces of a public model."""
    pieces = wordpiece.sentence_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.count_tokens(documents(spark, sf_dir), pieces, marker="\u2581")


_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

ORACLES["op2_repeated_substrings"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (h) WHERE low < doc_id),
every AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS text FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op6_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT l.y, r.low FROM r JOIN l ON l.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(low) AS component_id, r.doc_id = min(low) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and up to which word, a mix of the sources by weights takes each document."""
    mix = mixing.plan(documents(spark, sf_dir), shards=64, weights=(1, 2, 3), most=3)
    return mixing.mixed_sizes(mix).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op12_source_mixing"] = f"""
WITH r AS (SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS point FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, CAST(sum(size) + count(*) AS BIGINT) AS all_, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM r GROUP BY source),
w AS (SELECT *, no % 3 + 1 AS w FROM t),
o AS (SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS parts
    FROM w WINDOW before AS (ORDER BY CAST(s AS DOUBLE) / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(3 * s AS DOUBLE) * parts < CAST(left_ AS DOUBLE) * w AS capped FROM o),
f AS (SELECT *, CASE WHEN capped THEN CAST(3 * s AS DOUBLE) ELSE w * (CAST(sum(s) OVER () - coalesce(sum(3 * s) FILTER (capped) OVER (), 0) AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE)) END AS target FROM c),
q AS (SELECT source, s, target, (all_ + {mixing.BLOCK_WORDS - 1}) // {mixing.BLOCK_WORDS} AS blocks, CASE WHEN s > 0 THEN CAST(round(target) AS BIGINT) // s ELSE 0 END AS full_, CAST(round(target) AS BIGINT) AS words FROM f),
l AS (SELECT r.*, q.s, q.target, q.full_, q.words - q.full_ * q.s AS rest,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY point % blocks, point RANGE UNBOUNDED PRECEDING), 0) AS up_to,
    sum(size) OVER (PARTITION BY r.source, point) AS own, count(*) OVER (PARTITION BY r.source, point) AS rows_
    FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, s AS source_size, target, CAST(full_ * size + CASE WHEN up_to <= rest THEN size WHEN up_to - own < rest THEN (rest - (up_to - own)) // rows_ ELSE 0 END AS BIGINT) AS taken FROM l
"""


@query
def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on the sixteen directions in which they vary most, each with unit variance."""
    return whitening.whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 16).withColumnRenamed("id", "vec_id")


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of a byte-level and of a piece tokenizer in every text, and how common they are."""
    found = alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
