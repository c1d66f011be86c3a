"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame and SQL functions only.

Rows of a source fall into blocks by a hash of id and text, so the order of blocks, and of rows in a block, is a random
permutation. A source's quota is a number of blocks, drawn in that order, again from the first when all are used up; the last
block is drawn up to a row, and that row up to a word, so the quota is exact. A tree cuts the output shards in halves: the
left half of a node draws its share of the node's blocks without replacement, which leaves each source a multivariate
hypergeometric number, down to one shard. Shards then own disjoint ranges of each source's permuted draws, and shuffle
their rows by themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permaway.llm.store import Scratch

#: Words and rows that a block holds on average; blocks that share one entry of the coarse running total.
BLOCK_WORDS, COARSE = 1 << 14, 1024
#: A prime above every quota in blocks: multiples of it, modulo a quota, are a permutation.
STRIDE = 1_610_612_741
#: Hash bits of a row.
POINT_BITS = 60

WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """rows: doc_id, source, size, point; sources: a row each, with its number `no`, sizes, target and quota; draws: for each
    (no, block) an array of (copy, shard); whole: whether the copy takes the whole block."""

    rows: DataFrame
    sources: DataFrame
    draws: DataFrame
    seed: int


def row_point() -> Column:
    """A hash of id and text; equal rows have equal ones."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, POINT_BITS // 4), 16, 10).cast("long")


def _columns(documents: DataFrame) -> DataFrame:
    kept = documents.select(*(F.col(x).cast(kind).alias(x) for x, kind in (("doc_id", "long"), ("source", "string"), ("text", "string"))))
    return kept.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("point", row_point())


def targets(totals: DataFrame, weights: list[int], most: int) -> DataFrame:
    """Columns no, weight and target for one row a source (source, source_size), numbered by code point, null last.

    All sizes are shared out by weight. A source stops at `most` times its size, and what is above goes to the others by weight:
    in the order of size over weight, sources are capped as long as the fair share of what is left exceeds their cap.
    """
    every = F.array(*(F.lit(x) for x in weights))
    numbered = totals.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    numbered = numbered.withColumn("weight", F.get(every, F.col("no") % len(weights)).cast("long"))
    order = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), "no")
    before, cap = order.rowsBetween(Window.unboundedPreceding, -1), most * F.col("source_size")
    rest = numbered.withColumns({
        "left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "parts": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    judged = rest.withColumn("capped", cap.cast("double") * F.col("parts") < F.col("left").cast("double") * F.col("weight"))
    open_ = Window.partitionBy()
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(open_).cast("double")
    words = (F.sum("source_size").over(open_) - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(open_), F.lit(0))).cast("double")
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * (words / free))
    return judged.withColumn("target", target).drop("left", "parts", "capped")


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _steps(count: str) -> str:
    return f"if({count} > 0, sequence(1L, {count}), cast(array() as array<bigint>))"


def hypergeometric(rest: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL of how many of `drawn` out of `rest` are marked, by inversion of a uniform number from the mode outwards.

    Weights relative to the mode follow from the ratios of neighbours. Beyond 12 deviations (and 40 numbers) from the
    mode they add up to less than a double can tell.
    """
    up, down = "(h.q - k) * (h.n - k) / ((k + 1D) * (h.r - h.q - h.n + k + 1D))", "k * (h.r - h.q - h.n + k) / ((h.q - k + 1D) * (h.n - k + 1D))"

    def walk(sign: str, ratio: str, steps: str, start: str, goal: str) -> str:
        """The sum of weights and the number reached: it moves on while the sum so far is below the goal."""
        factor = _let("k", f"cast(h.mode {sign} (i - 1) as double)", ratio)
        step = f"transform(array(a.p * {factor}), w -> named_struct('p', w, 's', a.s + w, 'm', a.m + if(a.s < {goal}, 1L, 0L)))[0]"
        return f"aggregate({_steps(steps)}, named_struct('p', 1D, 's', {start}, 'm', 0L), (a, i) -> {step})"

    facts = f"named_struct('r', cast({rest} as bigint), 'q', cast({marked} as bigint), 'n', cast({drawn} as bigint))"
    mode = "least(greatest(cast(floor((f.n + 1D) * (f.q + 1D) / (f.r + 2D)) as bigint), f.n + f.q - f.r, 0L), f.n, f.q)"
    share = "(f.q / greatest(cast(f.r as double), 1D))"
    spread = f"(40L + cast(ceil(12D * sqrt(f.n * {share} * (1D - {share}) * (f.r - f.n) / greatest(f.r - 1D, 1D))) as bigint))"
    shape = f"named_struct('r', f.r, 'q', f.q, 'n', f.n, 'mode', {mode}, 'spread', {spread})"
    ends = "named_struct('up', least(least(h.n, h.q) - h.mode, h.spread), 'down', least(h.mode - greatest(h.n + h.q - h.r, 0L), h.spread))"
    sums = f"named_struct('up', {walk('+', up, 'e.up', '1D', '0D')}.s, 'down', {walk('-', down, 'e.down', '0D', '0D')}.s)"
    goal = f"({uniform} * (s.up + s.down))"
    high = f"h.mode + {walk('+', up, 'e.up', '1D', 'g')}.m"
    low = f"h.mode - {walk('-', down, 'e.down', '0D', '(g - s.up)')}.m"
    found = _let("g", goal, f"if(g <= s.up, {high}, {low})")
    return _let("f", facts, _let("h", shape, _let("e", ends, _let("s", sums, found))))


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row a shard: shard, and by source `quota` (blocks) and `start` (blocks of the shards before it).

    quotas: one row with an array `quota`, blocks by source. Shard k gets the blocks between k / shards and (k + 1) / shards of all.
    """
    total = "aggregate(quota, 0L, (a, x) -> a + x)"
    nodes = quotas.selectExpr("quota", "transform(quota, x -> 0L) AS start", "0 AS lo", f"{int(shards)} AS hi", f"{total} AS n_all")
    edge = lambda at: f"({at} * n_all) div {int(shards)}L"
    number = f"(shiftrightunsigned(xxhash64({int(seed)}L, lo, hi, i), 11) + 0.5D) * {2.0**-53!r}D"
    one = _let("x", hypergeometric("a.rest", "quota[i]", "a.need", number), "named_struct('need', a.need - x, 'rest', a.rest - quota[i], 'out', concat(a.out, array(x)))")
    begin = f"named_struct('need', {edge('mid')} - {edge('lo')}, 'rest', {edge('hi')} - {edge('lo')}, 'out', cast(array() as array<bigint>))"
    left = f"if(hi - lo > 1, aggregate(if(size(quota) > 0, sequence(0, size(quota) - 1), cast(array() as array<int>)), {begin}, (a, i) -> {one}).out, quota)"
    halves = """inline(if(hi - lo = 1, array(named_struct('lo', lo, 'hi', hi, 'quota', quota, 'start', start)), array(
        named_struct('lo', lo, 'hi', mid, 'quota', half, 'start', start),
        named_struct('lo', mid, 'hi', hi, 'quota', zip_with(quota, half, (q, x) -> q - x), 'start', zip_with(start, half, (s, x) -> s + x)))))"""
    depth = math.ceil(math.log2(max(shards, 1)))
    for level in range(depth):
        if level == depth // 2 > 2:
            nodes = nodes.repartition("lo")
        nodes = nodes.selectExpr("*", "(lo + hi) div 2 AS mid_").selectExpr("quota", "start", "lo", "hi", "n_all", "cast(mid_ AS int) AS mid")
        nodes = nodes.selectExpr("*", f"{left} AS half").selectExpr("n_all", halves)
    return nodes.selectExpr("lo AS shard", "quota", "start")


def plan(documents: DataFrame, shards: int = 64, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 12) -> Mix:
    """What each shard draws of each source. Reads the texts once; later steps read a narrow table in the shared folder.

    One row a source goes through one task, as weights are given source by source; nothing else is gathered.
    """
    kept, passing = Scratch(documents.sparkSession), Scratch(documents.sparkSession)
    rows = kept.table(_columns(documents).drop("text"), "mixing-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = targets(totals, list(weights), most).withColumns({
        "blocks": F.ceil((F.col("source_size") + F.col("n_rows")) / block_words).cast("long"),
        "words": F.round("target").cast("long"),
    })
    share = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("long")
    sources = sources.withColumn("full", share).withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
    sources = passing.table(sources, "mixing-sources")
    cut = _cuts(rows, sources)
    sources = sources.join(cut, "no", "left").withColumn("cards", F.col("full") * F.col("blocks") + F.coalesce(F.col("cut_block") + F.when(F.col("cut_block") >= 0, 1), F.lit(0)))
    sources = kept.table(sources, "mixing-quotas")
    passing.drop()
    quotas = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "cards"))), lambda x: x["cards"]).alias("quota"))
    ranges = splitting_tree(quotas, shards, seed).selectExpr("shard", "posexplode(arrays_zip(quota, start)) AS (no, part)").where("part.quota > 0")
    places = ranges.selectExpr("shard", "no", "explode(sequence(part.start, part.start + part.quota - 1)) AS place")
    card = F.expr(f"(place * {STRIDE}L + pmod(xxhash64({int(seed)}L, no), cards)) % cards")
    cards = places.join(sources.select("no", "blocks", "cards"), "no").withColumn("card", card)
    drawn = cards.selectExpr("no", "card % blocks AS block", "cast(card div blocks AS int) AS copy", "shard")
    draws = drawn.groupBy("no", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    return Mix(rows, sources, kept.table(draws, "mixing-draws"), seed)


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what their source has, and their block."""
    joined = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    return joined.withColumn("block", F.col("point") % F.col("blocks"))


def _crossing(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of each key at which the running sum of `words`, from `before`, passes `rest`; `before` becomes the sum before it."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(window), F.lit(0)))
    return summed.where("before < rest AND rest <= before + words")


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Where the last, partial pass over each source ends: block, point, and the words that each row at that point gives.

    The running total is taken over groups of blocks, then over the blocks of one group, then over the rows of one block.
    """
    own = in_blocks(rows, sources.where("rest > 0").select("source", "no", "blocks", "rest"))
    blocks = own.groupBy("no", "rest", "block").agg(F.sum("size").alias("words")).withColumn("group", F.expr(f"block div {COARSE}"))
    groups = blocks.groupBy("no", "rest", "group").agg(F.sum("words").alias("words")).withColumn("before", F.lit(0).cast("long"))
    group = _crossing(groups, ["no"], "group").select("no", "group", "before")
    block = _crossing(blocks.join(group, ["no", "group"]), ["no"], "block").select("no", "block", "before")
    points = own.join(block, ["no", "block"]).groupBy("no", "rest", "block", "before", "point").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    return _crossing(points, ["no"], "point").select("no", F.col("block").alias("cut_block"), F.col("point").alias("cut_point"), F.expr("(rest - before) div rows").alias("cut_words"))


def drawn_rows(rows: DataFrame, mix: Mix) -> DataFrame:
    """Rows (with source, size and point) and `draws`: copy, shard and words of each time the mix takes the row."""
    sources = mix.sources.select("source", "no", "source_size", "target", "blocks", "full", "cut_block", "cut_point", "cut_words")
    joined = in_blocks(rows, sources).join(mix.draws, ["no", "block"], "left")
    partial = F.col("block") == F.col("cut_block")
    part = F.when(F.col("point") < F.col("cut_point"), F.col("size")).when(F.col("point") == F.col("cut_point"), F.col("cut_words")).otherwise(0)
    words = lambda x: F.when((x["copy"] == F.col("full")) & partial, part).otherwise(F.col("size"))
    draws = F.transform("draws", lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), words(x).cast("long").alias("words")))
    taken = F.filter(draws, lambda x: x["words"] > 0)
    return joined.withColumn("draws", F.coalesce(taken, F.expr("cast(array() as array<struct<copy:int,shard:int,words:bigint>>)")))


def mixed_sizes(mix: Mix) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, draws and taken (the words of all draws).

    A null text has no words and is never drawn; a null source is a source, the last. Rows that repeat id and text are rows
    like any other and give alike; where the quota ends at them, each gives the same number of words, rounded down. No rows
    give no rows, and columns other than doc_id, source and text are not looked at.
    """
    found = drawn_rows(mix.rows, mix)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select("doc_id", "source", "size", "source_size", "target", "draws", taken.alias("taken"))


def mixed_texts(documents: DataFrame, mix: Mix) -> DataFrame:
    """The mix itself: doc_id, source, text, copy, words (the first so many of the text) and shard, each shard shuffled by itself.

    A shard is one partition. Of a text that the quota ends in, the words up to there are kept with the white space before them.
    """
    rows = drawn_rows(_columns(documents), mix).select("doc_id", "source", "text", "size", "point", F.explode("draws").alias("draw"))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("draw.words").cast("int")), "")
    out = rows.select(
        "doc_id", "source", F.when(F.col("draw.words") < F.col("size"), first).otherwise(F.col("text")).alias("text"),
        "draw.copy", "draw.words", "draw.shard", F.xxhash64(F.lit(mix.seed), "draw.copy", "point").alias("place"),
    )
    return out.repartition("shard").sortWithinPartitions("shard", "place").drop("place")
