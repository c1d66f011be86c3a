"""Corridor graph and delay propagation.

Nodes are (id, type, features ARRAY) and edges (src, dst, type, weight). A
message of an edge is ``weight * features(src) @ W[type]``; attention weighs
the messages of a target by softmax of their score. Since the score and the
sum are linear in the features, only the short feature sums per target and
edge type are shuffled; the matrices are applied once per target afterwards.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.functions.arrays import dot, fit_length, vector_times_matrix
from permaway.operators.joins import defect_marks, nearest_lookup, range_lookup
from permaway.operators.ordered import following_edges
from permaway.session import durable

EDGE_TYPES = ["runs_on", "stops_at", "connects_to", "follows", "feeds_into", "blocks"]
INPUTS = 5
HIDDEN = 32


@dataclass(frozen=True)
class Weights:
    """One INPUTS x HIDDEN matrix per edge type and one attention vector."""

    matrices: dict[str, list[list[float]]]
    attention: list[float]


def seeded_weights(seed: int = 42, inputs: int = INPUTS, hidden: int = HIDDEN, spread: float = 0.1) -> Weights:
    """Normal weights drawn in a fixed order from one seeded generator."""
    draw = random.Random(seed)
    matrices = {t: [[draw.gauss(0, spread) for _ in range(hidden)] for _ in range(inputs)] for t in EDGE_TYPES}
    return Weights(matrices, [draw.gauss(0, spread) for _ in range(hidden)])


def train_features(trains: DataFrame) -> Column:
    """Speed, delay, place, priority and direction of a train, scaled."""
    return F.array(
        F.col("speed") / 160.0, F.least(F.col("delay") / 60.0, F.lit(1.0)), F.col("km") / 72.0,
        F.coalesce(F.col("priority"), F.lit(3)) / 6.0, F.when(F.coalesce(F.col("direction"), F.lit("UP")) == "UP", 1.0).otherwise(-1.0),
    )


def corridor_graph(
    trains: DataFrame, stations: DataFrame, segments: DataFrame, defects: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from trains (id, km, speed, delay, priority, direction) and the corridor dimensions.

    Direct neighbours on the line are linked, trains to their segment, to a
    station within 5 km and to the train behind within 10 km. Both tables are
    read several times by what follows, so they are written down once.
    """
    on = durable(range_lookup(
        trains.select("id", "km"), segments.withColumnRenamed("id", "segment"), at="km", order="seg_order",
        start="start_km", end="end_km", keep=["segment"], point_id="id",
    ).filter(F.col("segment").isNotNull()))
    runs = on.select(F.concat(F.lit("train-"), "id").alias("src"), F.col("segment").alias("dst"), F.lit("runs_on").alias("type"), F.lit(1.0).alias("weight"))
    stops = nearest_lookup(
        trains.select("id", "km"), stations, at="km", place_at="km", place_id="id", point_id="id", within=5.0
    ).select(
        F.concat(F.lit("train-"), "id").alias("src"), F.concat(F.lit("stn-"), "nearest").alias("dst"),
        F.lit("stops_at").alias("type"), F.lit(1.0).alias("weight"),
    )
    follows = following_edges(trains, [], "km", "id").select(
        F.concat(F.lit("train-"), "src").alias("src"), F.concat(F.lit("train-"), "dst").alias("dst"), "type", "weight"
    )
    hops = following_edges(stations.withColumnRenamed("id", "s"), [], "km", "s", within=float("inf"))
    both_ways = lambda s, d: F.struct(F.concat(F.lit("stn-"), s).alias("src"), F.concat(F.lit("stn-"), d).alias("dst"))
    connects = hops.select(F.explode(F.array(both_ways("src", "dst"), both_ways("dst", "src"))).alias("e"), "weight").select(
        "e.*", F.lit("connects_to").alias("type"), "weight"
    )
    feeds = following_edges(segments.select("seg_order", F.col("id").alias("g")), [], "seg_order", "g", within=1.5).select(
        "src", "dst", F.lit("feeds_into").alias("type"), F.lit(1.0).alias("weight")
    )
    edges = runs.unionByName(stops).unionByName(follows).unionByName(connects).unionByName(feeds)
    held = on.groupBy(F.col("segment").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("occupancy"))
    marked = defect_marks(segments, defects).join(held, "id", "left")
    nodes = (
        trains.select(F.concat(F.lit("train-"), "id").alias("id"), F.lit("train").alias("type"), train_features(trains).alias("features"))
        .unionByName(stations.select(
            F.concat(F.lit("stn-"), "id").alias("id"), F.lit("station").alias("type"),
            F.array(F.col("km"), F.col("platforms").cast("double"), F.col("importance"), F.lit(0.0)).alias("features"),
        ))
        .unionByName(marked.select(
            "id", F.lit("segment").alias("type"),
            F.array(
                F.col("end_km") - F.col("start_km"), F.col("max_speed").cast("double"), F.col("capacity").cast("double"),
                F.coalesce("occupancy", F.lit(0.0)), F.col("has_defect").cast("double"),
            ).alias("features"),
        ))
    )
    return durable(nodes), durable(edges)


#: Scores of one band differ by less than this, so exp of the differences stays far within a double.
SCORE_BAND = 64.0


def edge_scores(edges: DataFrame, nodes: DataFrame, weights: Weights) -> DataFrame:
    """Edges with the features of their source and the attention score of their message."""
    size = len(next(iter(weights.matrices.values())))
    sources = nodes.select(F.col("id").alias("src"), fit_length(F.col("features"), size).alias("x"))
    # A type without a matrix of its own uses the first.
    seen = edges.join(sources, "src").withColumn("type", F.when(F.col("type").isin(list(weights.matrices)), F.col("type")).otherwise(next(iter(weights.matrices))))
    score = F.lit(0.0)
    for kind, matrix in weights.matrices.items():
        toward = [float(sum(w * a for w, a in zip(row, weights.attention))) for row in matrix]
        score = F.when(F.col("type") == kind, dot(F.col("x"), F.array(*[F.lit(t) for t in toward]))).otherwise(score)
    return seen.withColumn("score", score * F.col("weight"))


def attention_sums(scored: DataFrame, kinds: list[str], size: int, floor: float = 1e-8) -> DataFrame:
    """Per target the attention-weighted feature sums of each edge type.

    The weights are ``exp(s - max) / (sum(exp(s - max)) + floor)``. Scores are summed up by target and band of scores, each
    relative to its band, so that no score is too large for ``exp``, and bands are scaled to the target's maximum when they
    meet. Tasks add up their own edges first: a target with many edges sends a row for each task and band, no edges.
    """
    banded = scored.withColumn("_band", F.coalesce(F.floor(F.col("score") / SCORE_BAND), F.lit(0)).cast("double"))
    e = F.exp(F.col("score") - F.col("_band") * SCORE_BAND)
    names = [f"_s{n}_{i}" for n in range(len(kinds)) for i in range(size)]
    parts = [
        F.sum(F.when(F.col("type") == k, e * F.col("weight") * F.get("x", i)).otherwise(0.0)).alias(f"_s{n}_{i}")
        for n, k in enumerate(kinds) for i in range(size)
    ]
    bands = banded.groupBy("dst", "_band").agg(F.max("score").alias("_top"), F.sum(e).alias("_e"), *parts)
    ranked = bands.groupBy("dst").agg(F.max("_top").alias("_top"), F.collect_list(F.struct("_band", "_e", *names)).alias("_bands"))
    total = lambda name: F.aggregate(
        "_bands", F.lit(0.0), lambda acc, b: acc + F.exp(b["_band"] * SCORE_BAND - F.col("_top")) * b[name]
    ).alias(name)
    sums = ranked.select(F.col("dst").alias("id"), *map(total, ["_e", *names]))
    share = lambda n, i: F.col(f"_s{n}_{i}") / (F.col("_e") + floor)
    return sums.select("id", *[F.array(*[share(n, i) for i in range(size)]).alias(f"m{n}") for n in range(len(kinds))])


def message_round(nodes: DataFrame, edges: DataFrame, weights: Weights) -> DataFrame:
    """Nodes with ``embedding = tanh(self + attention-weighted messages)``."""
    kinds = list(weights.matrices)
    size = len(weights.matrices[kinds[0]])
    sums = attention_sums(edge_scores(edges, nodes, weights), kinds, size)
    joined = nodes.join(sums, "id", "left")
    zero = F.array_repeat(F.lit(0.0), size)
    # Own features and the sums of every edge type side by side meet one stacked matrix.
    inputs = F.concat(fit_length(F.col("features"), size), *[F.coalesce(F.col(f"m{n}"), zero) for n in range(len(kinds))])
    stacked = [row for k in [kinds[0], *kinds] for row in weights.matrices[k]]
    columns = [[float(row[j]) for row in stacked] for j in range(len(weights.attention))]
    return joined.select(*nodes.columns, inputs.alias("_z")).select(
        *nodes.columns, F.transform(vector_times_matrix(F.col("_z"), columns), F.tanh).alias("embedding")
    )


def message_rounds(nodes: DataFrame, edges: DataFrame, weights: Weights, rounds: int = 3, carry: bool = False) -> DataFrame:
    """Several rounds. Without ``carry`` every round reads the raw features, so one round is the result.

    With ``carry`` the embedding becomes the next input and each round is written down.
    """
    if not carry:
        return message_round(nodes, edges, weights)
    kept = nodes.select("id", "type", F.col("features").alias("_raw"), "features")
    for _ in range(rounds):
        done = message_round(kept, edges, weights)
        kept = durable(done.select("id", "type", "_raw", F.col("embedding").alias("features")))
    return kept.select("id", "type", F.col("_raw").alias("features"), F.col("features").alias("embedding"))


def predict_delays(
    nodes: DataFrame, edges: DataFrame, weights: Weights, *, horizon_min: float = 15.0, rounds: int = 3, carry: bool = False
) -> DataFrame:
    """Delay forecast per train: point, confidence, risk of propagation, number of trains behind.

    The trains behind themselves are the ``follows`` edges (see affected_trains).
    """
    trains = message_rounds(nodes, edges, weights, rounds, carry).filter(F.col("type") == "train")
    x = F.col("features")
    delay, speed, direction = F.get(x, 1) * 60.0, F.get(x, 0), F.get(x, 4)
    decode = F.aggregate(
        F.transform("embedding", lambda v, i: v * ((i % 5 - 2) * 0.1)), F.lit(0.0), lambda acc, v: acc + v
    )
    raised = F.greatest(F.lit(0.0), delay + decode * horizon_min * 0.3)
    raised = F.when(speed < 0.3, raised * 1.3).otherwise(raised)
    raised = F.when(direction < 0, raised * 1.1).otherwise(raised)
    defects = nodes.filter("type = 'segment'").agg(
        F.count_if(F.get("features", 4) > 0).alias("_defects"), F.lit(1).alias("_one")
    )
    ends = edges.filter(F.col("type") == "follows").select(
        F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("_e")
    ).select("_e.*")
    links = ends.groupBy("id").agg(F.count(F.lit(1)).alias("_links"), F.sum("out").alias("affected"))
    joined = trains.join(links, "id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(defects), "_one")
    risk = F.least(F.lit(1.0), F.coalesce("_links", F.lit(0)) * 0.25 + delay / 30.0)
    return joined.select(
        F.regexp_replace("id", "^train-", "").alias("train_id"), delay.alias("current_delay_min"),
        F.round(raised, 1).alias("predicted_delay_min"),
        F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.95), 0.85 - F.col("_defects") * 0.1)), 3).alias("confidence"),
        F.round(risk, 3).alias("propagation_risk"), F.coalesce("affected", F.lit(0)).alias("affected"),
    )


def affected_trains(edges: DataFrame) -> DataFrame:
    """Train and the train behind it, from the ``follows`` edges."""
    strip = lambda c: F.regexp_replace(c, "^train-", "")
    return edges.filter(F.col("type") == "follows").select(strip("src").alias("train_id"), strip("dst").alias("affected_id"))
