"""Order-dependent state machines over keyed rows, batch form.

A *step* takes one run of consecutive rows of a key (a pandas frame, sorted)
and the state left by the rows before it, and returns the output frame and the
new state. States are JSON values, so the same step also drives the streaming
form (streaming.stateful).

The rows are cut into range chunks by key and order and stream through
``mapInPandas`` sorted: no task ever holds a whole group. For the keys that lie
in more than one chunk, every chunk first runs on its own, then the chunks
whose carried-in state turned out different run again until nothing changes.
Only one state per chunk reaches the driver. Inputs of all sizes take this one path.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from permaway.operators.scan import CHUNK, chunked

Step = Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]]


@dataclass(frozen=True)
class Jump:
    """How a chunk of one key moves any state.

    ``build(rows, state)`` sums up a chunk from ``columns`` of its rows and the
    state it reaches from nothing; ``apply(summary, before)`` gives the state after it.
    """

    build: Callable[[pd.DataFrame, object], object]
    apply: Callable[[object, object], object]
    columns: list[str]



def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Step,
    schema: str,
    *,
    tolerance: float = 1e-12,
    jump: Jump | None = None,
) -> DataFrame:
    """Run ``step`` over each key in ``order``; ``schema`` is the DDL of its output."""
    stored = chunked(df, keys, order)
    split = _split_keys(stored, keys)
    carries = _follow(split, keys, step, jump) if jump else _settle(split, keys, step, tolerance)
    return stored.mapInPandas(_emitter(keys, step, carries), schema)


def _split_keys(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the keys that lie in more than one chunk; only their states travel.

    At most one key is split at each border between chunks, so the list is shorter than the chunks.
    """
    if not keys:
        return stored
    key = F.struct(*keys)
    edges = {
        r[CHUNK]: (r["low"], r["high"])
        for r in stored.groupBy(CHUNK).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    }
    order = sorted(edges)
    split = {tuple(edges[a][1]) for a, b in zip(order, order[1:]) if edges[a][1] == edges[b][0]}
    renamed = StructType([StructField(f"_split_{k}", stored.schema[k].dataType) for k in keys])
    wanted = stored.sparkSession.createDataFrame(list(split), renamed)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_split_{k}")) for k in keys])
    return stored.join(F.broadcast(wanted), match, "left_semi")


def _follow(stored: DataFrame, keys: list[str], step: Step, jump: Jump) -> dict[int, str]:
    """The state entering each chunk, from one pass and the summaries of the chunks."""
    chunks = _summaries(stored, keys, step, {}, jump)
    carries: dict[int, str] = {}
    order = sorted(chunks)
    for before, after in zip(order, order[1:]):
        if chunks[before]["last"] != chunks[after]["first"]:
            continue
        carries[after] = chunks[before]["state"]
        if chunks[after]["single"]:
            moved = jump.apply(json.loads(chunks[after]["summary"]), json.loads(carries[after]))
            chunks[after]["state"] = json.dumps(moved)
    return carries


def _settle(stored: DataFrame, keys: list[str], step: Step, tolerance: float) -> dict[int, str]:
    """The state entering each chunk, found by repeated runs until stable.

    All chunks run again once. Where states do not forget, most would change in every round after it, so those rounds take the
    chunks that what is settled leads to, and only as many others as there are cores.
    """
    chunks = _summaries(stored, keys, step, {})
    used: dict[int, str] = {}
    cores, first = stored.sparkSession.sparkContext.defaultParallelism, True
    while True:
        wanted: dict[int, str] = {}
        for before, after in zip(sorted(chunks), sorted(chunks)[1:]):
            if chunks[before]["last"] == chunks[after]["first"]:
                wanted[after] = chunks[before]["state"]
        stale = {
            c: s for c, s in wanted.items()
            if chunks[c]["single"] and not _close(used.get(c), s, tolerance)
        }
        if not stale:
            return wanted
        if not first:
            known = sorted(chunks)
            leads = {after for before, after in zip(known, known[1:]) if after in stale and before not in stale}
            taken = leads | set(sorted(stale)[:cores])
            stale = {c: s for c, s in stale.items() if c in taken}
        first = False
        used.update(stale)
        again = stored.filter(F.col(CHUNK).isin(list(stale)))
        for number, row in _summaries(again, keys, step, stale).items():
            chunks[number] = row


def _summaries(
    stored: DataFrame, keys: list[str], step: Step, carries: dict[int, str], jump: Jump | None = None
) -> dict[int, dict]:
    rows = stored.mapInPandas(
        _summariser(keys, step, carries, jump),
        f"{CHUNK} int, first string, last string, single boolean, state string, summary string",
    ).collect()  # one row per chunk
    return {r[CHUNK]: r.asDict() for r in rows}


def _segments(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Consecutive rows with one key, as (key text, rows)."""
    if pdf.empty:
        return
    starts = np.zeros(len(pdf), dtype=bool)
    starts[0] = True
    for k in keys:
        col = pdf[k]
        moved = col.shift()
        starts |= ((col != moved) & ~(col.isna() & moved.isna())).to_numpy()
    at = np.flatnonzero(starts)
    for s, e in zip(at, np.append(at[1:], len(pdf))):
        part = pdf.iloc[s:e]
        yield repr([None if pd.isna(part[k].iloc[0]) else str(part[k].iloc[0]) for k in keys]), part


def _walk(batches, keys, step, carries):
    """Yield (key, rows, output, state, chunk) for every run of rows, carrying state along."""
    key, state = None, None
    for pdf in batches:
        chunk = int(pdf[CHUNK].iloc[0]) if CHUNK in pdf.columns and len(pdf) else -1
        for name, part in _segments(pdf, keys):
            if name != key:
                carried = carries.get(chunk) if key is None else None
                state = json.loads(carried) if carried is not None else None
                key = name
            out, state = step(part, state)
            yield key, part, out, state, chunk


def _emitter(keys, step, carries):
    def run(batches):
        held, rows = [], 0
        for _, _, out, _, _ in _walk(batches, keys, step, carries):
            if len(out):
                held.append(out)
                rows += len(out)
            if rows >= 10_000:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return run


def _summariser(keys, step, carries, jump):
    def run(batches):
        first = key = state = None
        chunk, single, seen = -1, True, []
        for key, part, _, state, chunk in _walk(batches, keys, step, carries):
            if first is None:
                first = key
            single = single and key == first
            if jump and single:
                seen.append(part[jump.columns])
        if first is not None:
            summary = json.dumps(jump.build(pd.concat(seen), state)) if jump and single else None
            yield pd.DataFrame({
                CHUNK: [chunk], "first": [first], "last": [key], "single": [single],
                "state": [json.dumps(state)], "summary": pd.Series([summary], dtype=object),
            })

    return run


def _close(a: str | None, b: str | None, tolerance: float) -> bool:
    if a is None or b is None:
        return a is b
    return a == b or _near(json.loads(a), json.loads(b), tolerance)


def _near(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_near(a[k], b[k], tolerance) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_near(x, y, tolerance) for x, y in zip(a, b))
    return a == b
