"""Steps of the order-dependent operators.

Each builder returns a ``Step`` (see operators.fold): it takes consecutive rows
of one key and the state left before them. ``run`` gives the batch form;
streaming.stateful drives the same steps in a stream. Every step names its
input columns, output schema and sort order in ``Machine``.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.operators.fold import Jump, Step, ordered_fold
from permaway.operators.scan import last_known, ordered_scan


@dataclass(frozen=True)
class Machine:
    """A step with the DDL of its output; ``order`` sorts the rows of a key."""

    step: Step
    schema: str
    order: list[str]
    jump: Jump | None = None


def run(df: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """Batch form of a machine."""
    return ordered_fold(df, keys, machine.order, machine.step, machine.schema, jump=machine.jump)


def cooldown(key: str, key_type: str, seconds: float = 60.0) -> Machine:
    """Alerts at most once per ``seconds``: the next one comes at the first row that far after the last.

    Input: key, ``t`` (seconds), ``row_id``. Output: the rows that alert.
    """
    def step(pdf, state):
        t = pdf["t"].to_numpy(dtype=float)
        picks, last = [], state
        i = 0 if last is None else int(np.searchsorted(t, last + seconds, side="left"))
        while i < len(t):
            picks.append(i)
            last = float(t[i])
            i = int(np.searchsorted(t, last + seconds, side="left"))
        return pdf.iloc[picks][[key, "row_id", "t"]], last

    def build(pdf, _):
        """The chunk's last alert for every first alert it can have.

        First alerts lie within one cooldown of the chunk's start; those that
        lead to the same last alert are one entry ``[latest first, last]``.
        """
        t = pdf["t"].to_numpy(dtype=float)
        n = len(t)
        after = np.searchsorted(t, t + seconds, side="left")
        end = np.where(after < n, after, np.arange(n))
        while True:  # follow all chains at once, doubling the stride
            further = end[end]
            if np.array_equal(further, end):
                break
            end = further
        entries = min(n, int(np.searchsorted(t, t[0] + seconds, side="left")) + 1)
        last = t[end[:entries]]
        block_ends = np.flatnonzero(np.append(last[1:] != last[:-1], True))
        return [[float(t[i]), float(last[i])] for i in block_ends] + [[float(t[-1]), None]]

    def apply(summary, before):
        due = before + seconds
        *blocks, (newest, _) = summary
        if due > newest:
            return before
        return next(last for latest, last in blocks if latest >= due)

    jump = Jump(build, apply, ["t"])
    return Machine(step, f"{key} {key_type}, row_id bigint, t double", ["t", "row_id"], jump)


def scaling_actions(advised: DataFrame, tick: str, t: Column, *, seconds: float = 120.0) -> DataFrame:
    """Scaling advice (tick, active, advice) with NONE in place of advice within ``seconds`` of the last action.

    ``tick`` is an integer, one row each, and ``t`` its time in seconds. Without an active node the advice is no action: it
    waits for the last action's time, but starts none.
    """
    rows = advised.withColumns({"_one": F.lit(1), "_t": t.cast("double")})
    asked = rows.filter((F.col("advice") != "NONE") & (F.col("active") > 0))
    fired = run(asked.select("_one", F.col(tick).cast("bigint").alias("row_id"), F.col("_t").alias("t")), ["_one"], cooldown("_one", "int", seconds))
    acted = rows.join(fired.select(F.col("row_id").alias(tick), F.col("t").alias("_act")), tick, "left")
    seen = ordered_scan(acted, ["_one"], ["_t", tick], [last_known("_act", "_last")])
    free = F.coalesce(F.col("_t") - F.col("_last") >= seconds, F.lit(True))
    stays = F.col("_act").isNotNull() | ((F.col("active") == 0) & free)
    return seen.withColumn("advice", F.when(stays, F.col("advice")).otherwise("NONE")).drop("_one", "_t", "_act", "_last")


def link_states(key: str, key_type: str, threshold: int = 3, window_s: float = 30.0) -> Machine:
    """Connection states: three failures in 30 s cut the link, a success begins to reconnect, an upload completes it.

    Input: key, ``t``, ``row_id``, ``event`` (success, failure, uploaded).
    Output: one row per transition.
    """
    def move(current, failures, t, event):
        """State and recent failures after one event."""
        if event == "success":
            return ("RECONNECTING" if current == "AUTONOMOUS" else current), []
        if event == "failure":
            failures = [f for f in failures if t - f <= window_s] + [t]
            cut = current == "CONNECTED" and len(failures) >= threshold
            return ("AUTONOMOUS" if cut else current), failures[-threshold:]
        return ("CONNECTED" if event == "uploaded" and current == "RECONNECTING" else current), failures

    def step(pdf, state):
        current, failures = (state or ["CONNECTED", []])
        rows = []
        for t, row_id, event in zip(pdf["t"].tolist(), pdf["row_id"].tolist(), pdf["event"].tolist()):
            new, failures = move(current, failures, t, event)
            if new != current:
                rows.append((row_id, t, current, new))
                current = new
        out = pd.DataFrame(rows, columns=["row_id", "t", "old_state", "new_state"])
        out.insert(0, key, pdf[key].iloc[0])
        return out, [current, list(failures)]

    def build(pdf, _):
        """The chunk's first events, as long as earlier failures may count; then where the others lead from each state.

        Earlier failures count up to the first success, or until the chunk has ``threshold - 1`` failures of its own. Uploads after
        an upload change nothing.
        """
        head, rest = [], {x: x for x in ("CONNECTED", "AUTONOMOUS", "RECONNECTING")}
        own, failures, open_, known = 0, [], threshold > 1, False
        for t, event in zip(pdf["t"].tolist(), pdf["event"].tolist()):
            _, after = move("CONNECTED", failures, t, event)
            if open_:
                if event != "uploaded" or not head or head[-1][1] != "uploaded":
                    head.append([t, event])
                own += event == "failure"
                open_ = event != "success" and own < threshold - 1
            else:
                rest = {begun: move(current, failures, t, event)[0] for begun, current in rest.items()}
                known = known or event in ("success", "failure")
            failures = after
        return [head, rest, failures if known else None]

    def apply(summary, before):
        head, rest, own = summary
        current, failures = before
        for t, event in head:
            current, failures = move(current, failures, t, event)
        return [rest[current], failures if own is None else own]

    schema = f"{key} {key_type}, row_id bigint, t double, old_state string, new_state string"
    return Machine(step, schema, ["t", "row_id"], Jump(build, apply, ["t", "event"]))


def thermal_states(
    key: str, key_type: str, limit: float = 85.0, recovery_s: float = 60.0, restart_on_heat: bool = True
) -> Machine:
    """Protection goes on above the limit and off after ``recovery_s`` at or below it.

    With ``restart_on_heat=False`` a hot reading in between does not restart the recovery time.
    """
    def step(pdf, state):
        active, since = (state or [False, None])
        rows = []
        for t, row_id, temp in zip(pdf["t"].tolist(), pdf["row_id"].tolist(), pdf["temperature"].tolist()):
            if temp > limit:
                if not active:
                    active, since = True, None
                    rows.append((row_id, t, "THERMAL_PROTECTION_ACTIVE"))
                elif restart_on_heat:
                    since = None
            elif active:
                if since is None:
                    since = t
                elif t - since >= recovery_s:
                    active, since = False, None
                    rows.append((row_id, t, "THERMAL_PROTECTION_LIFTED"))
        out = pd.DataFrame(rows, columns=["row_id", "t", "alert_type"])
        out.insert(0, key, pdf[key].iloc[0])
        return out, [active, since]

    def after(pdf, state):
        return step(pdf.assign(row_id=0, **{key: 0}), state)[1]

    def build(pdf, _):
        """Where the chunk leads when it is entered inactive, active without a recovery time, and active with each one.

        A recovery time counts until the first cool row that is late enough for it (or, where heat restarts it, until the first
        hot row). Times that are over at the same row lead to the same state: one entry ``[latest end, row, state]`` each.
        """
        pdf = pdf.reset_index(drop=True)
        cool = np.flatnonzero(~(pdf["temperature"] > limit).to_numpy())
        hot = np.flatnonzero((pdf["temperature"] > limit).to_numpy())
        ends = cool if not (restart_on_heat and len(hot)) else cool[cool < hot[0]]
        t = pdf["t"].to_numpy(dtype=float)
        # Only rows up to one recovery time after the first can end a recovery that began before the chunk.
        ends = ends[: int(np.searchsorted(t[ends], t[0] + recovery_s, side="left")) + 1] if len(ends) else ends
        lifted, known = [], {}
        for i in ends[::-1].tolist():
            following = hot[hot > i][:1]
            begun = int(following[0]) if len(following) else len(pdf)
            if begun not in known:
                known[begun] = after(pdf.iloc[begun:], [False, None]) if begun < len(pdf) else [False, None]
            lifted.append([float(t[i]), known[begun]])
        kept = after(pdf.iloc[hot[0] :], [True, None]) if restart_on_heat and len(hot) else None
        return [after(pdf, [False, None]), after(pdf, [True, None]), lifted[::-1], kept]

    def apply(summary, before):
        inactive, fresh, lifted, kept = summary
        active, since = before
        if not active or since is None:
            return fresh if active else inactive
        for ended, state in lifted:
            if ended - since >= recovery_s:
                return state
        return kept or [True, since]

    schema = f"{key} {key_type}, row_id bigint, t double, alert_type string"
    return Machine(step, schema, ["t", "row_id"], Jump(build, apply, ["t", "temperature"]))


def exponential_average(key: str, key_type: str, alpha: float, start: float | None = None) -> Machine:
    """``(1 - alpha) * before + alpha * x`` after every row; without ``start`` the first value begins."""
    def step(pdf, state):
        before = start if state is None else state
        x = pdf["value"].to_numpy(dtype=float)
        line = x if before is None else np.concatenate([[before], x])
        mean = pd.Series(line).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(line) - len(x):]
        out = pd.DataFrame({key: pdf[key].to_numpy(), "row_id": pdf["row_id"].to_numpy(), "average": mean})
        return out, float(mean[-1])

    def build(pdf, state):
        """The chunk as ``gain * before + own``, from what it gives from nothing."""
        gain = (1 - alpha) ** len(pdf)
        return [gain, state - gain * (float(pdf["value"].iloc[0]) if start is None else start)]

    def apply(summary, before):
        return summary[0] * before + summary[1]

    return Machine(step, f"{key} {key_type}, row_id bigint, average double", ["t", "row_id"], Jump(build, apply, ["value"]))


def adaptive_anomalies(
    key: str, key_type: str, z_limit: float = 3.5, spike: float = 8.0, flat: float = 0.001,
    flat_samples: int = 100, alpha: float = 0.01,
) -> Machine:
    """Deviation, spike or flat line against a baseline that only clean windows move; the first hit counts.

    Input per window: ``n``, ``mean``, ``max_delta``, ``spread``, ``recent_delta`` (mean step of its newest samples).
    """
    def step(pdf, state):
        b_mean, b_std, b_delta, seen = state or [0.0, 0.0, 0.0, 0]
        rows = []
        columns = ["t", "row_id", "n", "mean", "max_delta", "spread", "recent_delta"]
        for t, row_id, n, mean, max_delta, spread, recent in zip(*[pdf[c].tolist() for c in columns]):
            if n < 10:
                continue
            z = abs(mean - b_mean) / b_std if b_std > 0 else 0.0
            if b_std > 0 and z > z_limit:
                rows.append((row_id, t, "z_score_violation", 1 if z < 5.0 else 2, min(1.0, z / 10.0)))
            elif b_delta > 0 and max_delta > b_delta * spike:
                rows.append((row_id, t, "rate_spike", 1, min(1.0, max_delta / (b_delta * 20))))
            elif n >= flat_samples and spread < flat:
                rows.append((row_id, t, "flatline", 1, 0.9))
            else:
                seen = min(seen + 1, 2)
                if seen == 1:
                    b_mean, b_std, b_delta = mean, 0.0, 0.0
                else:
                    b_mean = (1 - alpha) * b_mean + alpha * mean
                    b_std = (1 - alpha) * b_std + alpha * abs(mean - b_mean)
                    b_delta = (1 - alpha) * b_delta + alpha * recent
        out = pd.DataFrame(rows, columns=["row_id", "t", "anomaly_type", "severity", "confidence"])
        out.insert(0, key, pdf[key].iloc[0])
        return out, [b_mean, b_std, b_delta, seen]

    return Machine(
        step, f"{key} {key_type}, row_id bigint, t double, anomaly_type string, severity int, confidence double", ["t", "row_id"]
    )


def _metres(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Distances on the ground from one place to many."""
    p1, p2 = math.radians(lat), np.radians(lats)
    half = np.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * np.cos(p2) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * 6_371_000 * np.arctan2(np.sqrt(half), np.sqrt(1 - half))


def suppression(key: str, key_type: str, radius_m: float = 50.0, window_s: float = 600.0) -> Machine:
    """Defect alerts near an earlier one of their category are suppressed and name it.

    An alert is held against the open alerts first seen within ``window_s``;
    each alert that opens takes the rows near it at once, among those of its
    own and the two neighbouring latitude bands up to the window's end. Open
    alerts of one category lie more than ``radius_m`` apart, which bounds the
    state by the ground covered.
    Output: every row with ``original``, its own id when it is new.
    """
    band = radius_m / 111_000.0 * 1.01

    def step(pdf, state):
        # Open alerts in order of arrival: [t, lat, lon, row_id].
        t, lat, lon = (pdf[c].to_numpy(dtype=float) for c in ("t", "lat", "lon"))
        ids = pdf["row_id"].tolist()
        bands = np.floor(lat / band)
        by_band = np.argsort(bands, kind="stable")
        names, begins = np.unique(bands[by_band], return_index=True)
        members = dict(zip(names.tolist(), np.split(by_band, begins[1:])))
        free = np.ones(len(t), dtype=bool)
        originals = np.arange(len(t))  # below 0: an alert that was open before these rows
        old = [list(o) for o in state or []]

        def take(at, y, x, name, after):
            """Give the rows from ``after`` on that are near an alert and still free to it."""
            here = math.floor(y / band) if math.isfinite(y) else None
            for b in () if here is None else (here - 1, here, here + 1):
                rows = members.get(float(b))
                if rows is None:
                    continue
                rows = rows[np.searchsorted(rows, after):]
                rows = rows[: np.searchsorted(t[rows] - at, window_s, side="right")]
                rows = rows[free[rows]]
                rows = rows[_metres(y, x, lat[rows], lon[rows]) <= radius_m]
                free[rows], originals[rows] = False, name

        for n, (at, y, x, _) in enumerate(old):
            take(at, y, x, n - len(old), 0)
        opened, i = [], 0
        while i < len(t):
            i += int(free[i:].argmax())
            if not free[i]:
                break
            opened.append(i)
            if t[i] == t[i]:
                take(t[i], lat[i], lon[i], i, i + 1)
            i += 1
        now = float(t[-1])
        held = old + [[float(t[i]), float(lat[i]), float(lon[i]), ids[i]] for i in opened]
        left = sorted((o for o in held if now - o[0] <= window_s), key=lambda o: (o[0], o[3]))
        names = np.array([*ids, *(o[3] for o in old)], dtype=object)
        out = pd.DataFrame({key: pdf[key].to_numpy(), "row_id": ids, "original": names[originals].tolist()})
        return out, left

    return Machine(step, f"{key} {key_type}, row_id bigint, original bigint", ["t", "row_id"])


def kalman_level(key: str, key_type: str, q: float = 0.01, r: float = 0.1, x0: float = 0.0, p0: float = 1.0) -> Machine:
    """One-dimensional level filter."""
    def step(pdf, state):
        x, p = state or [x0, p0]
        line = []
        for z in pdf["value"].tolist():
            p += q
            gain = p / (p + r)
            x += gain * (z - x)
            p *= 1 - gain
            line.append(x)
        out = pd.DataFrame({key: pdf[key].to_numpy(), "t": pdf["t"].to_numpy(), "row_id": pdf["row_id"].to_numpy(), "filtered": line})
        return out, [x, p]

    def build(pdf, _):
        """The chunk as a map of any mean and variance: what it does to a level known exactly, and what it tells of that level."""
        x, p, a, eta, info = 0.0, 0.0, 1.0, 0.0, 0.0
        for z in pdf["value"].tolist():
            p += q
            s, y = p + r, z - x
            eta, info = eta + a * y / s, info + a * a / s
            gain = p / s
            x, a, p = x + gain * y, a * (1 - gain), p * (1 - gain)
        return [a, x, p, eta, info]

    def apply(summary, before):
        a, own, variance, eta, info = summary
        x, p = before
        shrink = 1 / (1 + p * info)
        return [a * shrink * (x + p * eta) + own, a * a * shrink * p + variance]

    return Machine(step, f"{key} {key_type}, t double, row_id bigint, filtered double", ["t", "row_id"], Jump(build, apply, ["value"]))


def kalman_motion(
    key: str, key_type: str, dt: float = 0.1, q_pos: float = 0.01, q_vel: float = 0.1, r_pos: float = 1.0,
    textbook: bool = True,
) -> Machine:
    """Position and velocity filter on position readings.

    ``textbook=False`` updates the second covariance row with the already updated first one.
    """
    def step(pdf, state):
        pos, vel, a, b, c, d = state or [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]
        rows = []
        for z in pdf["value"].tolist():
            pos += vel * dt
            a, b, c, d = a + dt * (c + b) + dt * dt * d + q_pos, b + dt * d, c + dt * d, d + q_vel
            s = a + r_pos
            k0, k1 = a / s, c / s
            y = z - pos
            pos, vel = pos + k0 * y, vel + k1 * y
            a_new, b_new = a - k0 * a, b - k0 * b
            c, d = (c - k1 * a, d - k1 * b) if textbook else (c - k1 * a_new, d - k1 * b_new)
            a, b = a_new, b_new
            rows.append((pos, vel))
        out = pd.DataFrame(rows, columns=["position", "velocity"])
        out.insert(0, "row_id", pdf["row_id"].to_numpy())
        out.insert(0, key, pdf[key].to_numpy())
        return out, [pos, vel, a, b, c, d]

    def build(pdf, _):
        """As for the level: ``m`` carries the entering position and velocity to the row before, for readings that know them exactly."""
        pos = vel = a = b = d = 0.0
        m00, m01, m10, m11 = 1.0, 0.0, 0.0, 1.0
        e0 = e1 = j00 = j01 = j11 = 0.0
        for z in pdf["value"].tolist():
            pos += vel * dt
            m00, m01 = m00 + dt * m10, m01 + dt * m11
            a, b, d = a + 2 * dt * b + dt * dt * d + q_pos, b + dt * d, d + q_vel
            s, y = a + r_pos, z - pos
            e0, e1 = e0 + m00 * y / s, e1 + m01 * y / s
            j00, j01, j11 = j00 + m00 * m00 / s, j01 + m00 * m01 / s, j11 + m01 * m01 / s
            k0, k1 = a / s, b / s
            pos, vel = pos + k0 * y, vel + k1 * y
            m00, m01, m10, m11 = m00 - k0 * m00, m01 - k0 * m01, m10 - k1 * m00, m11 - k1 * m01
            a, b, d = a - k0 * a, b - k0 * b, d - k1 * b
        return [[[m00, m01], [m10, m11]], [pos, vel], [[a, b], [b, d]], [e0, e1], [[j00, j01], [j01, j11]]]

    def apply(summary, before):
        m, own, variance, eta, info = (np.array(x) for x in summary)
        mean, p = np.array(before[:2]), np.array(before[2:]).reshape(2, 2)
        lead = m @ np.linalg.inv(np.eye(2) + p @ info)
        after = lead @ p @ m.T + variance
        return [*(lead @ (mean + p @ eta) + own).tolist(), *after.ravel().tolist()]

    schema = f"{key} {key_type}, row_id bigint, position double, velocity double"
    # Only the textbook update is a least-squares estimate, which the map of a chunk rests on.
    return Machine(step, schema, ["t", "row_id"], Jump(build, apply, ["value"]) if textbook else None)


def feature_windows(
    key: str, key_type: str, features: list[str], size: int = 1800, longest_gap_s: float = 300.0
) -> Machine:
    """Per-asset windows of ``size`` rows with gap filling, in the order of arrival.

    Readings not later than the last one are dropped; a gap is filled by
    linear steps; when the fill overflows, the oldest rows go and the window
    is emitted and emptied once. Only the rows of the open window are state.
    Output: one row per window with mean features, the share of filled rows
    (which can pass 100) and the closing time.
    """
    def step(pdf, state):
        buffer, filled = ([list(r) for r in state[0]], state[1]) if state else ([], 0)
        rows = []
        for record in zip(pdf["t"].tolist(), *[pdf[f].tolist() for f in features]):
            t, vector = record[0], list(record[1:])
            if buffer:
                last_t, last = buffer[-1][0], buffer[-1][1:]
                gap = t - last_t
                if gap <= 0:
                    continue
                if gap > longest_gap_s:
                    n = min(int(round(gap)) - 1, size - 1)
                    for i in range(1, n + 1):
                        w = i / (n + 1)
                        buffer.append([last_t + i * (gap / (n + 1))] + [(1 - w) * a + w * b for a, b in zip(last, vector)])
                        filled += 1
            buffer.append([t] + vector)
            buffer = buffer[-size:]
            if len(buffer) == size:
                means = np.array(buffer, dtype=float)[:, 1:].mean(axis=0).tolist()
                rows.append((t, filled / size * 100.0, *means))
                buffer, filled = [], 0
        out = pd.DataFrame(rows, columns=["t", "interpolation_pct", *[f"mean_{f}" for f in features]])
        out.insert(0, key, pdf[key].iloc[0])
        return out, [buffer, filled]

    means = ", ".join(f"mean_{f} double" for f in features)
    return Machine(step, f"{key} {key_type}, t double, interpolation_pct double, {means}", ["t", "row_id"])


def failure_counter(key: str, key_type: str, threshold: int = 3) -> Machine:
    """Consecutive failures; fires at the threshold and starts again. Input column ``failed``."""
    def step(pdf, state):
        count = state or 0
        rows = []
        for t, row_id, failed in zip(pdf["t"].tolist(), pdf["row_id"].tolist(), pdf["failed"].tolist()):
            count = count + 1 if failed else 0
            if count >= threshold:
                rows.append((row_id, t))
                count = 0
        out = pd.DataFrame(rows, columns=["row_id", "t"])
        out.insert(0, key, pdf[key].iloc[0])
        return out, count

    def build(pdf, state):
        """Whether a success sets the count, and what the chunk adds to it or leaves."""
        failed = pdf["failed"].to_numpy(dtype=bool)
        return [not failed.all(), int(state) if not failed.all() else len(failed)]

    def apply(summary, before):
        fixed, count = summary
        return count if fixed else (before + count) % threshold

    return Machine(step, f"{key} {key_type}, row_id bigint, t double", ["t", "row_id"], Jump(build, apply, ["failed"]))


def acknowledged_buffer(key: str, key_type: str, id_type: str, size: int = 864_000) -> Machine:
    """A buffer of at most ``size`` unacknowledged events per node, in the order of arrival.

    Input: ``t``, ``row_id``, ``kind`` (write or ack), ``event_id``, ``ts`` (the event's own time). A write into a full buffer
    first evicts the event with the earliest ``ts``, the first to arrive of equal ones; then it is stored unless its id is
    there. An acknowledgement removes its event. Output: each row with its ``outcome`` (stored, ignored, acked, unknown),
    the event it ``evicted`` (see overflow_log), and the number ``pending`` after it.
    """
    def step(pdf, state):
        held = {entry[3]: tuple(entry) for entry in state or []}
        queue = sorted(held.values())
        rows = []
        for t, row_id, kind, event_id, ts in zip(*[pdf[c].tolist() for c in ("t", "row_id", "kind", "event_id", "ts")]):
            evicted = None
            if kind == "ack":
                outcome = "acked" if held.pop(event_id, None) else "unknown"
            else:
                while len(held) >= size and evicted is None:
                    entry = heapq.heappop(queue)
                    if held.get(entry[3]) == entry:  # others were acknowledged before
                        evicted = entry[3]
                        del held[evicted]
                outcome = "ignored" if event_id in held else "stored"
                if outcome == "stored":
                    held[event_id] = (ts, t, row_id, event_id)
                    heapq.heappush(queue, held[event_id])
            rows.append((row_id, t, event_id, outcome, evicted, len(held)))
        out = pd.DataFrame(rows, columns=["row_id", "t", "event_id", "outcome", "evicted", "pending"])
        if pd.api.types.is_numeric_dtype(pdf["event_id"]):
            out["evicted"] = out["evicted"].astype("Int64")
        out.insert(0, key, pdf[key].iloc[0])
        return out, [list(x) for x in sorted(held.values())]

    schema = f"{key} {key_type}, row_id bigint, t double, event_id {id_type}, outcome string, evicted {id_type}, pending bigint"
    return Machine(step, schema, ["t", "row_id"])


def overflow_log(log: DataFrame, key: str) -> DataFrame:
    """The events that writes into a full buffer evicted, and when."""
    return log.filter(F.col("evicted").isNotNull()).select(key, F.col("evicted").alias("event_id"), F.col("t").alias("evicted_at"))


def sliding_evidence(key: str, key_type: str, size: int = 60, stride: int = 10) -> Machine:
    """Sliding windows of traffic rows with their raw messages, for scoring and as evidence.

    Input: ``features`` (array) and ``raw``. Output per full window: the
    stacked features and the raw messages.
    """
    def step(pdf, state):
        held = list(state or [])
        rows = []
        for t, row_id, features, raw in zip(*[pdf[c].tolist() for c in ("t", "row_id", "features", "raw")]):
            held.append([[float(x) for x in features], raw])
            if len(held) == size:
                rows.append((row_id, t, [h[0] for h in held], [h[1] for h in held]))
                held = held[stride:]
        out = pd.DataFrame(rows, columns=["row_id", "t", "window", "evidence"])
        out.insert(0, key, pdf[key].iloc[0])
        return out, held

    return Machine(
        step, f"{key} {key_type}, row_id bigint, t double, window array<array<double>>, evidence array<string>", ["t", "row_id"]
    )


def silence_alerts(key: str, key_type: str, seconds: float = 10.0) -> Machine:
    """Feed silence seen at the next message: one row per gap of at least ``seconds``."""
    def step(pdf, state):
        rows, last = [], state
        for t, row_id in zip(pdf["t"].tolist(), pdf["row_id"].tolist()):
            if last is not None and t - last[0] >= seconds:
                rows.append((last[1], last[0], t - last[0]))
            last = [t, row_id]
        out = pd.DataFrame(rows, columns=["row_id", "t", "silent_s"])
        out.insert(0, key, pdf[key].iloc[0])
        return out, last

    return Machine(step, f"{key} {key_type}, row_id bigint, t double, silent_s double", ["t", "row_id"])
