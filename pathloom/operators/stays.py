"""Stops and trips of moving devices from noisy pings."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.common import US, micros
from pathloom.operators.pieces import group_starts, whole_groups, with_pieces

#: A recording is decoded in pieces of so many counter steps, each with this many steps of its neighbours for context.
PIECE, CONTEXT = 8192, 256
#: Recordings decoded side by side, and pings that a batch of them holds, about.
BATCH_PIECES, BATCH_PINGS = 256, 120_000
#: Elements whose recordings are put together at once, about.
LEG_ELEMENTS = 20_000


@dataclass(frozen=True)
class StayRules:
    """Lengths in metres, times in seconds, speeds in metres a second."""

    stop_s: float = 300.0
    place_m: float = 50.0
    split_s: float = 900.0
    split_m: float = 300.0
    #: A silence from which the smoother starts anew and only the displacement counts.
    silent_s: float = 120.0
    #: A fix this far off its neighbours, or this inaccurate, is wild.
    wild_m: float = 100.0
    wild_accuracy_m: float = 150.0
    wild_speed: float = 25.0
    #: Noise of a fix without an accuracy, of one per metre of accuracy, and of the acceleration (m2/s3).
    fix_m: float = 6.0
    fix_share: float = 0.6
    jerk: float = 0.6
    #: A fix this many deviations off the prediction is left out, at most twice in a row.
    gate: float = 5.0
    #: The two states: speed noise when stationary; mean and spread when moving; mean times in each.
    still: float = 0.45
    ride: tuple[float, float] = (4.5, 2.5)
    mean_s: tuple[float, float] = (400.0, 400.0)
    #: Device speeds: mean when stationary, share that is false, and the range they are believed in.
    device_still: float = 0.25
    false_share: float = 0.03
    device_most: float = 31.3
    #: Between two parts of one stop the device may seem to move for so long.
    blip_s: float = 90.0


def wild_fixes(t: np.ndarray, x: np.ndarray, y: np.ndarray, acc: np.ndarray, r: StayRules) -> np.ndarray:
    """Single fixes far from where the device is before and after them."""
    n = len(t)
    wild = acc > r.wild_accuracy_m
    for _ in range(2):  # again without those found
        k = np.flatnonzero(~wild)
        if len(k) < 3:
            return wild
        step = np.hypot(np.diff(x[k]), np.diff(y[k]))
        over = np.hypot(x[k][2:] - x[k][:-2], y[k][2:] - y[k][:-2])
        least = np.minimum(step[:-1], step[1:])
        found = np.zeros(len(k), bool)
        found[1:-1] = (least > r.wild_m) & (over < 0.4 * least)
        speed = step / np.maximum(np.diff(t[k]), 1.0)
        found[0] = step[0] > r.wild_m and speed[0] > r.wild_speed and speed[1] < r.wild_speed
        found[-1] = step[-1] > r.wild_m and speed[-1] > r.wild_speed and speed[-2] < r.wild_speed
        if not found.any():
            break
        wild[k[found]] = True
    return wild if n else wild


def in_order(t: np.ndarray) -> np.ndarray:
    """The most clock values that are in order: a longest non-decreasing subsequence. One that jumps ahead or back is not believed."""
    ok = np.ones(len(t), bool)
    if len(t) < 2 or (np.diff(t) >= 0).all():
        return ok
    ends, last, before = [], [], np.full(len(t), -1)
    for i, v in enumerate(t.tolist()):
        k = bisect.bisect_right(ends, v)
        before[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(v)
            last.append(i)
        else:
            ends[k], last[k] = v, i
    ok[:] = False
    i = last[-1]
    while i >= 0:
        ok[i] = True
        i = before[i]
    return ok


def smooth(t: np.ndarray, x: np.ndarray, y: np.ndarray, var: np.ndarray, on: np.ndarray, r: StayRules) -> tuple[np.ndarray, ...]:
    """Kalman filter and smoother (position and speed, constant speed with random acceleration) of many tracks side by side.

    All arrays are (steps, tracks); `on` says where a track has a fix. Gives smoothed x, y, speed, and where a fix was used.
    """
    steps, tracks = t.shape
    state = np.zeros((steps, 4, tracks))  # x, vx, y, vy
    cov = np.zeros((steps, 3, tracks))  # of position, of both, of speed: the same for both axes
    ahead, ahead_cov = np.zeros_like(state), np.zeros_like(cov)
    linked = np.zeros((steps, tracks), bool)
    used = np.zeros((steps, tracks), bool)
    s, p = np.stack([x[0], np.zeros(tracks), y[0], np.zeros(tracks)]), np.stack([var[0], np.zeros(tracks), np.full(tracks, 9.0)])
    state[0], cov[0], used[0] = s, p, on[0]
    missed = np.zeros(tracks, np.int64)
    for i in range(1, steps):
        dt = np.where(on[i], t[i] - t[i - 1], 0.0)
        far = dt >= r.silent_s
        dt = np.where(far, 0.0, dt)
        q = r.jerk
        a0, a1, a2 = p[0] + dt * (2 * p[1] + dt * p[2]) + q * dt**3 / 3, p[1] + dt * p[2] + q * dt**2 / 2, p[2] + q * dt
        f = np.stack([s[0] + dt * s[1], s[1], s[2] + dt * s[3], s[3]])
        ahead[i], ahead_cov[i] = f, np.stack([a0, a1, a2])
        ex, ey, total = x[i] - f[0], y[i] - f[2], a0 + var[i]
        off = (ex * ex + ey * ey > 2 * r.gate**2 * total) & on[i]
        missed = np.where(off, missed + 1, np.where(on[i], 0, missed))
        fresh = on[i] & (far | (missed > 2))
        missed = np.where(fresh, 0, missed)
        take = on[i] & ~off & ~fresh
        g0, g1 = np.where(take, a0 / total, 0.0), np.where(take, a1 / total, 0.0)
        zero = np.zeros(tracks)
        s = np.stack([
            np.where(fresh, x[i], f[0] + g0 * ex), np.where(fresh, zero, f[1] + g1 * ex),
            np.where(fresh, y[i], f[2] + g0 * ey), np.where(fresh, zero, f[3] + g1 * ey),
        ])
        p = np.stack([np.where(fresh, var[i], (1 - g0) * a0), np.where(fresh, zero, (1 - g0) * a1), np.where(fresh, 9.0, a2 - g1 * a1)])
        state[i], cov[i], used[i], linked[i] = s, p, take | fresh, ~fresh
    for i in range(steps - 2, -1, -1):
        dt = np.where(linked[i + 1] & on[i + 1], t[i + 1] - t[i], 0.0)
        p0, p1, p2 = cov[i]
        a0, a1, a2 = ahead_cov[i + 1]
        det = np.maximum(a0 * a2 - a1 * a1, 1e-9)
        b0, b1 = p0 + dt * p1, p1 + dt * p2  # covariance of now with the next position; with the next speed it is p1, p2
        c00, c01 = (b0 * a2 - p1 * a1) / det, (p1 * a0 - b0 * a1) / det
        c10, c11 = (b1 * a2 - p2 * a1) / det, (p2 * a0 - b1 * a1) / det
        d = np.where(linked[i + 1] & on[i + 1], state[i + 1] - ahead[i + 1], 0.0)
        state[i] += np.stack([c00 * d[0] + c01 * d[1], c10 * d[0] + c11 * d[1], c00 * d[2] + c01 * d[3], c10 * d[2] + c11 * d[3]])
    return state[:, 0], state[:, 2], np.hypot(state[:, 1], state[:, 3]), used


def decode(dt: np.ndarray, moved: np.ndarray, speed: np.ndarray, device: np.ndarray, on: np.ndarray, r: StayRules) -> np.ndarray:
    """Viterbi path of the intervals between fixes, many tracks side by side: True where moving. Arrays are (intervals, tracks); device is NaN where unknown."""
    mean, spread = r.ride
    still = -0.5 * (speed / r.still) ** 2 - np.log(r.still)
    ride = -0.5 * (np.minimum(speed - mean, 2 * spread) / spread) ** 2 - np.log(spread)
    known = ~np.isnan(device)
    v = np.where(known, device, 0.0)
    noise = r.false_share / 40.0
    of_still = np.log((1 - r.false_share) / r.device_still * np.exp(-v / r.device_still) + noise)
    of_ride = np.log((1 - r.false_share) * 0.4 / spread * np.exp(-0.5 * ((v - mean) / spread) ** 2) + noise)
    still, ride = still + np.where(known, of_still, 0.0), ride + np.where(known, of_ride, 0.0)
    # over a silence only the way made counts
    far = dt >= r.silent_s
    near = moved <= r.place_m
    still, ride = np.where(far, np.where(near, 0.0, -60.0), still), np.where(far, np.where(near, -8.0, 0.0), ride)
    still, ride = np.where(on, still, 0.0), np.where(on, ride, 0.0)
    n, tracks = dt.shape
    back = np.zeros((n, 2, tracks), bool)
    s, m = still[0].copy(), ride[0].copy()
    gap = np.minimum(dt, r.silent_s)
    for i in range(1, n):
        step = 0.5 * (gap[i] + gap[i - 1])
        leave_s, leave_m = -np.expm1(-step / r.mean_s[0]) / 2, -np.expm1(-step / r.mean_s[1]) / 2
        ss, sm = s + np.log1p(-leave_s), m + np.log(leave_m + 1e-12)
        ms, mm = s + np.log(leave_s + 1e-12), m + np.log1p(-leave_m)
        off = ~on[i]
        back[i, 0], back[i, 1] = (sm > ss) & ~off, (mm >= ms) | off
        s, m = np.where(off, s, np.maximum(ss, sm) + still[i]), np.where(off, m, np.maximum(ms, mm) + ride[i])
    out = np.zeros((n, tracks), bool)
    now = m > s
    for i in range(n - 1, -1, -1):
        out[i] = now
        now = np.where(now, back[i, 1], back[i, 0])
    return out


def _decoded(pieces: list[dict], r: StayRules) -> Iterator[pd.DataFrame]:
    """Elements of recordings: maximal runs of intervals of one state, within each piece's own part."""
    tracks = []
    for g in pieces:
        k = np.flatnonzero(~wild_fixes(g["t"], g["x"], g["y"], g["acc"], r))
        tracks.append({n: v[k] if isinstance(v, np.ndarray) else v for n, v in g.items()})
    tracks.sort(key=lambda g: len(g["t"]))
    out = []
    for at in range(0, len(tracks), 64):
        group = tracks[at : at + 64]
        steps = max(2, max(len(g["t"]) for g in group))
        shape = (steps, len(group))
        on = np.zeros(shape, bool)
        a = {n: np.zeros(shape) for n in ("t", "x", "y", "v")}
        var = np.full(shape, r.fix_m**2)
        for j, g in enumerate(group):
            n = len(g["t"])
            on[:n, j] = True
            for c in a:
                a[c][:n, j] = g[c]
                a[c][n:, j] = g[c][-1] if n else 0.0
            acc = g["acc"]
            var[:n, j] = np.where(np.isnan(acc), r.fix_m, np.clip(acc * r.fix_share, 3.0, 60.0)) ** 2
        x, y, speed, used = smooth(a["t"], a["x"], a["y"], var, on, r)
        dt = np.diff(a["t"], axis=0)
        moved = np.hypot(np.diff(x, axis=0), np.diff(y, axis=0))
        v = np.where((a["v"] >= 0) & (a["v"] <= r.device_most), a["v"], np.nan)
        known = ~np.isnan(v)
        count = known[1:].astype(int) + known[:-1]
        device = np.where(count > 0, (np.where(known[1:], v[1:], 0) + np.where(known[:-1], v[:-1], 0)) / np.maximum(count, 1), np.nan)
        moving = decode(dt, moved, (speed[1:] + speed[:-1]) / 2, device, on[1:], r)
        for j, g in enumerate(group):
            n = len(g["t"])
            own = np.flatnonzero(g["own"])
            if not len(own):
                continue
            # intervals that end in the own part; a recording's first piece begins with its first fix
            first, last = max(own[0], 1), own[-1]
            tx, ty, tt = x[:n, j], y[:n, j], g["t"]
            if n == 1 or last < first:
                out.append((g["rec"], g["piece"], 0, 0, tt[own[0]], tt[own[0]], tx[own[0]], ty[own[0]], tx[own[0]], ty[own[0]], tx[own[0]], ty[own[0]], 0.0, 0.0, 1))
                continue
            i = np.arange(first, last + 1)
            state = moving[i - 1, j].astype(np.int64)
            way, gap = moved[i - 1, j], dt[i - 1, j]
            state[(gap >= r.split_s) & (way > r.split_m)] = 2
            cuts = np.flatnonzero(np.diff(state)) + 1
            for a0, b0 in zip([0, *cuts], [*cuts, len(i)]):
                f, e = i[a0] - 1, i[b0 - 1]
                cx, cy = np.median(tx[f : e + 1]), np.median(ty[f : e + 1])
                reach = float(np.hypot(tx[f : e + 1] - cx, ty[f : e + 1] - cy).max())
                out.append((g["rec"], g["piece"], a0, int(state[a0]), tt[f], tt[e], tx[f], ty[f], tx[e], ty[e], cx, cy, reach, float(way[a0:b0].sum()), e - f + 1))
    yield pd.DataFrame(out, columns=_ELEMENT_COLUMNS)


_ELEMENT_COLUMNS = ["rec", "piece", "k", "state", "t0", "t1", "x0", "y0", "x1", "y1", "cx", "cy", "reach", "way", "n"]
_ELEMENTS = "rec bigint, piece bigint, k int, state int, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double, cx double, cy double, reach double, way double, n bigint"


def _elements(r: StayRules):
    columns = ("t", "x", "y", "v", "acc")

    def whole(frame: pd.DataFrame) -> list[dict]:
        """The pieces of a frame as arrays; rows of one counter value count once."""
        frame = frame.drop_duplicates(["rec", "piece", "seq"])
        arrays = {c: frame[c].to_numpy(float) for c in columns} | {"own": frame["own"].to_numpy(bool)}
        rec, piece, starts = frame["rec"].to_numpy(), frame["piece"].to_numpy(), group_starts(frame, ["rec", "piece"])
        out = []
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            t = arrays["t"][a:b]
            ok = in_order(t)
            out.append({n: v[a:b][ok] for n, v in arrays.items()} | {"rec": int(rec[a]), "piece": int(piece[a])})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: list[dict] = []
        for frame in whole_groups(batches, ["rec", "piece"], BATCH_PINGS // 8):
            pieces += whole(frame)
            if len(pieces) >= BATCH_PIECES or sum(len(g["t"]) for g in pieces) >= BATCH_PINGS:
                yield from _decoded(pieces, r)
                pieces = []
        if pieces:
            yield from _decoded(pieces, r)

    return run


def legs_of(rows: list, r: StayRules) -> list[tuple]:
    """Stops and trips of one recording from its elements (named tuples) in order: (kind, start, end, metres, x, y)."""
    # stays: stationary elements of one place, whatever lies between them at that place or is over soon
    stays: list[dict] = []
    for i, s in enumerate(rows):
        if s.state != 0:
            continue
        last = stays[-1] if stays else None
        if last is not None and np.hypot(s.cx - last["x"], s.cy - last["y"]) <= r.place_m:
            between = rows[last["i"] + 1 : i]
            reach = max((np.hypot(b.cx - last["x"], b.cy - last["y"]) + b.reach for b in between), default=0.0)
            if all(b.state != 2 for b in between) and (reach <= r.place_m or s.t0 - last["t1"] <= r.blip_s):
                w, v = last["n"], s.n
                last.update(t1=s.t1, i=i, x=(last["x"] * w + s.cx * v) / (w + v), y=(last["y"] * w + s.cy * v) / (w + v), n=w + v)
                continue
        stays.append({"t0": s.t0, "t1": s.t1, "i0": i, "i": i, "x": s.cx, "y": s.cy, "n": s.n, "reach": s.reach})
    stops = [s for s in stays if s["t1"] - s["t0"] >= r.stop_s]
    out: list[tuple] = []

    def trips(a: int, b: int, near: list[dict]) -> None:
        """Riding among the elements a..b-1, cut at long silences."""
        part: list = []
        for el in [*rows[a:b], None]:
            if el is None or el.state == 2:
                if part:
                    pts = [(p.x0, p.y0) for p in part] + [(p.x1, p.y1) for p in part] + [(p.cx, p.cy) for p in part]
                    xs, ys = np.array(pts).T
                    extent = max([np.hypot(xs - xs[0], ys - ys[0]).max()] + [p.reach for p in part if p.state == 1])
                    away = min((max(np.hypot(xs - s["x"], ys - s["y"]).max(), 0.0) for s in near), default=np.inf)
                    if extent > r.place_m and away > r.place_m and any(p.state == 1 for p in part):
                        out.append(("trip", part[0].t0, part[-1].t1, sum(p.way for p in part), part[0].x0, part[0].y0))
                part = []
            else:
                part.append(el)

    at = 0
    for n, s in enumerate(stops):
        trips(at, s["i0"], stops[max(0, n - 1) : n + 1])
        out.append(("stop", s["t0"], s["t1"], 0.0, s["x"], s["y"]))
        at = s["i"] + 1
    trips(at, len(rows), stops[-1:])
    return out


def _legs(r: StayRules):
    def give(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        every, starts = list(frame.itertuples(index=False)), group_starts(frame, ["rec"])
        for a, b in zip(starts, [*starts[1:], len(every)]):
            count = {"stop": 0, "trip": 0}
            for kind, t0, t1, way, x, y in legs_of(every[a:b], r):
                count[kind] += 1
                out.append((every[a].rec, kind, count[kind], t0, t1, way, x, y))
        return pd.DataFrame(out, columns=["rec", "kind", "leg_no", "t0", "t1", "metres", "x", "y"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["rec"], LEG_ELEMENTS):
            yield give(frame)

    return run


def stops_and_trips(
    pings: DataFrame, recording: str, counter: str, at: str, x: str, y: str, speed: str, accuracy: str,
    to_metres: float = 0.3048, to_mps: float = 0.44704, accept: Column | None = None, rules: StayRules = StayRules(),
) -> DataFrame:
    """Stops and trips of every recording: recording, kind ('stop' or 'trip'), leg_no, started, ended, duration_s, metres, x, y.

    x, y and accuracy are in units of to_metres, speed in units of to_mps. leg_no counts from 1 in time order, per recording and kind. metres is
    the smoothed way of a trip; x, y the place of a stop or the start of a trip.

    Defined cases: pings with a null recording, counter, time, or position, or refused by `accept` (faulty clocks), are not used; repeated
    rows, and rows of one counter value, count once; a null, NaN, negative or huge speed and a null accuracy are unknown; pings whose clock
    contradicts most others' order are not used; a recording with one usable ping has no legs; an empty table gives an empty
    result; other columns are ignored.

    Method: wild single fixes are left out; a Kalman smoother gives position and speed; a two-state hidden Markov model on the intervals between
    fixes, with smoothed and device speeds as emissions and dwell times as transitions, is decoded into moving and stationary runs; silences
    count by the way made over them and, long enough and far enough, split trips. Stationary runs of one place make stops.

    Scale: one shuffle of the pings by (recording, piece). Long recordings are decoded in pieces with context on both sides, so no task holds a whole hot
    recording; only their runs, some tens per thousand pings, meet per recording. Recordings of a task are smoothed and decoded side by side.
    """
    ok = F.col(recording).isNotNull() & F.col(counter).isNotNull() & F.col(at).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()
    ok = ok & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    if accept is not None:
        ok = ok & accept
    rows = pings.where(ok).select(
        F.col(recording).cast("bigint").alias("rec"), F.col(counter).cast("bigint").alias("seq"), (micros(at) / F.lit(float(US))).alias("t"),
        (F.col(x) * to_metres).alias("x"), (F.col(y) * to_metres).alias("y"), (F.col(speed) * to_mps).cast("double").alias("v"),
        (F.col(accuracy) * to_metres).cast("double").alias("acc"),
    )
    rows = with_pieces(rows, "seq", PIECE, CONTEXT)
    elements = (
        rows.repartition("rec", "piece").sortWithinPartitions("rec", "piece", "seq", "t", "x", "y").mapInPandas(_elements(rules), _ELEMENTS)
    )
    legs = elements.repartition("rec").sortWithinPartitions("rec", "piece", "k").mapInPandas(
        _legs(rules), "rec bigint, kind string, leg_no int, t0 double, t1 double, metres double, x double, y double"
    )
    return legs.select(
        F.col("rec").alias(recording), "kind", "leg_no", F.timestamp_micros((F.col("t0") * US).cast("bigint")).alias("started"),
        F.timestamp_micros((F.col("t1") * US).cast("bigint")).alias("ended"), (F.col("t1") - F.col("t0")).alias("duration_s"), "metres",
        (F.col("x") / to_metres).alias("x"), (F.col("y") / to_metres).alias("y"),
    )
