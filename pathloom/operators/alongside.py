"""Segments that run along others: found from a few samples of each and by direction, measured without looking at every sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.sweeps import spans

#: Distances nearer to the buffer than this are decided sample by sample.
NEAR = 1e-6
#: Cells along a side of the tiles by which segments are sent; tasks cut them into cells.
TILE = 4
#: Pairs looked at at once (about 200 bytes each), and rows of whole cells.
AT_ONCE, ROWS = 60_000, 150_000
ENDS = ("ax", "ay", "bx", "by")


def share_along(base: DataFrame, key: str, other: DataFrame, other_key: str, buffer: float, every: float, share: float, angle: float) -> DataFrame:
    """The pairs of covered_share (key, other_key, share, angle) with at least a `share` above 0 and less than an `angle`; keys are unique.

    The samples of a base segment within the buffer of another are a row of neighbours, as what lies within a buffer of a segment is convex. A row long enough has one of
    every so-manieth sample, at most 1 / share of a segment: only those are looked up, in cells of the plane (segments are sent by tiles of many cells, as each crosses few), among the segments whose direction lets them stay within the buffer
    that long. The first sample of a pair that is looked up gives it; where the row begins and ends follows from the segments.
    """
    if not share > 0:
        raise ValueError("a share above 0 is needed")
    size, margin, wide = max(8.0 * buffer, every), buffer + 1e-3, buffer + NEAR
    cells = [("cx", pa.int64()), ("cy", pa.int64()), ("at", pa.int64())]
    kinds = {"key": base.schema[key].dataType, "other": other.schema[other_key].dataType}

    def batch(b: pa.RecordBatch, of: np.ndarray, *own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in own], *b.take(pa.array(of)).columns], [n for n, _ in cells] + b.schema.names)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                p = b.slice(i, 2000)
                yield p, np.stack([p.column(c).to_numpy() for c in ENDS])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ends in parts(batches):
            cx, cy, at, of = _samples(ends, b.column("n").to_numpy(), share, size)
            cx, cy = cx // TILE, cy // TILE
            # the samples of a segment in a tile follow one another
            k = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (of[1:] != of[:-1])])
            yield batch(b, of[k], cx[k], cy[k], at[k])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ends in parts(batches):
            cx, cy, of = _crossed(ends, size * TILE, margin)
            for i in range(0, len(cy), ROWS):
                some = slice(i, i + ROWS)
                yield batch(b, of[some], cx[some], cy[some], np.full(len(of[some]), -1))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles in _whole_cells(batches):
            for t in _cells(tiles, size, margin, share):
                for a, b, part, off in _pairs(t, buffer, wide, share, angle):
                    yield pa.RecordBatch.from_arrays([t["key"].combine_chunks().take(pa.array(a)), t["other"].combine_chunks().take(pa.array(b)), pa.array(part), pa.array(off)], ["key", "other", "share", "angle"])

    sound = " and ".join(f"abs({c}) < double('infinity')" for c in ENDS)
    line = lambda df, c, name: df.select(F.col(c).alias(name), *[F.col(x).cast("double").alias(x) for x in ENDS]).where(sound)
    text = lambda name: f"cx bigint, cy bigint, at bigint, {name} {kinds[name].simpleString()}, " + ", ".join(f"{c} double" for c in ENDS)
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / every)).cast("bigint")
    a = line(base, key, "key").withColumn("n", n).mapInArrow(looked_up, text("key") + ", n bigint")
    b = line(other, other_key, "other").mapInArrow(placed, text("other"))
    spark = base.sparkSession
    # tiles are few, each is much work
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    both = a.unionByName(b, allowMissingColumns=True).repartition(tasks, "cx", "cy").sortWithinPartitions("cx", "cy")
    out = both.mapInArrow(found, f"key {kinds['key'].simpleString()}, other {kinds['other'].simpleString()}, share double, angle double")
    return out.toDF(key, other_key, "share", "angle")


def _least(n: np.ndarray, share: float) -> np.ndarray:
    """Of how many neighbours among n samples one must be looked up."""
    return np.maximum(1, np.ceil(share * n - 1e-9)).astype(np.int64)


def _samples(ends: np.ndarray, n: np.ndarray, share: float, size: float) -> tuple[np.ndarray, ...]:
    """The samples of segments that are looked up: their cells, which sample and of which segment."""
    ax, ay, bx, by = ends
    need = _least(n, share)
    j, of = spans(np.zeros(len(n), np.int64), n // need)
    at = (j + 1) * need[of] - 1
    t = (at + 0.5) / n[of]
    x, y = ax[of] + (bx[of] - ax[of]) * t, ay[of] + (by[of] - ay[of]) * t
    return np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64), at, of


def _crossed(ends: np.ndarray, size: float, margin: float, inside: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """The cells that segments come within a margin of, and of which segment; `inside` a column of a tile of each, given by its least cell."""
    ax, ay, bx, by = ends

    def between(low: np.ndarray, high: np.ndarray, least: np.ndarray | None, many: int) -> tuple[np.ndarray, np.ndarray]:
        first, last = np.floor((low - margin) / size).astype(np.int64), np.floor((high + margin) / size).astype(np.int64) + 1
        if least is not None:
            first, last = np.maximum(first, least), np.minimum(last, least + many)
        return spans(first, np.maximum(first, last))

    cx, of = between(np.minimum(ax, bx), np.maximum(ax, bx), inside and inside[0], 1)
    dx, dy = (bx - ax)[of], (by - ay)[of]
    flat = np.abs(dx) < 1e-9
    run = np.where(flat, 1.0, dx)
    t = np.clip([np.where(flat, i, (x - ax[of]) / run) for i, x in ((0.0, cx * size - margin), (1.0, (cx + 1) * size + margin))], 0.0, 1.0)
    y = ay[of] + dy * t
    cy, to = between(y.min(axis=0), y.max(axis=0), inside and inside[1][of], TILE)
    return cx[to], cy, of[to]


def _cells(t: pa.Table, size: float, margin: float, share: float) -> Iterator[pa.Table]:
    """Tables of about ROWS rows with whole cells, sorted by them, of tables with whole tiles."""
    tx, ty, at = t["cx"].to_numpy(), t["cy"].to_numpy(), t["at"].to_numpy()
    ends = np.stack([t[c].to_numpy() for c in ENDS])
    mine, theirs = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    if not len(mine) or not len(theirs):
        return
    ax, ay, i, of = _samples(ends[:, mine], t["n"].to_numpy()[mine].astype(np.int64), share, size)
    here = np.flatnonzero((ax // TILE == tx[mine[of]]) & (ay // TILE == ty[mine[of]]))
    ax, ay, i, of = ax[here], ay[here], i[here], mine[of[here]]
    rest = t.drop_columns(["cx", "cy", "at"])
    # a column of the tiles after the other: what crosses all cells of a tile is many times its rows
    for column in range(TILE):
        k = np.flatnonzero(ax % TILE == column)
        if not len(k):
            continue
        cx, cy, to = _crossed(ends[:, theirs], size, margin, (tx[theirs] * TILE + column, ty[theirs] * TILE))
        cx, cy, at, row = np.r_[ax[k], cx], np.r_[ay[k], cy], np.r_[i[k], np.full(len(to), -1)], np.r_[of[k], theirs[to]]
        order = np.lexsort((cy, cx))
        cx, cy, at, row = cx[order], cy[order], at[order], row[order]
        cell = np.cumsum(np.r_[0, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
        cuts = np.unique(np.searchsorted(cell, cell[::ROWS]))
        for a, b in zip(cuts, np.r_[cuts[1:], len(cell)]):
            yield pa.Table.from_arrays([pa.array(v[a:b]) for v in (cx, cy, at)] + rest.take(pa.array(row[a:b])).columns, ["cx", "cy", "at", *rest.column_names])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ROWS rows, each with whole cells of the sorted rows."""
    held: list[pa.RecordBatch] = []
    size, most = 0, ROWS
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = (t["cx"].to_numpy() == t["cx"][-1].as_py()) & (t["cy"].to_numpy() == t["cy"][-1].as_py())
        start = int(np.argmax(last))
        if start:
            yield t.slice(0, start)
        held = t.slice(start).to_batches()
        size = t.num_rows - start
        most = max(ROWS, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(t: pa.Table, buffer: float, wide: float, share: float, angle: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of base and other segments, share and angle of the pairs that samples of these cells give."""
    at = t["at"].to_numpy()
    ax, ay, bx, by = (t[c].to_numpy() for c in ENDS)
    cx, cy = t["cx"].to_numpy(), t["cy"].to_numpy()
    cell = np.cumsum(np.r_[0, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])]) * 1000.0
    dx, dy = bx - ax, by - ay
    length = np.hypot(dx, dy)
    turn = np.degrees(np.arctan2(dy, dx))
    mine, theirs = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    if not len(mine) or not len(theirs):
        return
    # segments of a cell by direction; points have a place of their own
    place = cell[theirs] + np.where(length[theirs] == 0, 500.0, np.mod(turn[theirs], 180.0))
    by_place = np.argsort(place, kind="stable")
    place, theirs = place[by_place], theirs[by_place]
    qx, qy, ex, ey, el = ax[theirs], ay[theirs], dx[theirs], dy[theirs], length[theirs]
    e2 = ex * ex + ey * ey
    inv = np.divide(1.0, e2, out=np.zeros_like(e2), where=e2 > 0)
    # how far directions may differ: the samples of a row lie in a strip
    n = t["n"].to_numpy()[mine].astype(np.int64)
    need = _least(n, share)
    reach = (need - 1) * length[mine] / n
    most = np.degrees(np.arcsin(np.minimum(1.0, np.divide(2 * wide, reach, out=np.ones_like(reach), where=reach > 2 * wide)))) + 1e-5
    most = np.minimum(most, angle + 1e-5)
    way, own, every = np.mod(turn[mine], 180.0), cell[mine], most >= 89.9
    low, high = np.where(every, -1.0, way - most), np.where(every, 181.0, way + most)
    # the range itself, what of it is beyond one end or the other, and the points
    ranges = [(low, high), (np.where(every, 190.0, low + 180.0), 181.0), (-1.0, np.where(every, -2.0, high - 180.0)), (499.0, 501.0)]
    first, last = (np.concatenate([np.searchsorted(place, own + r[i], side) for r in ranges]) for i, side in ((0, "left"), (1, "right")))
    who = np.tile(np.arange(len(mine)), len(ranges))
    some = np.flatnonzero(last > first)
    first, last, who = first[some], last[some], who[some]
    # long ranges in parts
    k, of = spans(np.zeros(len(first), np.int64), -(-(last - first) // AT_ONCE))
    first, last, who = first[of] + k * AT_ONCE, np.minimum(last[of], first[of] + (k + 1) * AT_ONCE), who[of]
    total = np.cumsum(last - first)
    px, py, sx, sy, st = ax[mine], ay[mine], dx[mine], dy[mine], at[mine]

    def distance(m: np.ndarray, o: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of sample i of the m-th base segments from the o-th others, squared."""
        u = (i + 0.5) / n[m]
        x, y = px[m] + sx[m] * u - qx[o], py[m] + sy[m] * u - qy[o]
        v = np.clip((x * ex[o] + y * ey[o]) * inv[o], 0.0, 1.0)
        x, y = x - v * ex[o], y - v * ey[o]
        return x * x + y * y

    begin = 0
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, "right")))
        o, of = spans(first[begin:end], last[begin:end])
        m = who[begin:end][of]
        begin = end
        u = (st + 0.5) / n
        hx, hy = (px + sx * u)[m] - qx[o], (py + sy * u)[m] - qy[o]
        v = np.clip((hx * ex[o] + hy * ey[o]) * inv[o], 0.0, 1.0)
        hx, hy = hx - v * ex[o], hy - v * ey[o]
        k = np.flatnonzero(hx * hx + hy * hy <= (wide + NEAR) ** 2)
        m, o = m[k], o[k]
        # the sample looked up before this one gives the pair, if it is within the buffer
        before = st[m] - need[m]
        k = np.flatnonzero((before < 0) | (distance(m, o, np.maximum(before, 0)) > (buffer - NEAR) ** 2))
        m, o, before = m[k], o[k], before[k]
        if not len(m):
            continue
        off = np.mod(turn[mine[m]] - turn[theirs[o]], 180.0)
        off = np.minimum(off, 180.0 - off)
        low, high = _within(px[m] - qx[o], py[m] - qy[o], sx[m], sy[m], ex[o], ey[o], el[o], wide)
        c = n[m]
        low, high = (np.clip(x, -1, c) for x in (np.ceil(low * c - 0.5), np.floor(high * c - 0.5)))
        low, high = np.maximum(low, 0).astype(np.int64), np.minimum(high, c - 1).astype(np.int64)
        k = np.flatnonzero((off < angle) & (before < low) & (high >= low) & (high - low + 1 >= need[m]))
        m, o, off, low, high = m[k], o[k], off[k], low[k], high[k]
        sure = buffer - NEAR if buffer > NEAR else -1.0
        clear = (distance(m, o, low) <= sure * abs(sure)) & (distance(m, o, high) <= sure * abs(sure))
        count = high - low + 1
        for x in np.array_split(np.flatnonzero(~clear), -(-int(count[~clear].sum()) // AT_ONCE) or 1):
            i, of = spans(low[x], high[x] + 1)
            g, h = m[x][of], o[x][of]
            u = (i + 0.5) / n[g]
            # as point_to_segment has it
            hx, hy = px[g] + sx[g] * u, py[g] + sy[g] * u
            v = np.clip(np.divide((hx - qx[h]) * ex[h] + (hy - qy[h]) * ey[h], e2[h], out=np.zeros(len(h)), where=e2[h] > 0), 0.0, 1.0)
            count[x] = np.bincount(of, np.hypot(hx - (qx[h] + v * ex[h]), hy - (qy[h] + v * ey[h])) <= buffer, len(x)).astype(np.int64)
        part = count / n[m]
        k = np.flatnonzero((part >= share) & (count > 0))
        if len(k):
            yield mine[m[k]], theirs[o[k]], part[k], off[k]


def _within(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, ex: np.ndarray, ey: np.ndarray, el: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """From where to where (0 to 1 along a segment that begins at x, y and goes on by s) it lies within r of the segment from the origin to e, of length el; none: first after last."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = ex / el, ey / el
        out = []
        p, q = x * ux + y * uy, sx * ux + sy * uy
        w, z = x * uy - y * ux, sx * uy - sy * ux
        low, high = np.full(len(x), -np.inf), np.full(len(x), np.inf)
        for a, b, f, l in ((p, q, 0.0, el), (w, z, -r, r)):
            g, h = (f - a) / b, (l - a) / b
            still, inside = b == 0, (a >= f) & (a <= l)
            low = np.maximum(low, np.where(still, np.where(inside, -np.inf, np.inf), np.minimum(g, h)))
            high = np.minimum(high, np.where(still, np.where(inside, np.inf, -np.inf), np.maximum(g, h)))
        none = ~(el > 0) | ~(low <= high)
        out.append((np.where(none, np.inf, low), np.where(none, -np.inf, high)))
        a = sx * sx + sy * sy
        for cx, cy in ((x, y), (x - ex, y - ey)):
            b, c = sx * cx + sy * cy, cx * cx + cy * cy - r * r
            d = b * b - a * c
            root, none = np.sqrt(np.maximum(d, 0.0)), (d < 0) | (a == 0)
            out.append((np.where(none, np.inf, (-b - root) / a), np.where(none, -np.inf, (-b + root) / a)))
        low, high = np.minimum.reduce([o[0] for o in out]), np.maximum.reduce([o[1] for o in out])
    # a base segment that is a point has one sample, which was within reach
    low, high = np.where(a == 0, 0.0, low), np.where(a == 0, 1.0, high)
    return np.clip(low, -1.0, 2.0), np.clip(high, -1.0, 2.0)
