"""Lines as arrays of points: lengths, interpolation, routes, and the few measures that need Python (per batch, by Arrow)."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def line(*points: tuple[Column, Column]) -> Column:
    """A line from columns of coordinates."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def line_length(points: Column) -> Column:
    """Length of a line; 0 for fewer than two points."""
    legs = F.zip_with(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda q, p: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, d: s + d)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses another many times, which is only computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measures(points: Column) -> Column:
    """Distance along the line of each of its points."""
    steps = F.transform(points, lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(F.hypot(p["x"] - F.get(points, i - 1)["x"], p["y"] - F.get(points, i - 1)["y"])))
    return _once(steps, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i + 1), F.lit(0.0), lambda t, d: t + d)))


def _point_at(points: Column, m: Column, distance: Column) -> Column:
    """point_at with the measures at hand."""
    after = F.filter(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.get(m, i) >= distance)
    i = F.coalesce(F.get(after, F.lit(0)), F.size(points) - 1)

    def between(i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        leg = F.get(m, i) - F.get(m, i - 1)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((distance - F.get(m, i - 1)) / F.nullif(leg, F.lit(0.0)), F.lit(0.0))))
        return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

    return _once(i, between)


def point_at(points: Column, distance: Column) -> Column:
    """The point a distance along a line (its ends outside)."""
    return _once(measures(points), lambda m: _point_at(points, m, distance))


def points_every(points: Column, distance: float) -> Column:
    """The start and every point a distance farther along; for lines not longer than it only the two ends. Each line is measured once."""

    def along(m: Column) -> Column:
        total = F.coalesce(F.element_at(m, -1), F.lit(0.0))
        n = F.ceil(total / distance) - 1
        inner = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0).cast("bigint"))), lambda k: _point_at(points, m, k * distance))
        return F.when(total <= distance, F.array(F.get(points, F.lit(0)), F.get(points, F.size(points) - 1))).otherwise(inner)

    return _once(measures(points), along)


def route_line(lines: Column) -> Column:
    """Lines of a route in order, each already turned the way it is travelled, as one: shared points once."""
    return F.flatten(F.transform(lines, lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))))


def vertex_hausdorff(a: Column, b: Column) -> Column:
    """Hausdorff distance of two lines' vertices."""
    least = lambda p, other: F.array_min(F.transform(other, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))
    return F.greatest(F.array_max(F.transform(a, lambda p: least(p, b))), F.array_max(F.transform(b, lambda p: least(p, a))))


def grid_cells(west: float, south: float, east: float, north: float, size: float) -> tuple[list[float], list[float]]:
    """West and south edges of the cells that cover a box."""
    xs = np.arange(np.floor(west / size), np.floor(east / size) + 1) * size
    ys = np.arange(np.floor(south / size), np.floor(north / size) + 1) * size
    return xs.tolist(), ys.tolist()


# --- Python, batch by batch ----------------------------------------------------------------------------------


def _xy(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


@F.pandas_udf(T.DoubleType())
def name_ratio_pandas(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two names; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def frechet(p: np.ndarray, q: np.ndarray) -> float:
    """Discrete Frechet distance of two lines' vertices, row by row of the coupling table."""
    d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    row = np.maximum.accumulate(d[0])
    for i in range(1, len(p)):
        new = np.empty_like(row)
        new[0] = max(row[0], d[i, 0])
        step = np.minimum(row[1:], row[:-1])
        for j in range(1, len(q)):
            new[j] = max(min(step[j - 1], new[j - 1]), d[i, j])
        row = new
    return float(row[-1])


@F.pandas_udf(T.DoubleType())
def frechet_pandas(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None or not len(x) or not len(y) else frechet(_xy(x), _xy(y)) for x, y in zip(a, b)], dtype="float64")


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Ramer-Douglas-Peucker keeps."""
    keep = np.zeros(len(p), bool)
    if len(p):
        keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, b, m = p[i], p[j], p[i + 1 : j]
        v = b - a
        n = float(v @ v)
        t = np.clip((m - a) @ v / n, 0, 1) if n else np.zeros(len(m))
        off = np.hypot(*(m - a - t[:, None] * v).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify_pandas(tolerance: float):
    """A line without the points that lie within the tolerance of it."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [x for x, k in zip(p, simplified(_xy(p), tolerance)) if k] for p in lines])

    return run


#: Cells of a grid that are held at once.
BAND_CELLS = 4_000_000


def _near_line(p: np.ndarray, xs: np.ndarray, ys: np.ndarray, buffer: float) -> np.ndarray:
    """Which centres of a grid lie within a buffer of a line; only the cells around each segment are looked at."""
    mask = np.zeros((len(ys), len(xs)), bool)
    for a, b in zip(p[:-1], p[1:]) if len(p) > 1 else [(p[0], p[0])]:
        lo, hi = np.minimum(a, b) - buffer, np.maximum(a, b) + buffer
        i, j = np.searchsorted(xs, [lo[0], hi[0]])
        k, m = np.searchsorted(ys, [lo[1], hi[1]])
        if i == j or k == m:
            continue
        gx, gy = xs[None, i:j] - a[0], ys[k:m, None] - a[1]
        vx, vy = b - a
        n = vx * vx + vy * vy
        t = np.clip((gx * vx + gy * vy) / n, 0, 1) if n else 0.0
        mask[k:m, i:j] |= (gx - t * vx) ** 2 + (gy - t * vy) ** 2 <= buffer * buffer
    return mask


def buffer_overlap(p: np.ndarray, q: np.ndarray, buffer: float, cell: float) -> tuple[float, float]:
    """Areas of the intersection and the union of two lines' buffers, by counting grid cells whose centre lies in them. The error is of the order of perimeter x cell / 2."""
    both = np.vstack([p, q])
    lo, hi = both.min(axis=0) - buffer, both.max(axis=0) + buffer
    xs, ys = np.arange(lo[0] + cell / 2, hi[0], cell), np.arange(lo[1] + cell / 2, hi[1], cell)
    inter = union = 0
    band = max(1, BAND_CELLS // max(1, len(xs)))
    for at in range(0, len(ys), band):
        a, b = (_near_line(x, xs, ys[at : at + band], buffer) for x in (p, q))
        inter += int((a & b).sum())
        union += int((a | b).sum())
    return inter * cell * cell, union * cell * cell


def jaccard_buffer_pandas(buffer: float = 50.0, cell: float = 10.0):
    """Intersection over union of two lines' buffers: struct of intersection, union and jaccard."""

    @F.pandas_udf("intersection_area double, union_area double, jaccard double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            i, u = buffer_overlap(_xy(x), _xy(y), buffer, cell) if x is not None and y is not None and len(x) and len(y) else (np.nan, np.nan)
            rows.append((i, u, i / u if u else np.nan))
        return pd.DataFrame(rows, columns=["intersection_area", "union_area", "jaccard"])

    return run
