"""Distance and nearest-neighbour joins in the plane through grid cells: equality joins, exact afterwards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.common import cut


def _cell(df: DataFrame, x: str, y: str, size: Column | float, ring: int = 0) -> DataFrame:
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    df = df.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))
    if ring:
        near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1)])
        df = df.withColumn("_o", F.explode(near)).withColumn("_cx", F.col("_cx") + F.col("_o.i")).withColumn("_cy", F.col("_cy") + F.col("_o.j")).drop("_o")
    return df


def distance_join(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("qx", "qy")) -> DataFrame:
    """All pairs at most radius apart, with `distance`. Right rows are repeated to the neighbouring cells (give the smaller side as right). Column names must differ."""
    a = _cell(left, *left_xy, radius)
    b = _cell(right, *right_xy, radius, ring=1)
    d = F.hypot(F.col(left_xy[0]) - F.col(right_xy[0]), F.col(left_xy[1]) - F.col(right_xy[1]))
    return a.join(b, ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_cx", "_cy")


def beyond(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str], key: str) -> DataFrame:
    """Left rows with no right row within the radius."""
    near = distance_join(left, right, radius, left_xy, right_xy).select(key).distinct()
    return left.join(near, key, "left_anti")


def nearest(points: DataFrame, key: str, targets: DataFrame, target: str, xy: tuple[str, str] = ("x", "y"), txy: tuple[str, str] = ("qx", "qy"), cell: float | None = None) -> DataFrame:
    """For every point the nearest target and the distance; ties take the smallest target. Points without a position, and all if there are no targets, have none.

    Rings of grid cells: a point that finds a target within the width of a cell in its own and the neighbouring cells has its nearest. The others go on with cells
    eight times as wide, until none is left; the cell starts at what spreads the targets at about two to a cell. Each ring is written, none is computed twice.
    """
    n, w, e, s, t = targets.agg(F.count(txy[0]), F.min(txy[0]), F.max(txy[0]), F.min(txy[1]), F.max(txy[1])).first()
    found = None
    left = points.where(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull()).select(key, *xy)
    if n:
        span = max(e - w, t - s, 1e-9)
        size = cell or max(math.sqrt(max((e - w) * (t - s), 1e-12) / n * 2), span / 1e6)
        places = targets.where(F.col(txy[0]).isNotNull()).select(target, *txy)
        box = points.agg(F.min(xy[0]), F.max(xy[0]), F.min(xy[1]), F.max(xy[1])).first()
        whole = max([span] + [abs(a - b) for a in box if a is not None for b in (w, e, s, t)])
        while True:
            last = size > whole
            pairs = _cell(left, *xy, size).join(_cell(places, *txy, size, ring=1), ["_cx", "_cy"])
            pairs = pairs.withColumn("distance", F.hypot(F.col(xy[0]) - F.col(txy[0]), F.col(xy[1]) - F.col(txy[1])))
            best = pairs.groupBy(key).agg(F.min(F.struct("distance", target)).alias("_b")).select(key, F.col(f"_b.{target}").alias(target), F.col("_b.distance").alias("distance"))
            done = cut(best if last else best.where(F.col("distance") <= size))
            found = done if found is None else found.unionByName(done)
            if last:
                break
            left = cut(left.join(done, key, "left_anti"))
            if left.isEmpty():
                break
            size *= 8
    if found is None:
        return points.select(key).withColumn(target, F.lit(None).cast(targets.schema[target].dataType)).withColumn("distance", F.lit(None).cast("double"))
    return points.select(key).join(found, key, "left")


def nearest_per_group(pairs: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Of pairs with a distance the nearest target per keys; ties take the smallest."""
    return pairs.groupBy(*keys).agg(F.min(F.struct("distance", target)).alias("_b")).select(*keys, F.col(f"_b.{target}").alias(target), F.col("_b.distance").alias("distance"))


def nearest_of_groups(points: DataFrame, key: str, targets: DataFrame, group: str, target: str, radius: float, xy: tuple[str, str] = ("x", "y"), txy: tuple[str, str] = ("qx", "qy")) -> DataFrame:
    """For every point the nearest target of each group (of which there are few) within the radius: key, group, target, distance; ties take the smallest target.

    Rings of grid cells as in nearest: a point that finds one of a group within the width of a cell has its nearest of that group, and only the others go on with cells four
    times as wide, up to the radius. The pairs looked at thus follow the result's size, not the number of targets within the radius.
    """
    names = targets.where(F.col(group).isNotNull()).select(group).distinct()
    n, w, e, s, t = targets.agg(F.count(txy[0]), F.min(txy[0]), F.max(txy[0]), F.min(txy[1]), F.max(txy[1])).first()
    size = radius
    if n and radius > 0:
        size = min(radius, max(math.sqrt(max((e - w) * (t - s), 1e-12) / n * 2 * max(names.count(), 1)), radius / 4096))
    left = points.where(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull()).select(key, *xy).crossJoin(F.broadcast(names))
    places = cut(targets.where(F.col(txy[0]).isNotNull() & F.col(txy[1]).isNotNull()).select(group, target, *txy))
    found = None
    while True:
        pairs = _cell(left, *xy, size or 1.0).join(_cell(places, *txy, size or 1.0, ring=1), ["_cx", "_cy", group])
        pairs = pairs.withColumn("distance", F.hypot(F.col(xy[0]) - F.col(txy[0]), F.col(xy[1]) - F.col(txy[1]))).where(F.col("distance") <= size)
        done = cut(nearest_per_group(pairs, [key, group], target))
        found = done if found is None else found.unionByName(done)
        if size >= radius:
            return found
        left = cut(left.join(done, [key, group], "left_anti"))
        if left.isEmpty():
            return found
        size = min(radius, size * 4)


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def share_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a segment, from 0 to 1, the nearest place to a point is."""
    dx, dy = bx - ax, by - ay
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))


def segment_cells(segments: DataFrame, size: float, margin: float, a: tuple[str, str] = ("ax", "ay"), b: tuple[str, str] = ("bx", "by")) -> DataFrame:
    """Segments repeated to each grid cell within a margin of them: points along it at most a cell apart, with their surroundings (what is within the margin is no farther from one of them than half a cell along and the margin across)."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col(b[0]) - F.col(a[0]), F.col(b[1]) - F.col(a[1])) / size)).cast("int")
    at = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = at.withColumn("_x", F.col(a[0]) + (F.col(b[0]) - F.col(a[0])) * F.col("_i") / F.col("_n")).withColumn("_y", F.col(a[1]) + (F.col(b[1]) - F.col(a[1])) * F.col("_i") / F.col("_n"))
    reach = math.ceil(math.hypot(margin, size / 2) / size + 1e-9)
    return _cell(at, "_x", "_y", size, ring=reach).drop("_n", "_i", "_x", "_y").distinct()


def near_segments(points: DataFrame, segments: DataFrame, radius: float, cell: float, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Pairs of points and segments (ax, ay, bx, by) at most radius apart, with `distance` and `share`, the place along the segment."""
    pairs = _cell(points, *xy, cell).join(segment_cells(segments, cell, radius), ["_cx", "_cy"]).drop("_cx", "_cy")
    args = [F.col(c) for c in (*xy, "ax", "ay", "bx", "by")]
    return pairs.withColumn("distance", point_to_segment(*args)).where(F.col("distance") <= radius).withColumn("share", share_on_segment(*args))


def covered_share(base: DataFrame, key: str, other: DataFrame, other_key: str, buffer: float, every: float) -> DataFrame:
    """How much of each base segment lies within a buffer of each other segment, and the angle between them: key, other_key, share, angle (0..90).

    The share is sampled: points every so far along the base; its error is below every / length.
    """
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / every)).cast("int")
    samples = base.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    mid = (F.col("_i") + 0.5) / F.col("_n")
    turn = lambda ax, ay, bx, by: F.degrees(F.atan2(by - ay, bx - ax))
    c = F.col
    samples = samples.select(F.col(key), c("_n"), (c("ax") + (c("bx") - c("ax")) * mid).alias("x"), (c("ay") + (c("by") - c("ay")) * mid).alias("y"), turn(c("ax"), c("ay"), c("bx"), c("by")).alias("_turn"))
    pairs = near_segments(samples, other.select(F.col(other_key), "ax", "ay", "bx", "by"), buffer, max(buffer, 1e-6) * 2)
    off = F.pmod(c("_turn") - turn(c("ax"), c("ay"), c("bx"), c("by")), F.lit(180.0))
    return pairs.withColumn("_off", F.least(off, 180 - off)).groupBy(key, other_key).agg((F.count(F.lit(1)) / F.first("_n")).alias("share"), F.min("_off").alias("angle"))
