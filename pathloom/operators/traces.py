"""Ordered-row operators on traces and elevation profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- traces --------------------------------------------------------------------------------------------------


def privacy_trim(points: DataFrame, trip: str, order: str, x: str, y: str, distance: float) -> DataFrame:
    """Points of each trip from the first one farther than `distance` from its start to the last one farther than that from its end.

    Trips that never get twice the distance away from their start, or of which nothing is left, are dropped whole.
    """
    w = Window.partitionBy(trip)
    by = F.struct(order)
    ends = points.withColumn("_s", F.min_by(F.struct(x, y), by).over(w)).withColumn("_e", F.max_by(F.struct(x, y), by).over(w))
    away = lambda p: F.hypot(F.col(x) - F.col(f"{p}.{x}"), F.col(y) - F.col(f"{p}.{y}"))
    far = ends.withColumn("_ds", away("_s")).withColumn("_de", away("_e"))
    far = far.withColumn("_reach", F.max("_ds").over(w))
    far = far.withColumn("_from", F.min(F.when(F.col("_ds") > distance, F.col(order))).over(w)).withColumn("_to", F.max(F.when(F.col("_de") > distance, F.col(order))).over(w))
    return far.where((F.col("_reach") > 2 * distance) & F.col(order).between(F.col("_from"), F.col("_to"))).select(*points.columns)


def last_of_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows that differ from their successor: of a run of equal values the last."""
    nxt = F.lead(F.struct(value)).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", nxt).where(F.col("_n").isNull() | ~F.col(f"_n.{value}").eqNullSafe(F.col(value))).drop("_n")


def consecutive_pairs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, drop_same: bool = False) -> DataFrame:
    """keys, position of the first, value and next value of every two rows in a row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = rows.select(*keys, *[c for c in order if c not in keys], value, F.lead(value).over(w).alias(f"next_{value}"), F.lead(F.lit(1)).over(w).alias("_there")).where("_there = 1").drop("_there")
    return pairs.where(F.col(value) != F.col(f"next_{value}")) if drop_same else pairs


def ends_of(rows: DataFrame, keys: Sequence[str], order: str, first: str, last: str) -> DataFrame:
    """First value of one column and last of another per key, by one aggregation."""
    return rows.groupBy(*keys).agg(F.min_by(first, order).alias(f"first_{first}"), F.max_by(last, order).alias(f"last_{last}"))


def filled_steps(rows: DataFrame, keys: Sequence[str], step: Column, values: Sequence[str]) -> DataFrame:
    """Every whole step between a key's first and last, with the values where there are any: keys, step, values."""
    own = rows.select(*keys, step.cast("bigint").alias("step"), *values)
    spans = own.groupBy(*keys).agg(F.min("step").alias("_a"), F.max("step").alias("_b"))
    dense = spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias("step"))
    return dense.join(own, [*keys, "step"], "left")


#: Buckets of time for rows without keys.
BUCKETS = 4096


def as_of(rows: DataFrame, at: Column, known: DataFrame, known_at: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with the value of the latest known row at or before them (null if none), per key: a union and one running window, no range join."""
    flag = "_is_row"
    left = rows.withColumn("_at", at).withColumn(flag, F.lit(1)).withColumn("_v", F.lit(None).cast(known.schema[value].dataType))
    right = known.select(*keys, F.col(known_at).alias("_at"), F.col(value).alias("_v")).withColumn(flag, F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    if keys:
        w = Window.partitionBy(*keys).orderBy("_at", flag).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn(value, F.last("_v", True).over(w)).where(F.col(flag) == 1).drop("_at", "_v", flag)
    # without keys in buckets of time, each of which knows the last value before it
    low, high = both.agg(F.min(F.col("_at").cast("double")), F.max(F.col("_at").cast("double"))).first()
    width = max(((high or 0.0) - (low or 0.0)) / BUCKETS, 1e-9)
    both = both.withColumn("_b", F.coalesce(F.floor((F.col("_at").cast("double") - F.lit(low or 0.0)) / width), F.lit(-1)))
    ends = both.where("_v is not null").groupBy("_b").agg(F.max_by("_v", "_at").alias("_end"))  # BUCKETS rows and one
    spots = both.select("_b").distinct().join(ends, "_b", "left")
    before = spots.select("_b", F.last("_end", True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy("_b").orderBy("_at", flag).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.join(F.broadcast(before), "_b").withColumn(value, F.coalesce(F.last("_v", True).over(w), F.when(F.col("_at").isNotNull(), F.col("_before"))))
    return out.where(F.col(flag) == 1).drop("_at", "_v", "_b", "_before", flag)


def as_of_small(rows: DataFrame, at: Column, known: DataFrame, known_at: str, most: int = 10_000) -> DataFrame:
    """The same for a short list of distinct values (network years): searched in an array. Longer lists go through as_of."""
    values = known.select(known_at).where(F.col(known_at).isNotNull()).distinct().limit(most + 1)
    packed = values.agg(F.sort_array(F.collect_list(known_at)).alias("_all"), F.count(F.lit(1)).alias("_n"))
    if packed.first()["_n"] > most:
        return as_of(rows, at, known.select(F.col(known_at), F.col(known_at).alias("found")), known_at, "found")
    joined = rows.withColumn("_at", at).crossJoin(F.broadcast(packed))  # one row of at most `most` values
    return joined.withColumn("found", F.array_max(F.filter("_all", lambda v: v <= F.col("_at")))).drop("_all", "_n", "_at")


def within_interval(left: DataFrame, at: str, right: DataFrame, start: str, length: int, keys: Sequence[str]) -> DataFrame:
    """Pairs with start <= at <= start + length, of equal keys: equality on buckets of the length, then the exact bounds. Times are whole numbers."""
    bucket = lambda c: F.floor(F.col(c) / length)
    a = left.withColumn("_b", bucket(at))
    b = right.withColumn("_b", F.explode(F.array(bucket(start), bucket(start) + 1)))
    return a.join(b, [*keys, "_b"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(start) + length)).drop("_b")


def repeating(rows: DataFrame, trip: str, link: str) -> DataFrame:
    """Trips that use a link more than once: trip, n, distinct."""
    return rows.groupBy(trip).agg(F.count(link).alias("n"), F.countDistinct(link).alias("different")).where("n > different")


def without_repeats(rows: DataFrame, trip: str, link: str) -> DataFrame:
    """Rows whose link occurs once in its trip."""
    return rows.join(rows.groupBy(trip, link).count().where("count = 1").select(trip, link), [trip, link], "left_semi")


def kinematics(points: DataFrame, trip: str, order: str, speed: str, seconds: Column) -> DataFrame:
    """Least, mean and greatest speed, acceleration and jerk per trip."""
    w = Window.partitionBy(trip).orderBy(order)
    rate = lambda v: (F.col(v) - F.lag(v).over(w)) / F.nullif(F.col("_t") - F.lag("_t").over(w), F.lit(0.0))
    p = points.withColumn("_t", seconds).withColumn("accel", rate(speed))
    p = p.withColumn("jerk", rate("accel"))
    return p.groupBy(trip).agg(*[f(c).alias(f"{n}_{c}") for c in (speed, "accel", "jerk") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


def first_gaps(points: DataFrame, trip: str, order: str, most: int) -> DataFrame:
    """The first rows of each trip that directly follow the row before them in the counter."""
    w = Window.partitionBy(trip).orderBy(order)
    near = points.withColumn("_d", F.col(order) - F.lag(order).over(w)).where("_d = 1").drop("_d")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


# --- elevation profiles --------------------------------------------------------------------------------------


def lag_grades(profile: DataFrame, link: str, dist: str, elev: str) -> DataFrame:
    """Percent grade of each segment from the point before, in `grade`; a link's first point has none."""
    w = Window.partitionBy(link).orderBy(dist)
    run = F.col(dist) - F.lag(dist).over(w)
    return profile.withColumn("grade", (F.col(elev) - F.lag(elev).over(w)) / F.nullif(run, F.lit(0.0)) * 100)


def ascents(profile: DataFrame, link: str, dist: str, elev: str, threshold: float) -> DataFrame:
    """Per link: ascent, descent (negative), length, grades of both in percent of the length (2 digits) and the number of segments steeper than the threshold."""
    g = lag_grades(profile, link, dist, elev)
    w = Window.partitionBy(link).orderBy(dist)
    g = g.withColumn("_d", F.col(elev) - F.lag(elev).over(w))
    out = g.groupBy(link).agg(
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0.0)).alias("ascent"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_d"))), F.lit(0.0)).alias("descent"),
        (F.max(dist) - F.min(dist)).alias("length"), F.sum(F.when(F.abs("grade") > threshold, 1).otherwise(0)).alias("steep"),
    )
    pct = lambda c: F.bround(F.col(c) / F.nullif(F.col("length"), F.lit(0.0)) * 100, 2)
    return out.withColumn("ascent_grade", pct("ascent")).withColumn("descent_grade", pct("descent"))


def knocked_out(profile: DataFrame, link: str, dist: str, elev: str, threshold: float) -> DataFrame:
    """Points whose incoming grade exceeds the threshold lose their elevation, again and again over those left, until none is left that does.

    In each round all such points of a link go at once; its first point stays. A link's profile is bounded by its length, so its fixpoint is
    reached within one row of arrays.
    """
    pts = profile.groupBy(link).agg(F.sort_array(F.collect_list(F.struct(F.col(dist).cast("double").alias("d"), F.col(elev).cast("double").alias("e")))).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, p in zip(b[link], b["p"]):
                d, e = np.array([x["d"] for x in p]), np.array([x["e"] if x["e"] is not None else np.nan for x in p])
                while True:
                    k = np.flatnonzero(~np.isnan(e))
                    if len(k) < 2:
                        break
                    grade = np.abs(np.diff(e[k]) / np.maximum(np.diff(d[k]), 1e-9) * 100)
                    bad = k[1:][grade > threshold]
                    if not len(bad):
                        break
                    e[bad] = np.nan
                rows.append(pd.DataFrame({link: key, dist: d, elev: e}))
            if rows:
                out = pd.concat(rows, ignore_index=True)
                yield out.assign(**{elev: out[elev].astype(object).where(out[elev].notna(), None)})

    kind = profile.schema[link].dataType.simpleString()
    return pts.mapInPandas(run, f"`{link}` {kind}, `{dist}` double, `{elev}` double")


def resampled(profile: DataFrame, link: str, dist: str, elev: str, every: float) -> DataFrame:
    """Elevations every so many units along each link, linear between its points: link, at, elev (two points, the ends, for shorter links)."""
    w = Window.partitionBy(link).orderBy(dist)
    seg = profile.select(link, F.col(dist).alias("d0"), F.col(elev).alias("e0"), F.lead(dist).over(w).alias("d1"), F.lead(elev).over(w).alias("e1"), F.min(dist).over(Window.partitionBy(link)).alias("_a"), F.max(dist).over(Window.partitionBy(link)).alias("_b"))
    seg = seg.where("d1 is not null and d1 > d0").withColumn("_len", F.col("_b") - F.col("_a"))
    step = F.when(F.col("_len") < every, F.col("_len")).otherwise(F.lit(float(every)))
    lo, hi = F.ceil((F.col("d0") - F.col("_a")) / step), F.ceil((F.col("d1") - F.col("_a")) / step) - 1
    last = (F.col("d1") == F.col("_b")) & (F.pmod(F.col("_len"), step) == 0)
    n = F.when(last, hi + 1).otherwise(hi)
    seg = seg.withColumn("_step", step).withColumn("_k", F.explode(F.when(n >= lo, F.sequence(lo, n)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("_k") * F.col("_step")
    pos = at + F.col("_a")
    return seg.select(link, at.alias("at"), (F.col("e0") + (F.col("e1") - F.col("e0")) * (pos - F.col("d0")) / (F.col("d1") - F.col("d0"))).alias("elev"))
