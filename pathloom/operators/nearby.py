"""Points near other points: a sweep over latitude strips. Points in regions: by cells of the regions' size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the sphere in metres.
EARTH_M = 6371008.8
#: Height of a strip and width of a cell of it, in radii.
HIGH, WIDE = 4, 8
#: Positions whose pairs one task looks for in one piece, about; a denser cell is shared out.
PIECE_POINTS = 20_000
#: Candidate pairs verified at once.
BLOCK_PAIRS = 1_000_000


def haversine_m(lat1, lon1, lat2, lon2):
    """Great-circle distance in metres, in doubles, of numpy arrays of degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def degrees_of(radius_m: float, lat: float = 0.0) -> float:
    """Degrees of longitude at a latitude (of latitude, at 0) that a point within the radius can be away, with a margin."""
    c = math.cos(math.radians(min(90.0, abs(lat))))
    s = math.sin(min(math.pi / 2, radius_m / 2 / EARTH_M))
    return 360.0 if s >= c else math.degrees(2 * math.asin(s / c)) * (1 + 1e-9) + 1e-9


def _degrees_of(radius_m: float, lat: Column) -> Column:
    """degrees_of at a column's latitudes."""
    s = math.sin(min(math.pi / 2, radius_m / 2 / EARTH_M))
    c = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat))))
    return F.when(c <= s, F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.lit(s) / c)) * (1 + 1e-9) + 1e-9)


def _sweep(radius_m: float):  # noqa: ANN202
    """Rows of cells, each with its core first, to pairs whose lower point is in the core. Of a cell only the core is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            first = len(rows) - len(batch)
            lat, lon, wide, core = (rows[c].to_numpy() for c in ("lat", "lon", "wide", "core"))
            ids = rows["id"].to_numpy()
            cell, piece = rows["cell"].to_numpy(), rows["piece"].to_numpy()
            number = np.cumsum(np.r_[0, (cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1])])
            # the active set: cores in the order of longitude, cell after cell
            place = number * 4096.0 + lon
            active = np.flatnonzero(core)
            active = active[np.argsort(place[active], kind="stable")]
            by_lon = place[active]
            j = np.arange(first, len(rows))
            lo, hi = np.searchsorted(by_lon, place[j] - wide[j], "left"), np.searchsorted(by_lon, place[j] + wide[j], "right")
            ends = np.cumsum(hi - lo)
            at = 0
            while at < len(j):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
                k = (hi - lo)[at:to]
                b = np.repeat(j[at:to], k)
                a = active[np.repeat(lo[at:to], k) + np.arange(len(b)) - np.repeat(np.cumsum(k) - k, k)]
                # two of the core meet once; another point is only met by cores below it
                keep = (a < b) & (number[a] == number[b]) & (core[b] | (lat[a] < lat[b]) | ((lat[a] == lat[b]) & (ids[a] < ids[b])))
                a, b = a[keep], b[keep]
                m = haversine_m(lat[a], lon[a], lat[b], lon[b])
                near = (m <= radius_m) & (ids[a] != ids[b])
                yield pd.DataFrame({"id_a": ids[a[near]], "id_b": ids[b[near]], "metres": m[near]})
                at = to
            held = rows[(number == number[-1]) & core]

    return run


def _near_places(places: DataFrame, radius_m: float, piece_points: int) -> DataFrame:
    """Pairs of different positions (rep, lat, lon) within the radius: id_a, id_b, metres."""
    tall = degrees_of(radius_m)
    high = HIGH * tall
    kind = places.schema["rep"].dataType.simpleString()
    strip = F.floor((F.col("lat") + 90) / high).cast("bigint")
    # a strip, and, for points less than a radius above its base, the one below, whose points they may meet
    below = (F.col("lat") - (F.col("s") * high - 90) < tall) & (F.col("s") > 0)
    near = places.withColumn("s", strip)
    near = near.withColumn("strip", F.explode(F.when(below, F.array("s", F.col("s") - 1)).otherwise(F.array("s"))))
    base = F.col("strip") * high - 90
    near = near.withColumn("wide", _degrees_of(radius_m, F.greatest(F.abs(base), F.abs(base + high)) + tall))
    # the antimeridian: a copy a full turn away
    turn = F.when(F.col("wide") >= 180, F.array(F.lit(0.0))).otherwise(
        F.array_compact(F.array(F.lit(0.0), F.when(F.col("lon") < -180 + F.col("wide"), 360.0), F.when(F.col("lon") > 180 - F.col("wide"), -360.0)))
    )
    near = near.withColumn("turn", F.explode(turn)).withColumn("lon", F.col("lon") + F.col("turn"))
    column = lambda c: F.floor(c / (WIDE * F.col("wide"))).cast("bigint")
    near = near.withColumn("column", F.explode(F.sequence(column(F.col("lon") - F.col("wide")), column(F.col("lon") + F.col("wide")))))
    core = (F.col("strip") == F.col("s")) & (F.col("turn") == 0) & (F.col("column") == column(F.col("lon")))
    near = near.select((F.col("strip") * (1 << 32) + F.col("column")).alias("cell"), "lat", "lon", F.col("rep").alias("id"), core.alias("core"), "wide")
    # dense cells are shared out: each piece has a part of the core, and meets all of the cell
    dense = near.where("core").groupBy("cell").count().where(F.col("count") > 2 * piece_points).select("cell", F.ceil(F.col("count") / piece_points).alias("pieces"))
    near = near.join(dense, "cell", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    near = near.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    near = near.withColumn("core", F.col("core") & (F.pmod(F.xxhash64("id"), F.col("pieces")) == F.col("piece"))).drop("pieces")
    return near.repartition("cell", "piece").sortWithinPartitions("cell", "piece", F.desc("core"), "lon").mapInPandas(_sweep(radius_m), f"id_a {kind}, id_b {kind}, metres double")


def _placed(points: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    clean = points.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where(
        "id is not null and abs(lat) <= 90 and abs(lon) <= 180"
    )
    return clean.distinct()


def places_within(points: DataFrame, key: str, lat: str, lon: str, radius_m: float, piece_points: int = PIECE_POINTS) -> tuple[DataFrame, DataFrame]:
    """points_within with positions instead of points: pairs of representatives of different positions (id_a, id_b, metres), and which points
    each represents (rep, id). Points of one position, however many, are not paired."""
    clean = _placed(points, key, lat, lon)
    places = clean.groupBy("lat", "lon").agg(F.min("id").alias("rep"))
    pairs = _near_places(places, radius_m, piece_points).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "metres")
    return pairs, clean.join(places, ["lat", "lon"]).select("rep", "id")


def points_within(points: DataFrame, key: str, lat: str, lon: str, radius_m: float, piece_points: int = PIECE_POINTS) -> DataFrame:
    """All pairs of different keys at most radius_m apart on the sphere: id_a < id_b, metres.

    `points` has one row per key (see latest_position). Defined cases: rows with a null key, a null, NaN or out-of-range
    position (|lat| > 90, |lon| > 180) have no pairs; repeated rows count once; the antimeridian is crossed; an empty table gives an
    empty result; the key keeps its type.

    Method: the latitude is cut into strips of HIGH radii, each with the points up to one radius above it, and a strip by longitude into cells with a
    margin on both sides; both follow from a point's own position, so nothing about the data is gathered first. A cell is sorted by longitude
    and swept: its core is the active set, each point looks up the core within its reach, distances are verified, and a pair belongs to the cell whose
    core holds its lower point. A cell with very many points is shared out in pieces by the hash of the lower point. Points at one position are
    swept once and joined back afterwards; their pairs are made only because they are the result (places_within gives them as members instead).
    """
    clean = _placed(points, key, lat, lon)
    places = clean.groupBy("lat", "lon").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    swept = _near_places(places.select("lat", "lon", "rep"), radius_m, piece_points)
    # back from positions to keys, where a position has several
    shared = clean.join(places.where("n > 1"), ["lat", "lon"]).select("rep", "id", "n")
    a, b = shared.select(F.col("rep").alias("id_a"), F.col("id").alias("x")), shared.select(F.col("rep").alias("id_b"), F.col("id").alias("y"))
    across = swept.join(a, "id_a", "left").join(b, "id_b", "left").select(F.coalesce("x", "id_a").alias("x"), F.coalesce("y", "id_b").alias("y"), "metres")
    # pairs at one position: of very many, a part of the lower ones meets all others in one task
    parts = F.ceil(F.col("n") / piece_points).cast("int")
    lower = shared.select("rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    upper = shared.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    same = lower.join(upper, ["rep", "part"]).where("x < y").select("x", "y", F.lit(0.0).alias("metres"))
    return across.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "metres")


def latest_position(rows: DataFrame, key: str, lat: str, lon: str, version: str, box: tuple[float, float, float, float]) -> DataFrame:
    """For each key the position of its latest version, if it lies in the box (south, north, west, east; inclusive).

    Ties on the version take the larger (lat, lon), a position before none; a null version is older than any.
    """
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(version), F.col(lat).alias("lat"), F.col(lon).alias("lon"))).alias("m"))
    south, north, west, east = box
    return last.select(key, F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon")).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def points_in_regions(points: DataFrame, key: str, x: str, y: str, regions: DataFrame, region: str, polygon: str) -> DataFrame:
    """Every point with each region that contains it: key, region.

    `polygon` is an array of struct<x, y> in the points' plane, closed or not; even-odd rule, with the lower and left borders inside and the upper and right ones
    outside, so that regions that share a border share no point. Defined cases: null keys, null or NaN coordinates and polygons
    of fewer than three points give nothing; repeated rows count once; empty tables give an empty result.

    Regions come in classes of doubling size; a region's box covers at most four cells of its class. A point has one cell of each class there is (about 50 at most), so
    both sides meet by an equality join, and only what shares a cell is tested.
    """
    r = regions.select(F.col(region).alias("_region"), F.col(polygon).alias("_p")).where(F.col("_region").isNotNull() & (F.size("_p") >= 3)).distinct()
    for c, f in (("x0", F.array_min), ("x1", F.array_max)):
        r = r.withColumn(f"_{c}", f(F.col("_p.x"))).withColumn(f"_{c.replace('x', 'y')}", f(F.col("_p.y")))
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-6))
    r = r.withColumn("_class", F.ceil(F.log2(extent)).cast("int"))
    classes = [c[0] for c in r.select("_class").where("_class is not null").distinct().collect()]  # as many as doubles have magnitudes at most
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_class"))).cast("bigint")
    r = r.withColumn("_cx", F.explode(F.sequence(cell("_x0"), cell("_x1")))).withColumn("_cy", F.explode(F.sequence(cell("_y0"), cell("_y1"))))
    p = points.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    p = p.where("_key is not null and not isnan(_x) and not isnan(_y) and _x is not null and _y is not null").distinct()
    if classes:
        p = p.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in sorted(classes)])))
    else:
        p = p.withColumn("_class", F.lit(None).cast("int"))
    p = p.withColumn("_cx", cell("_x")).withColumn("_cy", cell("_y"))
    both = p.join(r, ["_class", "_cx", "_cy"]).where("_x >= _x0 and _x <= _x1 and _y >= _y0 and _y <= _y1")
    crossed = F.expr(
        "aggregate(sequence(0, size(_p) - 1), 0, (n, i) -> n + if((_p[i].y > _y) <> (_p[(i + 1) % size(_p)].y > _y) and _x < _p[i].x + (_y - _p[i].y)"
        " * (_p[(i + 1) % size(_p)].x - _p[i].x) / nullif(_p[(i + 1) % size(_p)].y - _p[i].y, 0), 1, 0))"
    )
    return both.where(crossed % 2 == 1).select(F.col("_key").alias(key), F.col("_region").alias(region)).distinct()
