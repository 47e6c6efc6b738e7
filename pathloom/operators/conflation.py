"""Two networks brought together: nodes and lines matched, rule cascades, splits, connectors, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.common import cut
from pathloom.functions.geometry import name_ratio_pandas
from pathloom.operators.network import components
from pathloom.operators.routing import relax, starts_of
from pathloom.operators.spatial import beyond, covered_share, distance_join, near_segments, nearest, point_to_segment


def study_area(corners: DataFrame, polygon: str, order: str, x: str, y: str, per_mile: float = 5280.0) -> DataFrame:
    """Bounds and area in square miles of polygons given as ordered corners: minx, miny, maxx, maxy, square_miles."""
    w = Window.partitionBy(polygon).orderBy(order)
    first = Window.partitionBy(polygon)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.min_by(c, order).over(first)) for c in (x, y))
    ring = corners.withColumn("_a", F.col(x) * ny - nx * F.col(y))
    each = ring.groupBy(polygon).agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"), (F.abs(F.sum("_a")) / 2).alias("_area"))
    return each.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), (F.sum("_area") / per_mile**2).alias("square_miles"))


def sidewalk_connectors(links: DataFrame, longest: float = 100.0) -> DataFrame:
    """Short sidewalks with one end on a road and the other on a bike link become pedestrian links."""
    ends = lambda kind, flag: links.where(F.col("link_type") == kind).select(F.explode(F.array("A", "B")).alias("N")).distinct().withColumn(flag, F.lit(True))
    nodes = ends("road", "road").join(ends("bike", "bike"), "N", "full")
    at = lambda c: nodes.select(F.col("N").alias(c), F.coalesce("road", F.lit(False)).alias(f"_r{c}"), F.coalesce("bike", F.lit(False)).alias(f"_b{c}"))
    out = links.join(at("A"), "A", "left").join(at("B"), "B", "left")
    between = (F.col("_rA") & F.col("_bB")) | (F.col("_bA") & F.col("_rB"))
    hit = (F.col("link_type") == "sidewalk") & (F.col("length_ft") < longest) & F.coalesce(between, F.lit(False))
    return out.withColumn("link_type", F.when(hit, "pedestrian").otherwise(F.col("link_type"))).select(*links.columns)


def end_nodes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the nodes nearest to their ends: A, B and the distances a_off, b_off."""
    targets = nodes.select(F.col("N").alias("_n"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    out = links
    for node, off, x, y in (("A", "a_off", "ax", "ay"), ("B", "b_off", "bx", "by")):
        hit = nearest(links.select("linkid", F.col(x).alias("x"), F.col(y).alias("y")), "linkid", targets, "_n")
        out = out.drop(node).join(hit.select("linkid", F.col("_n").alias(node), F.col("distance").alias(off)), "linkid", "left")
    return out


def one_to_one(base: DataFrame, join: DataFrame, tolerance: float) -> DataFrame:
    """Base points (id, x, y) and join points (jid, jx, jy) paired one to one, each within the tolerance: of those that want the same one the nearest gets it, the others go on. id, jid, distance.

    Rounds over the pairs within the tolerance, found once, until none is left; every round settles all pairs that are each other's nearest (ties by id). Where all of
    some base points are equally near to all of some join points and to no other (points at one place), the i-th gets the i-th at once. Points without an id have no pairs.
    """
    pairs = cut(distance_join(base, join, tolerance, ("x", "y"), ("jx", "jy")).where("id is not null and jid is not null").select("id", "jid", "distance").distinct())
    mine, theirs = Window.partitionBy("id"), Window.partitionBy("jid")
    done, rounds = None, 0
    while True:
        p = pairs.withColumn("_i", F.col("distance") == F.min("distance").over(mine)).withColumn("_j", F.col("distance") == F.min("distance").over(theirs)).where("_i or _j")
        p = p.withColumn("_both", F.col("_i") & F.col("_j"))
        seen = lambda w, own, other: F.struct(F.bool_and(~F.col(own) | F.col("_both")).over(w).alias("only"), F.count_if("_both").over(w).alias("n"), F.bit_xor(F.when(F.col("_both"), F.xxhash64(other))).over(w).alias("h"))
        p = p.withColumn("_si", seen(mine, "_i", "jid")).withColumn("_sj", seen(theirs, "_j", "id"))
        first = lambda w, own, c: F.min(F.when(F.col(own), F.col(c))).over(w) == F.col(c)
        p = p.withColumn("_first", first(mine, "_i", "jid") & first(theirs, "_j", "id")).where("_both")
        alike = lambda w, c: (F.min(c).over(w) == F.max(c).over(w)) & F.bool_and(F.col(f"{c}.only")).over(w)
        p = p.withColumn("_group", alike(theirs, "_si") & alike(mine, "_sj"))
        p = p.withColumn("_ri", F.row_number().over(mine.orderBy("jid"))).withColumn("_rj", F.row_number().over(theirs.orderBy("id")))
        hit = cut(p.where(F.col("_first") | (F.col("_group") & (F.col("_ri") == F.col("_rj")))).select("id", "jid", "distance"))
        if hit.isEmpty():
            break
        done, rounds = hit if done is None else done.unionByName(hit), rounds + 1
        done = cut(done) if rounds % 20 == 0 else done
        pairs = cut(pairs.join(hit.select("id"), "id", "left_anti").join(hit.select("jid"), "jid", "left_anti"))
    return (done if done is not None else pairs.limit(0)).select("id", "jid", "distance")


def decide(pairs: DataFrame, key: str, rejected: Column, accepted: Column, distance: str, farthest: float) -> DataFrame:
    """Suggested pairs with `match`: a pair that isn't rejected, is the key's only one and has a reason to be accepted; of keys without such a pair the nearest that isn't rejected, within `farthest`."""
    w = Window.partitionBy(key)
    open_ = ~F.coalesce(rejected, F.lit(False))
    p = pairs.withColumn("_open", open_).withColumn("_n", F.sum(F.col("_open").cast("int")).over(w))
    p = p.withColumn("_sure", F.col("_open") & (F.col("_n") == 1) & F.coalesce(accepted, F.lit(False)))
    p = p.withColumn("_settled", F.max("_sure").over(w)).withColumn("_least", F.min(F.when(F.col("_open"), F.col(distance))).over(w))
    near = F.col("_open") & ~F.col("_settled") & (F.col(distance) == F.col("_least")) & (F.col(distance) <= farthest)
    rank = F.row_number().over(w.orderBy(near.desc(), *[c for c in pairs.columns if c != key]))
    return p.withColumn("_r", rank).withColumn("match", F.col("_sure") | (near & (F.col("_r") == 1))).drop("_open", "_n", "_sure", "_settled", "_least", "_r")


def signal_links(signals: DataFrame, nodes: DataFrame, links: DataFrame, reach: float, ratio: float = 0.6) -> DataFrame:
    """Links at nodes near a signal whose name is similar to one of the signal's streets: signal, linkid. `signals` has signal, x, y, streets (array)."""
    at = distance_join(signals.select("signal", "streets", "x", "y"), nodes.select("N", F.col("x").alias("qx"), F.col("y").alias("qy")), reach).select("signal", "streets", "N")
    ends = links.select("linkid", "name", F.explode(F.array("A", "B")).alias("N"))
    named = at.join(ends, "N").select("signal", "linkid", "name", F.explode("streets").alias("street")).distinct()
    return named.where(name_ratio_pandas("name", "street") >= ratio).select("signal", "linkid").distinct()


def split_at(links: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """Straight links cut where a point lies on them (within the tolerance, not at their ends): linkid, part (from 0), ax, ay, bx, by, length_ft."""
    on = near_segments(points.select("x", "y"), links.select("linkid", "ax", "ay", "bx", "by"), tolerance, max(tolerance * 4, 1.0)).where("share > 1e-9 and share < 1 - 1e-9")
    cuts = on.groupBy("linkid").agg(F.sort_array(F.collect_set(F.round("share", 9))).alias("_c"))
    out = links.join(cuts, "linkid", "left").withColumn("_m", F.concat(F.array(F.lit(0.0)), F.coalesce("_c", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    out = out.select("*", F.posexplode(F.slice("_m", F.lit(1), F.size("_m") - 1)).alias("part", "_s")).withColumn("_e", F.get("_m", F.col("part") + 1))
    at = lambda p, q, t: F.col(p) + F.col(t) * (F.col(q) - F.col(p))
    return out.select("linkid", "part", at("ax", "bx", "_s").alias("ax"), at("ay", "by", "_s").alias("ay"), at("ax", "bx", "_e").alias("bx"), at("ay", "by", "_e").alias("by"), (F.col("length_ft") * (F.col("_e") - F.col("_s"))).alias("length_ft"))


def side_path_roads(roads: DataFrame, paths: DataFrame, buffer: float = 50.0, share: float = 0.95, angle: float = 30.0, run: float = 400.0, every: float = 10.0) -> DataFrame:
    """Roads that run along a path: covered nearly whole by its buffer, at a small angle, in connected stretches long enough: linkid, path_id, share, angle. Of several paths the one that covers most."""
    over = covered_share(roads, "linkid", paths, "path_id", buffer, every).where((F.col("share") > share) & (F.col("angle") < angle))
    best = over.groupBy("linkid").agg(F.min(F.struct((-F.col("share")).alias("s"), "angle", "path_id")).alias("b")).select("linkid", "b.path_id", (-F.col("b.s")).alias("share"), "b.angle")
    some = roads.join(best.select("linkid"), "linkid", "left_semi")
    group = components(some, "A", "B").select(F.col("node").alias("A"), "component")
    lengths = some.join(group, "A").groupBy("component").agg(F.sum("length_ft").alias("total")).where(F.col("total") > run)
    return best.join(some.join(group, "A").join(lengths, "component").select("linkid"), "linkid", "left_semi")


def gap_connectors(links: DataFrame, edges: DataFrame, turns: DataFrame, dead_ends: DataFrame, targets: DataFrame, cutoff: float) -> DataFrame:
    """From every dead end (N) the nearest target node (N) along the network within a cutoff: origin, N, d; of dead ends that reach any."""
    reached = relax(starts_of(edges, dead_ends.select(F.col("N").alias("origin"))), turns, cutoff)
    at = reached.join(edges.select("linkid", "reverse_link", F.col("B").alias("N")), ["linkid", "reverse_link"]).join(targets.select("N").distinct(), "N").where("N <> origin")
    return at.groupBy("origin").agg(F.min(F.struct("d", "N")).alias("b")).select("origin", "b.N", "b.d")


def touching(traces: DataFrame, trip: str, order: str, x: float, y: float, radius: float) -> DataFrame:
    """Trips whose line comes within a radius of a place."""
    w = Window.partitionBy(trip).orderBy(order)
    seg = traces.select(trip, F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(w), F.col("x")).alias("bx"), F.coalesce(F.lead("y").over(w), F.col("y")).alias("by"))
    near = point_to_segment(F.lit(x), F.lit(y), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= radius
    return seg.groupBy(trip).agg(F.bool_or(near).alias("_t")).where("_t").select(trip)


def side_path_swapped(pairs: DataFrame, attributes: DataFrame, facility: str, numbers: list[str]) -> DataFrame:
    """Roads with a side path (linkid, path_id): the facility is the path's, or the road's own where it has none; the numbers are the greater of both, which the path takes."""
    road = attributes.select("linkid", F.col(facility).alias("_f"), *[F.col(n).alias(f"_{n}") for n in numbers])
    path = attributes.select(F.col("linkid").alias("path_id"), facility, *numbers)
    both = pairs.join(road, "linkid").join(path, "path_id")
    return both.select("linkid", "path_id", F.coalesce(facility, "_f").alias(facility), *[F.greatest(n, f"_{n}").alias(n) for n in numbers])


def missing_links(points: DataFrame, key: str, network: DataFrame, far: float, raw: DataFrame, near: float) -> DataFrame:
    """Points farther than `far` from everything in the network but within `near` of the raw map (points qx, qy of both): where links may be missing."""
    left = beyond(points, network, far, ("x", "y"), ("qx", "qy"), key)
    hit = distance_join(left, raw, near).select(key).distinct()
    return left.join(hit, key, "left_semi")
