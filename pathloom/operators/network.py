"""Directed edges, turns, degrees, components and link geometry of street networks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.common import cut
from pathloom.functions import scalars as S

#: Pairs of columns that change sides when a link is travelled backwards.
SIDES = (("A", "B"), ("ax", "bx"), ("ay", "by"))


def directed(links: DataFrame, sides: Sequence[tuple[str, str]] = SIDES, honour_oneway: bool = False, geometry: str | None = None) -> DataFrame:
    """Both directions of every link, `reverse_link` telling them apart, sided columns and the geometry turned round; with honour_oneway only the allowed ones. One pass: no union of two scans."""
    pair = {a: b for a, b in sides if a in links.columns and b in links.columns}
    pair |= {b: a for a, b in pair.items()}
    ways = F.array(F.lit(False), F.lit(True))
    if honour_oneway:
        ways = F.when(F.coalesce("oneway", F.lit(False)), F.array(F.lit(False))).otherwise(ways)
    both = links.withColumn("reverse_link", F.explode(ways))
    turned = [F.when(F.col("reverse_link"), F.col(pair[c])).otherwise(F.col(c)).alias(c) if c in pair else F.col(c) for c in links.columns if c != geometry]
    if geometry:
        turned.append(F.when(F.col("reverse_link"), F.reverse(F.col(geometry))).otherwise(F.col(geometry)).alias(geometry))
    return both.select(*turned, "reverse_link")


def turns(edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every pair of directed edges of different links of which the second begins where the first ends, with azimuths, their change and the turn's class.

    `keep` names edge columns to carry for both sides (source_x, target_x).
    """
    e = edges.withColumn("azimuth", S.planar_azimuth(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    cols = ["linkid", "reverse_link", "A", "B", "azimuth", *keep]
    s, t = (e.select([F.col(c).alias(f"{side}_{c}") for c in cols]) for side in ("source", "target"))
    t_ = s.join(t, (F.col("source_B") == F.col("target_A")) & (F.col("source_linkid") != F.col("target_linkid")))
    change = S.angle_change(F.col("source_azimuth"), F.col("target_azimuth"))
    return t_.withColumn("azimuth_change", change).withColumn("turn_type", S.turn_class(F.col("azimuth_change")))


def degrees(links: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Number of link ends per node: N, degree."""
    return links.select(F.explode(F.array(a, b)).alias("N")).groupBy("N").agg(F.count(F.lit(1)).alias("degree"))


def nodes_of(links: DataFrame) -> DataFrame:
    """The nodes at the links' ends with their positions, each once: N, x, y."""
    ends = links.select(F.explode(F.array(F.struct(F.col("A").alias("N"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("B").alias("N"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("e.*")
    return ends.groupBy("N").agg(F.min(F.struct("x", "y")).alias("p")).select("N", "p.x", "p.y")


def cross_street(turns_: DataFrame, columns: Sequence[str], allowed: Column) -> DataFrame:
    """Per source edge, the worst (largest) of each target column over its left and right turns that are allowed."""
    side = turns_.where(F.col("turn_type").isin("left", "right") & allowed)
    return side.groupBy("source_linkid", "source_reverse_link").agg(*[F.max(f"target_{c}").alias(f"cross_{c}") for c in columns])


def signalized(turns_: DataFrame, signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns flagged `signalized` where their keys are among the (distinct) signals'."""
    return turns_.join(signals.select(*keys).distinct().withColumn("_s", F.lit(True)), list(keys), "left").withColumn("signalized", F.coalesce("_s", F.lit(False))).drop("_s")


def without_wrong_way(turns_: DataFrame, links: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Turns that don't go against a one-way link, except those listed by source and target link."""
    ways = links.where("oneway").select("linkid").distinct()
    wrong = lambda side: ways.select(F.col("linkid").alias(f"{side}_linkid"), F.lit(True).alias(f"{side}_reverse_link"), F.lit(True).alias(f"_{side}"))
    out = turns_.join(wrong("source"), ["source_linkid", "source_reverse_link"], "left").join(wrong("target"), ["target_linkid", "target_reverse_link"], "left")
    ok = F.col("_source").isNull() & F.col("_target").isNull()
    if exceptions is not None:
        out = out.join(exceptions.select("source_linkid", "target_linkid").distinct().withColumn("_ex", F.lit(True)), ["source_linkid", "target_linkid"], "left")
        ok = ok | F.col("_ex").isNotNull()
    return out.where(ok).select(*turns_.columns)


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Connected components: node, component (its smallest node).

    Alternating star contraction: edges are hung onto the smallest neighbour until every node hangs on its component's smallest. Rounds grow with
    the logarithm of the longest path; each is two aggregations and joins, its result written to the shared folder. Nodes with null ends are left out.
    """
    raw = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = raw.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    lone = raw.select(F.explode(F.array(a, b)).alias("node")).distinct()
    pairs = cut(pairs)
    state = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        new = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return lone.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(links: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Nodes of the component with most nodes (ties: the one with the smallest node)."""
    c = components(links, a, b)
    sizes = c.groupBy("component").count()
    best = sizes.agg(F.min_by("component", F.struct(-F.col("count"), F.col("component"))).alias("component"))
    return c.join(F.broadcast(best), "component").select("node")


def within_component(links: DataFrame, nodes: DataFrame, a: str = "A") -> DataFrame:
    """Links of the given nodes."""
    return links.join(nodes.select(F.col("node").alias(a)), a, "left_semi").select(*links.columns)


def ranges(n: int, of: int = 1_000_000) -> int:
    """Into how many parts n rows are divided to be numbered: 64, or a multiple of it from 64 million rows on."""
    return 64 * max(1, -(-n // (64 * of)))


def halves(links: DataFrame, first_node: int, first_link: int) -> DataFrame:
    """Each link cut at the middle into two straight ones with new node and link ids: linkid, source_linkid, A, B, ax, ay, bx, by, length_ft.

    New ids follow from the order of link ids (dense per range, without gathering the links in one task).
    """
    d = links.withColumn("_p", F.pmod(F.col("linkid"), F.lit(ranges(links.count()))))
    counts = d.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = d.join(F.broadcast(counts.select("_p", "_before")), "_p").withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("linkid")) + F.col("_before") - 1)
    mx, my, m = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2, F.lit(first_node) + F.col("_k")
    part = lambda i, a, b, ax, ay, bx, by: F.struct(
        (F.lit(first_link) + 2 * F.col("_k") + i).alias("linkid"), F.col("linkid").alias("source_linkid"), a.alias("A"), b.alias("B"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), (F.col("length_ft") / 2).alias("length_ft")
    )
    c = F.col
    return k.select(F.explode(F.array(part(0, c("A"), m, c("ax"), c("ay"), mx, my), part(1, m, c("B"), mx, my, c("bx"), c("by")))).alias("h")).select("h.*")


def chains_merged(links: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Chains of links through nodes of degree two become one: chain (smallest link), links (array, by id), length_ft, ends (array of its end nodes).

    `keep` lists nodes (N) that always end a chain. Links joined at a node of degree two are components of the graph of links.
    """
    inner = degrees(links).where("degree = 2").select("N")
    if keep is not None:
        inner = inner.join(keep.select("N"), "N", "left_anti")
    ends = links.select("linkid", F.explode(F.array("A", "B")).alias("N"))
    at = ends.join(inner, "N").groupBy("N").agg(F.min("linkid").alias("a"), F.max("linkid").alias("b")).where("a <> b")
    group = components(at, "a", "b").select(F.col("node").alias("linkid"), F.col("component").alias("chain"))
    out = links.join(group, "linkid", "left").withColumn("chain", F.coalesce("chain", "linkid"))
    outer = ends.join(inner, "N", "left_anti").join(group, "linkid", "left").withColumn("chain", F.coalesce("chain", "linkid")).groupBy("chain").agg(F.sort_array(F.collect_set("N")).alias("ends"))
    merged = out.groupBy("chain").agg(F.sort_array(F.collect_list("linkid")).alias("links"), F.sum("length_ft").alias("length_ft"))
    return merged.join(outer, "chain", "left")


def matching_network(links: DataFrame, allowed: Sequence[str], crooked: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """Links of allowed types in the largest component: those to keep whole, and those to cut (several between two nodes, or longer than `crooked` times their straight line)."""
    some = links.where(F.col("link_type").isin(*allowed))
    some = within_component(some, largest_component(some))
    pair = Window.partitionBy(F.least("A", "B"), F.greatest("A", "B"))
    straight = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    marked = some.withColumn("_cut", (F.count(F.lit(1)).over(pair) > 1) | (F.col("length_ft") > crooked * straight))
    return marked.where("not _cut").drop("_cut"), marked.where("_cut").drop("_cut")
