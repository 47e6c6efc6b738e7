"""Queries of network, spatial, impedance and routing operators and of the metrics on routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.common import cut
from pathloom.functions import scalars as S
from pathloom.operators import impedance as I
from pathloom.operators import metrics as M
from pathloom.operators import network as N
from pathloom.operators import relational as R
from pathloom.operators import routing as P
from pathloom.operators import spatial as X
from pathloom.operators.alongside import share_along
from pathloom.operators.transit import transfers
from pathloom.plans.fixtures import fixture
from pathloom.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
KEYS = ["source_linkid", "source_reverse_link", "target_linkid", "target_reverse_link"]
TERMS = [I.Term("is_road", "link", 0.5), I.Term("is_bike", "link", -0.2), I.Term("is_left", "turn", 0.1), I.Term("is_uturn", "turn", 0.3)]


def rounded(column: str, digits: int) -> Column:
    """Rounded for comparison; a billionth more, so that both engines round a tie the same way."""
    return F.round(F.col(column) + 1e-9, digits).alias(column)


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.directed(fixture(spark, sf_dir, "fx_links"))


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.turns(edges_of(spark, sf_dir), ["link_type", "length_ft"])


def costs_of(spark: SparkSession, sf_dir: str, road: float = 0.5) -> DataFrame:
    e = edges_of(spark, sf_dir).withColumn("is_road", (F.col("link_type") == "road").cast("int")).withColumn("is_bike", (F.col("link_type") == "bike").cast("int"))
    base = F.col("length_ft") / 5280 / 9 * 60
    terms = [I.Term("is_road", "link", road), *TERMS[1:]]
    return e.withColumn("base_min", base).withColumn("cost", I.link_cost(terms, F.col("base_min")))


def priced(spark: SparkSession, sf_dir: str, road: float = 0.5) -> DataFrame:
    t = turns_of(spark, sf_dir).withColumn("is_left", (F.col("turn_type") == "left").cast("int")).withColumn("is_uturn", (F.col("turn_type") == "uturn").cast("int"))
    return I.priced_turns(t, costs_of(spark, sf_dir, road), F.col("cost"), I.turn_cost(TERMS))


# --- network -------------------------------------------------------------------------------------------------


@query("select d.linkid, d.A, d.B, d.reverse_link, d.ax, d.by as y_end, d.length_ft from {fx_directed} d")
def directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).select("linkid", "A", "B", "reverse_link", "ax", F.col("by").alias("y_end"), "length_ft")


@query("select source_linkid, source_reverse_link, target_linkid, target_reverse_link, round(azimuth_change, 6) as azimuth_change, turn_type from {fx_turns}")
def turn_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_of(spark, sf_dir).select(*KEYS, F.round("azimuth_change", 6).alias("azimuth_change"), "turn_type")


@query("select N, min(x) as x, min(y) as y from (select l.A as N, l.ax as x, l.ay as y from {fx_links} l union all select l.B, l.bx, l.by from {fx_links} l) group by 1")
def nodes_from_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nodes_of(fixture(spark, sf_dir, "fx_links"))


@query("select N, count(*) as degree from (select A as N from {fx_links} union all select B from {fx_links}) group by 1")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.degrees(fixture(spark, sf_dir, "fx_links"))


@query("select source_linkid, source_reverse_link, max(target_length_ft) as cross_length_ft from {fx_turns} where turn_type in ('left', 'right') and source_link_type = 'road' and target_link_type = 'road' group by 1, 2")
def cross_street_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns_of(spark, sf_dir)
    return N.cross_street(t, ["length_ft"], (F.col("source_link_type") == "road") & (F.col("target_link_type") == "road"))


@query(
    """with c as (select source_linkid, source_reverse_link, max(target_length_ft) as m from {fx_turns} where turn_type in ('left', 'right') and source_link_type = 'road' and target_link_type = 'road' group by 1, 2),
    g as (select distinct source_linkid, target_linkid from {fx_turns} where (source_linkid + target_linkid) % 3 = 0)
    select t.source_linkid, t.source_reverse_link, t.target_linkid, t.target_reverse_link, g.source_linkid is not null as signalized,
      g.source_linkid is null and coalesce(c.m > 5000, false) and t.turn_type = 'straight' as unsig_crossing from {fx_turns} t
    left join c on c.source_linkid = t.source_linkid and c.source_reverse_link = t.source_reverse_link left join g on g.source_linkid = t.source_linkid and g.target_linkid = t.target_linkid"""
)
def unsignalised_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns_of(spark, sf_dir)
    signals = t.where((F.col("source_linkid") + F.col("target_linkid")) % 3 == 0)
    road = (F.col("source_link_type") == "road") & (F.col("target_link_type") == "road")
    out = N.signalized(t, signals, ["source_linkid", "target_linkid"]).join(N.cross_street(t, ["length_ft"], road), ["source_linkid", "source_reverse_link"], "left")
    crossing = ~F.col("signalized") & F.coalesce(F.col("cross_length_ft") > 5000, F.lit(False)) & (F.col("turn_type") == "straight")
    return out.select(*KEYS, "signalized", crossing.alias("unsig_crossing"))


@query(
    """select t.source_linkid, t.source_reverse_link, t.target_linkid, t.target_reverse_link from {fx_turns} t join {fx_links} s on s.linkid = source_linkid join {fx_links} g on g.linkid = target_linkid
    where not ((s.oneway and source_reverse_link) or (g.oneway and target_reverse_link)) or (s.status = 'P' and g.status = 'P')"""
)
def wrong_way_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, links = turns_of(spark, sf_dir), fixture(spark, sf_dir, "fx_links")
    p = links.where("status = 'P'").select("linkid")
    ok = t.join(p.select(F.col("linkid").alias("source_linkid")), "source_linkid", "left_semi").join(p.select(F.col("linkid").alias("target_linkid")), "target_linkid", "left_semi").select("source_linkid", "target_linkid").distinct()
    return N.without_wrong_way(t, links, ok).select(*KEYS)


_COMPONENTS = """with recursive r(N, c) using key (N) as (select N, N from (select A as N from {fx_links} union select B from {fx_links})
  union select e.b, min(r.c) from r join (select A as a, B as b from {fx_links} union select B, A from {fx_links}) e on e.a = r.N join recurring.r q on q.N = e.b where r.c < q.c group by e.b)
"""


@query(_COMPONENTS + "select N as node from r where c = (select c from (select c, count(*) as n from r group by 1) order by n desc, c limit 1)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.largest_component(fixture(spark, sf_dir, "fx_links"))


@query(_COMPONENTS + "select linkid from {fx_links} where A in (select N from r where c = (select c from (select c, count(*) as n from r group by 1) order by n desc, c limit 1))")
def remove_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = fixture(spark, sf_dir, "fx_links")
    return N.within_component(links, N.largest_component(links)).select("linkid")


@query(
    """with k as (select *, linkid % 64 as p from {fx_links}), n as (select p, count(*) as n from k group by 1), b as (select p, coalesce(sum(n) over (order by p rows between unbounded preceding and 1 preceding), 0) as before from n),
    r as (select k.*, cast(row_number() over (partition by k.p order by linkid) + before - 1 as bigint) as i from k join b on b.p = k.p)
    select 1000000 + 2 * i as linkid, linkid as source_linkid, A, 500000 + i as B, (ax + bx) / 2 as bx, round(length_ft / 2, 6) as length_ft from r
    union all select 1000000 + 2 * i + 1, linkid, 500000 + i, B, bx, round(length_ft / 2, 6) from r"""
)
def midpoint_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.halves(fixture(spark, sf_dir, "fx_links"), 500_000, 1_000_000).select("linkid", "source_linkid", "A", "B", "bx", F.round("length_ft", 6).alias("length_ft"))


@query()
def chains_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.chains_merged(fixture(spark, sf_dir, "fx_links"))


@query()
def match_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to keep whole and to cut for map matching, counted."""
    whole, halved = N.matching_network(fixture(spark, sf_dir, "fx_links"), ["road", "bike", "pedestrian"])
    count = lambda d, n: d.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(whole, "whole").unionByName(count(halved, "cut"))


# --- spatial -------------------------------------------------------------------------------------------------


@query(
    """with p as (select tripid, sequence, x, y from {fx_trace}), d as (select tripid, sequence, N, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) as d from p cross join {fx_nodes} n)
    select tripid, sequence, N, round(d, 6) as distance from (select *, row_number() over (partition by tripid, sequence order by d, N) as r from d) where r = 1"""
)
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "fx_trace").withColumn("key", F.struct("tripid", "sequence"))
    nodes = fixture(spark, sf_dir, "fx_nodes").select("N", F.col("x").alias("qx"), F.col("y").alias("qy"))
    return X.nearest(p, "key", nodes, "N").select("key.tripid", "key.sequence", "N", F.round("distance", 6).alias("distance"))


@query(
    """with d as (select n.N as taz, s.route_id, s.stop_id, sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2) as d from {fx_nodes} n join {fx_stops} s on abs(n.x - s.x) <= 1500 and abs(n.y - s.y) <= 1500)
    select taz, route_id, stop_id, round(d, 6) as distance from (select *, row_number() over (partition by taz, route_id order by d, stop_id) as r from d where d <= 1500) where r = 1"""
)
def candidate_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each zone the nearest stop of every route within reach."""
    zones = fixture(spark, sf_dir, "fx_nodes").select(F.col("N").alias("taz"), "x", "y")
    stops = fixture(spark, sf_dir, "fx_stops").select("stop_id", "route_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    return X.nearest_of_groups(zones, "taz", stops, "route_id", "stop_id", 1500.0).withColumn("distance", F.round("distance", 6))


@query("select N from {fx_nodes} n where not exists (select 1 from {fx_stops} s where sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2) <= 700)")
def spatial_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with no stop within a distance."""
    stops = fixture(spark, sf_dir, "fx_stops").select(F.col("x").alias("qx"), F.col("y").alias("qy"))
    return X.beyond(fixture(spark, sf_dir, "fx_nodes"), stops, 700.0, ("x", "y"), ("qx", "qy"), "N").select("N")


@query(
    """with recursive p as (select a.stop_id as a, b.stop_id as b from {fx_stops} a join {fx_stops} b on a.stop_id <> b.stop_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 600),
    r(s, c) using key (s) as (select stop_id, stop_id from {fx_stops} union select p.b, min(r.c) from r join p on p.a = r.s join recurring.r q on q.s = p.b where r.c < q.c group by p.b)
    select x.s as from_stop, y.s as to_stop, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4.4, 4) as seconds from r x join r y on x.c = y.c and x.s <> y.s join {fx_stops} a on a.stop_id = x.s join {fx_stops} b on b.stop_id = y.s"""
)
def transfers_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking transfers between stops less than a distance apart, and between all that are linked through others."""
    return transfers(fixture(spark, sf_dir, "fx_stops"), 600.0, 4.4).withColumn("seconds", F.round("seconds", 4))


@query()
def side_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each road runs within a buffer of a path, and at which angle: pairs with at least half."""
    links = fixture(spark, sf_dir, "fx_links")
    road, path = links.where("link_type = 'road'"), links.where("link_type = 'bike'").withColumnRenamed("linkid", "path_id")
    return share_along(road, "linkid", path, "path_id", 50.0, 50.0, 0.2, 30.0).withColumn("share", F.round("share", 6)).withColumn("angle", F.round("angle", 6))


# --- impedance and routing -----------------------------------------------------------------------------------


@query("select linkid, reverse_link, round(base_min + 1e-9, 6) as base_min, round(cost + 1e-9, 6) as cost from {fx_costs}")
def link_impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs_of(spark, sf_dir).select("linkid", "reverse_link", rounded("base_min", 6), rounded("cost", 6))


@query("select source_linkid, source_reverse_link, target_linkid, target_reverse_link, turn_cost from {fx_priced}")
def turn_impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select(*KEYS, "turn_cost")


@query("select source_linkid, source_reverse_link, target_linkid, target_reverse_link, round(total_cost + 1e-9, 5) as total_cost from {fx_priced}")
def impedance_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select(*KEYS, rounded("total_cost", 5))


@query(
    """select linkid, network_year, case when year > network_year then 0 else lane end as lane, coalesce(year > network_year and path > 0, false) as blocked
    from (select linkid, year, cast(link_type = 'bike' as int) as lane, cast(link_type = 'pedestrian' as int) as path from {fx_links}), (select distinct year - 1 as network_year from {fx_links})"""
)
def year_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = fixture(spark, sf_dir, "fx_links").select("linkid", "year", (F.col("link_type") == "bike").cast("int").alias("lane"), (F.col("link_type") == "pedestrian").cast("int").alias("path"))
    years = links.select((F.col("year") - 1).alias("network_year")).distinct()
    return I.year_networks(links, years, "year", ["lane"], ["path"]).select("linkid", "network_year", "lane", "blocked")


@query(
    """select linkid, case when kind is null then lane else cast(kind = 'lane' as int) end as lane, case when kind is null then cycletrack else cast(kind = 'cycletrack' as int) end as cycletrack from
    (select linkid, cast(link_type = 'bike' as int) as lane, cast(link_type = 'service' as int) as cycletrack, case status when 'P' then 'cycletrack' when 'F' then 'lane' end as kind from {fx_links})"""
)
def scenario_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = fixture(spark, sf_dir, "fx_links").select("linkid", "status", (F.col("link_type") == "bike").cast("int").alias("lane"), (F.col("link_type") == "service").cast("int").alias("cycletrack"))
    projects = links.where("status in ('P', 'F')").select("linkid", F.when(F.col("status") == "P", "cycletrack").otherwise("lane").alias("kind"))
    return I.improved(links.drop("status"), projects, "linkid", ["lane", "cycletrack"], "kind")


#: What turns cost by class, of TERMS.
TURNS = {"left": 0.1, "uturn": 0.3}


def links_of(spark: SparkSession, sf_dir: str, roads: dict[str, float], keep: str | None = None, base: bool = False) -> P.Links:
    """The graph of all links, with a variant of costs for each coefficient of roads, and with `base` one of base minutes alone, where turns cost nothing."""
    e = edges_of(spark, sf_dir).withColumn("azimuth", S.planar_azimuth(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    e = e.withColumn("is_road", (F.col("link_type") == "road").cast("int")).withColumn("is_bike", (F.col("link_type") == "bike").cast("int")).withColumn("base_min", F.col("length_ft") / 5280 / 9 * 60)
    for name, road in roads.items():
        e = e.withColumn(f"c_{name}", I.link_cost([I.Term("is_road", "link", road), *TERMS[1:]], F.col("base_min")))
    costs = {n: (f"c_{n}", TURNS) for n in roads} | ({"base": ("base_min", {})} if base else {})
    return P.link_graph(e, costs, keep)


def zone_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_od_nodes").select("origin").distinct()


_STATES = """{name}(origin, linkid, reverse_link, d) using key (origin, linkid, reverse_link) as (
  select origin, linkid, reverse_link, cost from o join {{fx_costs{when}}} c on c.A = o.origin {cut0}
  union
  select n.origin, n.linkid, n.reverse_link, n.d from (select r.origin, t.target_linkid as linkid, t.target_reverse_link as reverse_link, min(r.d + t.total_cost) as d
    from {name} r join {{fx_priced{when}}} t on t.source_linkid = r.linkid and t.source_reverse_link = r.reverse_link group by 1, 2, 3) n
  left join recurring.{name} q on q.origin = n.origin and q.linkid = n.linkid and q.reverse_link = n.reverse_link where (q.d is null or n.d < q.d) {cut1})
"""


def reach_sql(cutoff: float | None = None, then: bool = False) -> str:
    """Least costs of directed links from each zone by recursion; with `then` a second time (rt) when roads are improved."""
    cuts = {"cut0": f"where cost <= {cutoff}", "cut1": f"and n.d <= {cutoff}"} if cutoff else {"cut0": "", "cut1": ""}
    parts = [_STATES.format(name="r", when="", **cuts), *([_STATES.format(name="rt", when="_then", **cuts)] if then else [])]
    return "with recursive o as (select distinct origin from {fx_od_nodes}),\n" + ",\n".join(parts)


@query(
    reach_sql()
    + """select p.origin, p.dest, round(case when p.origin = p.dest then 0 else min(r.d) end + 1e-9, 5) as cost from (select distinct origin, dest from {fx_od_nodes}) p join {fx_costs} c on c.B = p.dest
    join r on r.origin = p.origin and r.linkid = c.linkid and r.reverse_link = c.reverse_link group by 1, 2"""
)
def shortest_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least impedance of all zone pairs."""
    return routes_of(spark, sf_dir).select("origin", "dest", rounded("d", 5).alias("cost"))


@query(reach_sql(25) + "select origin, linkid, reverse_link, round(d + 1e-9, 5) as d from r")
def bounded_sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links within a cost of each zone."""
    found = P.link_reach(links_of(spark, sf_dir, {"now": 0.5}), zone_origins(spark, sf_dir), 25.0, whole=True)
    return found.select("origin", "linkid", "reverse_link", rounded("d_now", 5).alias("d"))


@query(reach_sql(25) + "select origin, count(*) as links, round(sum(length_ft) / 5280, 4) as miles from (select distinct origin, r.linkid, length_ft from r join {fx_links} l on l.linkid = r.linkid) group by 1")
def bikeshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.link_reach(links_of(spark, sf_dir, {"now": 0.5}, "length_ft"), zone_origins(spark, sf_dir), 25.0)
    return s.groupBy("origin").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("keep") / 5280, 4).alias("miles"))


@query(
    reach_sql(25, then=True)
    + """select origin, change, count(*) as links from (select origin, linkid, 'removed' as change from (select origin, linkid from r except select origin, linkid from rt)
    union all select origin, linkid, 'added' from (select origin, linkid from rt except select origin, linkid from r)) group by 1, 2"""
)
def bikeshed_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that a scenario adds to the sheds or takes from them."""
    s = P.link_reach(links_of(spark, sf_dir, {"now": 0.5, "then": 0.1}), zone_origins(spark, sf_dir), 25.0)
    change = F.when(F.col("d_then").isNull(), "removed").when(F.col("d_now").isNull(), "added")
    return s.withColumn("change", change).where("change is not null").groupBy("origin", "change").agg(F.count(F.lit(1)).alias("links"))


def routes_of(spark: SparkSession, sf_dir: str, roads: dict[str, float] | None = None, base: bool = False) -> DataFrame:
    """Least-impedance routes of all zone pairs: variant, origin, dest, d, edges; with `base` those by base minutes alone too."""
    return P.link_routes(links_of(spark, sf_dir, roads or {"now": 0.5}, base=base), fixture(spark, sf_dir, "fx_od_nodes"))


#: Least-cost routes walked back from the links that reach a pair's end: w(origin, dest, linkid, reverse_link).
_WALKED = """, rm as materialized (select * from r), fp as materialized (select * from {fx_priced}),
  pairs as materialized (select origin, dest, sum(trips) as trips from {fx_od_nodes} group by 1, 2),
  ends as materialized (select p.origin, p.dest, r.linkid, r.reverse_link, row_number() over (partition by p.origin, p.dest order by round(r.d, 9), r.linkid, r.reverse_link) as k from pairs p join {fx_costs} c on c.B = p.dest
    join rm r on r.origin = p.origin and r.linkid = c.linkid and r.reverse_link = c.reverse_link where p.origin <> p.dest),
  every as (select origin, linkid, reverse_link from ends where k = 1 union select w.origin, t.source_linkid, t.source_reverse_link from every w join rm me on me.origin = w.origin and me.linkid = w.linkid and me.reverse_link = w.reverse_link
    join fp t on t.target_linkid = w.linkid and t.target_reverse_link = w.reverse_link join rm q on q.origin = w.origin and q.linkid = t.source_linkid and q.reverse_link = t.source_reverse_link where abs(q.d + t.total_cost - me.d) < 1e-9),
  pr as materialized (select r.origin, r.linkid, r.reverse_link, min(struct_pack(l := t.source_linkid, b := t.source_reverse_link)) as s from every v join rm r on r.origin = v.origin and r.linkid = v.linkid and r.reverse_link = v.reverse_link
    join fp t on t.target_linkid = r.linkid and t.target_reverse_link = r.reverse_link
    join rm q on q.origin = r.origin and q.linkid = t.source_linkid and q.reverse_link = t.source_reverse_link where abs(q.d + t.total_cost - r.d) < 1e-9 group by 1, 2, 3),
  w as (select origin, dest, linkid, reverse_link from ends where k = 1 union all select w.origin, w.dest, pr.s.l, pr.s.b from w join pr on pr.origin = w.origin and pr.linkid = w.linkid and pr.reverse_link = w.reverse_link)
"""


@query(reach_sql() + _WALKED + "select linkid, reverse_link, cast(sum(trips) as bigint) as trips from w join pairs on pairs.origin = w.origin and pairs.dest = w.dest group by 1, 2")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips over each directed link of the least-impedance routes."""
    edges = P.edges_of_routes(routes_of(spark, sf_dir))
    od = fixture(spark, sf_dir, "fx_od_nodes").groupBy("origin", "dest").agg(F.sum("trips").alias("trips"))
    return M.betweenness(edges, od, ["origin", "dest"], "trips", ["linkid", "reverse_link"])


@query()
def percent_detour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip-weighted detour by origin zone: minutes of the least-impedance route against the shortest."""
    found = cut(routes_of(spark, sf_dir, base=True))
    edges = P.edges_of_routes(found.where("variant = 'now'"))
    minutes = edges.join(costs_of(spark, sf_dir).select("linkid", "reverse_link", "base_min"), ["linkid", "reverse_link"]).groupBy("origin", "dest").agg(F.sum("base_min").alias("minutes"))
    od = fixture(spark, sf_dir, "fx_od_nodes").join(minutes, ["origin", "dest"]).join(found.where("variant = 'base'").select("origin", "dest", F.col("d").alias("least")), ["origin", "dest"])
    out = M.by_zone(od.withColumn("pct", M.percent_detour(F.col("minutes"), F.col("least"))), "orig_taz", F.col("pct"), "trips")
    return out.withColumn("value", F.round("value", 6))


@query(
    reach_sql(then=True)
    + """, p as (select distinct origin, dest from {fx_od_nodes}), c as (select linkid, reverse_link, B from {fx_costs}),
    a as (select p.origin, p.dest, case when p.origin = p.dest then 0 else min(r.d) end as now from p join c on c.B = p.dest join r on r.origin = p.origin and r.linkid = c.linkid and r.reverse_link = c.reverse_link group by 1, 2),
    b as (select p.origin, p.dest, case when p.origin = p.dest then 0 else min(rt.d) end as fut from p join c on c.B = p.dest join rt on rt.origin = p.origin and rt.linkid = c.linkid and rt.reverse_link = c.reverse_link group by 1, 2)
    select orig_taz, round(sum((now - fut) * trips) / sum(trips) + 1e-9, 5) as value, cast(sum(trips) as bigint) as trips from {fx_od_nodes} x join a on a.origin = x.origin and a.dest = x.dest join b on b.origin = x.origin and b.dest = x.dest group by 1"""
)
def impedance_change_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip-weighted reduction of the least impedance by zone when roads are improved."""
    ods = fixture(spark, sf_dir, "fx_od_nodes")
    found = cut(routes_of(spark, sf_dir, {"now": 0.5, "then": 0.1}).select("variant", "origin", "dest", "d"))
    d = {n: found.where(F.col("variant") == n).select("origin", "dest", F.col("d").alias(n)) for n in ("now", "then")}
    both = ods.join(d["now"], ["origin", "dest"]).join(d["then"], ["origin", "dest"])
    return M.by_zone(both, "orig_taz", F.col("now") - F.col("then"), "trips").withColumn("value", rounded("value", 5))


@query(
    """select linkid, reverse_link, round(change, 6) as change from (select linkid, reverse_link, cost * (case link_type when 'road' then 1.1 / 1.5 else 1 end) - cost as change,
    row_number() over (partition by linkid order by cost * (case link_type when 'road' then 1.1 / 1.5 else 1 end) - cost, reverse_link) as r from {fx_costs}) where r = 1"""
)
def link_impedance_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = costs_of(spark, sf_dir).withColumn("future", F.col("cost") * F.when(F.col("link_type") == "road", 1.1 / 1.5).otherwise(1.0))
    return M.most_reduced(c, "linkid", "cost", "future", ["reverse_link"]).withColumn("change", F.round("change", 6))


@query(
    """select link_type, year, round(sum(length_ft * (length_ft / 10000 - 0.5) * (linkid % 17)), 2) as contribution, round(sum(length_ft * (length_ft / 10000 - 0.5) * (linkid % 17)) / (sum(length_ft) / 5280), 4) as per_mile
    from {fx_links} group by 1, 2"""
)
def impedance_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = fixture(spark, sf_dir, "fx_links").withColumn("change", F.col("length_ft") / 10000 - 0.5).withColumn("trips", F.col("linkid") % 17)
    out = M.contribution(links, ["link_type", "year"], "length_ft", "change", "trips")
    return out.withColumn("contribution", F.round("contribution", 2)).withColumn("per_mile", F.round("per_mile", 4))


# --- losses and attributes of routes -------------------------------------------------------------------------

_PAIRS = """with a as (select tripid, linkid, len from {fx_routes} where kind = 'chosen'), b as (select tripid, linkid, len from {fx_routes} where kind = 'modeled'),
  u as (select coalesce(a.tripid, b.tripid) as tripid, coalesce(a.len, b.len) as len, a.tripid is not null and b.tripid is not null as shared from a full join b on a.tripid = b.tripid and a.linkid = b.linkid),
  j as (select tripid, coalesce(sum(case when shared then len end), 0) as intersection_len, sum(len) as union_len from u group by 1)
"""


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixture(spark, sf_dir, "fx_routes")
    return M.jaccard(r.where("kind = 'chosen'"), r.where("kind = 'modeled'"), "tripid", ["linkid"], "len")


@query(_PAIRS + "select tripid, round(intersection_len, 4) as intersection_len, round(union_len, 4) as union_len, round(intersection_len / union_len, 6) as jaccard from j")
def jaccard_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(spark, sf_dir).select("tripid", F.round("intersection_len", 4).alias("intersection_len"), F.round("union_len", 4).alias("union_len"), F.round("jaccard", 6).alias("jaccard"))


@query(_PAIRS + "select round(-avg(intersection_len / union_len), 6) as loss_mean, round(-sum(intersection_len) / sum(union_len), 6) as loss_total, count(*) as trips from j")
def jaccard_exact_mean_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.jaccard_losses(pairs_of(spark, sf_dir)).select(F.round("loss_mean", 6).alias("loss_mean"), F.round("loss_total", 6).alias("loss_total"), "trips")


@query(
    """select c.tripid, round((c.l - m.l) / m.l, 6) as detour from (select tripid, sum(len) as l from {fx_routes} where kind = 'chosen' group by 1) c
    join (select tripid, sum(len) as l from {fx_routes} where kind = 'modeled' group by 1) m on c.tripid = m.tripid"""
)
def detour_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = fixture(spark, sf_dir, "fx_routes").groupBy("tripid").agg(*[F.sum(F.when(F.col("kind") == k, F.col("len"))).alias(k) for k in ("chosen", "modeled")])
    return lengths.where("chosen is not null and modeled is not null").select("tripid", F.round(M.detour(F.col("chosen"), F.col("modeled")), 6).alias("detour"))


@query(
    _PAIRS + """select count(*) as n, cast(sum(case when coalesce(intersection_len / c.l >= 0.1, false) then 1 else 0 end) as bigint) as recovered, round(avg(case when coalesce(intersection_len / c.l >= 0.1, false) then 1.0 else 0 end), 6) as share
    from j left join (select tripid, sum(len) as l from a group by 1) c on c.tripid = j.tripid"""
)
def first_preference_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = fixture(spark, sf_dir, "fx_routes").where("kind = 'chosen'").groupBy("tripid").agg(F.sum("len").alias("chosen_len"))
    out = M.recovered(pairs_of(spark, sf_dir).join(chosen, "tripid", "left"), F.col("chosen_len"), 0.1)
    return out.withColumn("share", F.round("share", 6))


@query("select subset, calibration_name, run_num, round(-avg(jaccard_exact), 4) as loss_mean, round(-sum(intersection_len) / sum(union_len), 4) as loss_total, count(*) as trips from {fx_models} group by 1, 2, 3")
def aggregated_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.aggregated_loss(fixture(spark, sf_dir, "fx_models"), ["subset", "calibration_name", "run_num"])


@query(
    """with m as (select tripid, subset, calibration_name, run_num, jaccard_exact, count(*) over (partition by tripid) as runs, row_number() over (partition by tripid order by jaccard_exact desc, subset, calibration_name, run_num) as r from {fx_models})
    select tripid, subset, calibration_name, run_num, runs from m where r = 1"""
)
def best_model_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "fx_models").select("tripid", "subset", "calibration_name", "run_num", "jaccard_exact")
    best = R.best_row(m, ["tripid"], F.col("jaccard_exact"), ["subset", "calibration_name", "run_num"], largest=True)
    return best.join(m.groupBy("tripid").agg(F.count(F.lit(1)).alias("runs")), "tripid").select("tripid", "subset", "calibration_name", "run_num", "runs")


@query(
    """with r as (select tripid, len, s_nationkey as z from {fx_routes} join {supplier} on s_suppkey = linkid where kind = 'chosen')
    select tripid, round(sum(len), 4) as length, round(sum(case when z < 5 then len else 0 end) / sum(len), 6) as low, round(coalesce(sum(case when z between 10 and 12 then len else 0 end) / nullif(sum(case when z >= 10 then len else 0 end), 0), 0), 6) as mid
    from r group by 1"""
)
def route_attribute_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("linkid"), F.col("s_nationkey").alias("z"))
    r = fixture(spark, sf_dir, "fx_routes").where("kind = 'chosen'").join(s, "linkid")
    z = F.col("z")
    out = M.attribute_shares(r, "tripid", "len", {"low": z < 5, "mid": z.between(10, 12)}, {"mid": z >= 10})
    return out.select("tripid", F.round("length", 4).alias("length"), F.round("low", 6).alias("low"), F.round("mid", 6).alias("mid"))


@query(
    """with c as (select tripid, sum(len) as l, count(*) as n from {fx_routes} where kind = 'chosen' group by 1), m as (select tripid, sum(len) as l, count(*) as n from {fx_routes} where kind = 'modeled' group by 1)
    select attribute, round(v, 0) as ssd from (select sum((coalesce(c.l, 0) - coalesce(m.l, 0)) ** 2) as l, sum(cast((coalesce(c.n, 0) - coalesce(m.n, 0)) ** 2 as double)) as n from c full join m on c.tripid = m.tripid) unpivot (v for attribute in (l, n))"""
)
def sum_squared_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixture(spark, sf_dir, "fx_routes")
    side = lambda k: r.where(F.col("kind") == k).groupBy("tripid").agg(F.sum("len").alias("l"), F.count(F.lit(1)).cast("double").alias("n"))
    return M.squared_differences(side("chosen"), side("modeled"), "tripid", ["l", "n"]).withColumn("ssd", F.round("ssd", 0))


@query(
    """select linkid, count(distinct case when kind = 'chosen' then tripid end) as fwd, count(distinct case when kind = 'modeled' then tripid end) as rev, count(distinct tripid) as trips from {fx_routes} group by 1"""
)
def trips_per_link_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixture(spark, sf_dir, "fx_routes")
    of = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("tripid")))
    return r.groupBy("linkid").agg(of("chosen").alias("fwd"), of("modeled").alias("rev"), F.countDistinct("tripid").alias("trips"))


@query(
    """select l_suppkey as linkid, count(distinct o_custkey) as users, """
    + ", ".join(f"cast(sum(case when year(o_orderdate) = {y} then 1 else 0 end) as bigint) as y{y}" for y in (1996, 1997, 1998))
    + " from {lineitem} join {orders} on l_orderkey = o_orderkey group by 1"
)
def users_years_per_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = fixture(spark, sf_dir, "lineitem"), fixture(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    years = [F.sum((F.year("o_orderdate") == y).cast("bigint")).alias(f"y{y}") for y in (1996, 1997, 1998)]
    return rows.groupBy(F.col("l_suppkey").alias("linkid")).agg(F.countDistinct("o_custkey").alias("users"), *years)
