"""Queries of geometry, map matching, calibration and transit operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.common import cut, table
from pathloom.functions import geometry as G
from pathloom.operators import calibration as C
from pathloom.operators import impedance as I
from pathloom.operators import map_matching as H
from pathloom.operators import metrics as M
from pathloom.operators import routing as P
from pathloom.operators import transit as Z
from pathloom.operators.spatial import distance_join
from pathloom.plans.fixtures import fixture
from pathloom.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


# --- geometry ------------------------------------------------------------------------------------------------


@query("select tripid, round(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 4) as length from (select tripid, x, y, lag(x) over w as px, lag(y) over w as py from {fx_trace} window w as (partition by tripid order by sequence)) group by 1")
def trace_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("tripid", F.round(G.line_length(F.col("line")), 4).alias("length"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixture(spark, sf_dir, "fx_trace")
    packed = t.groupBy("tripid").agg(F.sort_array(F.collect_list(F.struct("sequence", "x", "y"))).alias("p"))
    return packed.select("tripid", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))


@query(
    """with p as (select a.tripid, a.x as x, a.y as y, b.x as qx, b.y as qy, a.sequence as i, b.sequence as j from {fx_trace} a join {fx_trace} b on b.tripid = a.tripid + 1),
    d as (select *, sqrt((x - qx) ** 2 + (y - qy) ** 2) as d from p), m as (select tripid, i, min(d) as d from d group by 1, 2), n as (select tripid, j, min(d) as d from d group by 1, 2)
    select m.tripid, round(greatest(max(m.d), max(n.d)), 4) as hausdorff from (select tripid, max(d) as d from m group by 1) m join (select tripid, max(d) as d from n group by 1) n on m.tripid = n.tripid group by m.tripid"""
)
def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hausdorff distance of each trace's vertices and the next one's."""
    a = lines_of(spark, sf_dir)
    b = a.select((F.col("tripid") - 1).alias("tripid"), F.col("line").alias("other"))
    return a.join(b, "tripid").select("tripid", F.round(G.vertex_hausdorff(F.col("line"), F.col("other")), 4).alias("hausdorff"))


@query()
def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines_of(spark, sf_dir)
    b = a.select((F.col("tripid") - 1).alias("tripid"), F.col("line").alias("other"))
    return a.join(b, "tripid").select("tripid", F.round(G.frechet_pandas("line", "other"), 4).alias("frechet"))


@query(
    """with l as (select l.linkid, l.ax, l.bx, sqrt((l.bx - l.ax) ** 2 + (l.by - l.ay) ** 2) as length_ft from {fx_links} l), g as (select *, unnest(generate_series(0, cast(case when length_ft <= 1000 then 1 else ceil(length_ft / 1000) - 1 end as bigint))) as k from l)
    select linkid, k, round(case when length_ft <= 1000 and k = 1 then g.bx else g.ax + (g.bx - g.ax) * k * 1000 / length_ft end + 1e-7, 2) as x from g"""
)
def points_on_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points every thousand feet along links; the ends alone for shorter ones."""
    c = F.col
    links = fixture(spark, sf_dir, "fx_links").withColumn("line", G.line((c("ax"), c("ay")), (c("ax") + (c("bx") - c("ax")) * 0.25, c("ay") + (c("by") - c("ay")) * 0.25), (c("bx"), c("by"))))
    return links.select("linkid", F.posexplode(G.points_every(F.col("line"), 1000.0)).alias("k", "p")).select("linkid", F.col("k").cast("bigint").alias("k"), F.round(F.col("p.x") + 1e-7, 2).alias("x"))


@query()
def simplified_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("tripid", F.size("line").alias("points"), F.size(G.simplify_pandas(1500.0)("line")).alias("kept"))


@query()
def jaccard_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the buffers of each trace and the next one."""
    a = lines_of(spark, sf_dir)
    b = a.select((F.col("tripid") - 1).alias("tripid"), F.col("line").alias("other"))
    pairs = a.join(b, "tripid").withColumn("j", G.jaccard_buffer_pandas(100.0, 50.0)("line", "other"))
    return pairs.select("tripid", F.round("j.jaccard", 6).alias("jaccard"))


@query()
def name_fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixture(spark, sf_dir, "fx_names")
    other = n.select((F.col("id") - 1).alias("id"), F.col("name").alias("other"))
    return n.join(other, "id").select("id", F.round(G.name_ratio_pandas("name", "other"), 6).alias("ratio"))


# --- map matching --------------------------------------------------------------------------------------------


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ping of every recording on today's streets (straight from end to end, in feet), failed recordings with wider rules."""
    g = table(spark, sf_dir, "links").where("removed_at is null and A is not null and B is not null and size(geometry) > 1")
    first, last = F.get("geometry", F.lit(0)), F.get("geometry", F.size("geometry") - 1)
    edges = g.groupBy("linkid", "reverse_link").agg(F.min(F.struct("A", "B", first["x"].alias("ax"), first["y"].alias("ay"), last["x"].alias("bx"), last["y"].alias("by"))).alias("e")).select("linkid", "reverse_link", "e.*")
    pings = table(spark, sf_dir, "coords").where("x is not null and y is not null").groupBy("tripid", "sequence").agg(F.min(F.struct("x", "y")).alias("p")).select("tripid", "sequence", "p.x", "p.y")
    return H.match_again(pings, edges, H.MatchRules(radius=150.0, noise=40.0, way=80.0))


@query()
def hmm_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = H.match_summary(matched(spark, sf_dir))
    return s.select("tripid", F.round("match_ratio", 6).alias("match_ratio"), F.round("mean_distance", 4).alias("mean_distance"), F.size("edges").alias("links"))


@query()
def match_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.triage(H.match_summary(matched(spark, sf_dir)), table(spark, sf_dir, "trips_df").where("tripid is not null"))


# --- calibration ---------------------------------------------------------------------------------------------


def street_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The streets of today, the turns between them, and the pairs of zones' nodes with trips, of the domain tables."""
    now = table(spark, sf_dir, "links").where("removed_at is null and A is not null and B is not null and travel_time_min is not null")
    edges = now.groupBy("linkid", "reverse_link").agg(
        F.min("A").alias("A"), F.min("B").alias("B"), F.min("travel_time_min").alias("base_min"), F.min("length_ft").alias("len"),
        F.max((F.col("link_type") == "road").cast("int")).alias("is_road"), F.max((F.col("facility_fwd").isNotNull()).cast("int")).alias("has_facility"),
    )
    t = table(spark, sf_dir, "turns_df").where("source_linkid is not null and target_linkid is not null")
    turns = t.groupBy("source_linkid", "source_reverse_link", "target_linkid", "target_reverse_link").agg(F.max("left_turn").alias("left_turn"), F.max(F.coalesce("signalized", F.lit(False)).cast("int")).alias("signalized"))
    ods = table(spark, sf_dir, "od_matrix").where("orig_N is not null and dest_N is not null").groupBy(F.col("orig_N").alias("origin"), F.col("dest_N").alias("dest")).agg(F.sum("trips").alias("trips"))
    return edges, turns, ods


STREETS = [I.Term("is_road", "link", 0.5), I.Term("has_facility", "link", -0.3), I.Term("left_turn", "turn", 0.15), I.Term("signalized", "turn", 0.1)]


def street_routes(spark: SparkSession, sf_dir: str, population: list[list[I.Term]], ways: bool = True) -> DataFrame:
    """Routes of all zone pairs for every set of coefficients: candidate, origin, dest, d, edges (see routes)."""
    edges, turns, ods = street_network(spark, sf_dir)
    edges, turns = cut(edges), cut(turns)
    names = [t.col for t in population[0]]
    betas = spark.createDataFrame([(i, *[float(t.beta) for t in terms]) for i, terms in enumerate(population)], ", ".join(["candidate int", *[f"b_{c} double" for c in names]]))
    # one plan for all sets: their coefficients are columns
    total = lambda kind: reduce(lambda a, b: a + b, [F.col(f"b_{t.col}") * F.col(t.col) * F.lit(1.0) for t in population[0] if t.type == kind], F.lit(0.0))
    costs = edges.crossJoin(F.broadcast(betas)).withColumn("c", F.bround(F.col("base_min") * (1 + total("link")), 8))
    starts = ods.select("origin").distinct().join(costs, F.col("origin") == F.col("A")).select("candidate", "origin", "linkid", "reverse_link", F.col("c").alias("d"))
    target = costs.select("candidate", F.col("linkid").alias("target_linkid"), F.col("reverse_link").alias("target_reverse_link"), F.col("c").alias("target_cost"))
    priced = turns.crossJoin(F.broadcast(betas)).withColumn("turn_cost", F.bround(total("turn"), 8)).join(target, ["candidate", "target_linkid", "target_reverse_link"])
    sum_ = F.col("target_cost") + F.col("turn_cost")
    priced = priced.withColumn("total_cost", F.when(sum_.isNull() | (sum_ < 0), F.raise_error(F.lit("a turn has no cost or a negative one")).cast("double")).otherwise(sum_))
    return P.routes(starts, priced, edges, ods, ways=ways)


#: The street network of street_network in SQL: edges with their cost, priced turns, pairs.
_STREETS = """e as (select linkid, reverse_link, min(A) as A, min(B) as B, min(travel_time_min) as base_min, max((coalesce(link_type = 'road', false))::int) as is_road, max((facility_fwd is not null)::int) as has_facility{year}
    from {{links}} where removed_at is null and A is not null and B is not null and travel_time_min is not null group by 1, 2),
  t as (select source_linkid, source_reverse_link, target_linkid, target_reverse_link, max(left_turn) as left_turn, max(coalesce(signalized, false)::int) as signalized from {{turns_df}}
    where source_linkid is not null and target_linkid is not null group by 1, 2, 3, 4)"""

_COST = "round_even(base_min * (1 + 0.5 * is_road - 0.3 * has_facility), 8)"


@query(
    "with recursive "
    + _STREETS.format(year="")
    + f""", c as (select *, {_COST} as cost from e), p as (select t.*, c.cost + round_even(0.15 * left_turn + 0.1 * signalized, 8) as total from t join c on c.linkid = t.target_linkid and c.reverse_link = t.target_reverse_link),
    od as (select distinct orig_N as origin, dest_N as dest from {{od_matrix}} where orig_N is not null and dest_N is not null),
    r(origin, linkid, reverse_link, d) using key (origin, linkid, reverse_link) as (select o.origin, linkid, reverse_link, cost from (select distinct origin from od) o join c on c.A = o.origin
      union select n.origin, n.linkid, n.reverse_link, n.d from (select r.origin, p.target_linkid as linkid, p.target_reverse_link as reverse_link, min(r.d + p.total) as d from r join p on p.source_linkid = r.linkid and p.source_reverse_link = r.reverse_link group by 1, 2, 3) n
      left join recurring.r q on q.origin = n.origin and q.linkid = n.linkid and q.reverse_link = n.reverse_link where q.d is null or n.d < q.d - 1e-12)
    select od.origin as origin, od.dest as dest, round(case when od.origin = od.dest then 0 else min(r.d) end + 1e-9, 5) as cost from od join c on c.B = od.dest join r on r.origin = od.origin and r.linkid = c.linkid and r.reverse_link = c.reverse_link group by 1, 2"""
)
def od_route_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least impedance of every pair of the OD matrix on the street network; the routes themselves are od_routes."""
    return street_routes(spark, sf_dir, [STREETS], ways=False).select("origin", "dest", F.round(F.col("d") + 1e-9, 5).alias("cost"))


@query()
def od_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-impedance routes of the OD matrix on the street network: cost and number of links."""
    return street_routes(spark, sf_dir, [STREETS]).select("origin", "dest", F.round("d", 6).alias("cost"), F.size("edges").alias("links"))


def routes_by_year(spark: SparkSession, sf_dir: str, ways: bool = True) -> DataFrame:
    """Routes of all pairs on the network of their own year: facilities built later are not there yet, off-street links of later years are closed, and pairs that only they connect have no route. year, origin, dest, d, edges."""
    edges, turns, _ = street_network(spark, sf_dir)
    built = table(spark, sf_dir, "links").where("removed_at is null").groupBy("linkid", "reverse_link").agg(F.max("year").alias("built"))
    edges = edges.join(built, ["linkid", "reverse_link"], "left").withColumn("off_street", 1 - F.col("is_road"))
    asked = table(spark, sf_dir, "od_matrix").where("orig_N is not null and dest_N is not null and built_at is not null")
    ods = asked.select(F.year("built_at").alias("candidate"), F.col("orig_N").alias("origin"), F.col("dest_N").alias("dest")).distinct()
    years = ods.select(F.col("candidate").alias("network_year")).distinct()
    then = I.year_networks(edges, years, "built", ["has_facility"], ["off_street"])
    priced = then.withColumn("c", F.when(F.col("blocked"), I.BLOCKED).otherwise(I.link_cost(STREETS, F.col("base_min")))).withColumn("candidate", F.col("network_year"))
    first = ods.select("candidate", "origin").distinct().join(priced, (F.col("A") == F.col("origin")) & (priced["candidate"] == ods["candidate"]))
    starts = first.select(priced["candidate"], "origin", "linkid", "reverse_link", F.col("c").alias("d"))
    target = priced.select("candidate", F.col("linkid").alias("target_linkid"), F.col("reverse_link").alias("target_reverse_link"), "c")
    costs = turns.withColumn("turn_cost", I.turn_cost(STREETS)).join(target, ["target_linkid", "target_reverse_link"]).withColumn("total_cost", F.col("c") + F.col("turn_cost"))
    return P.routes(starts, costs, edges, ods, ways=ways).where(F.col("d") < I.BLOCKED).withColumnRenamed("candidate", "year")


@query(
    "with recursive "
    + _STREETS.format(year=", max(year) as built")
    + f""", od as (select distinct cast(year(built_at) as integer) as year, orig_N as origin, dest_N as dest from {{od_matrix}} where orig_N is not null and dest_N is not null and built_at is not null),
    c as (select y.year as year, linkid, reverse_link, A, B, case when coalesce(built > y.year, false) and is_road = 0 then 9e9 else {_COST.replace("has_facility", "case when coalesce(built > y.year, false) then 0 else has_facility end")} end as cost
      from e, (select distinct year from od) y),
    p as (select c.year, t.*, c.cost + round_even(0.15 * left_turn + 0.1 * signalized, 8) as total from t join c on c.linkid = t.target_linkid and c.reverse_link = t.target_reverse_link),
    r(year, origin, linkid, reverse_link, d) using key (year, origin, linkid, reverse_link) as (select o.year, o.origin, linkid, reverse_link, cost from (select distinct year, origin from od) o join c on c.A = o.origin and c.year = o.year
      union select n.year, n.origin, n.linkid, n.reverse_link, n.d from (select r.year, r.origin, p.target_linkid as linkid, p.target_reverse_link as reverse_link, min(r.d + p.total) as d from r join p on p.year = r.year and p.source_linkid = r.linkid and p.source_reverse_link = r.reverse_link group by 1, 2, 3, 4) n
      left join recurring.r q on q.year = n.year and q.origin = n.origin and q.linkid = n.linkid and q.reverse_link = n.reverse_link where q.d is null or n.d < q.d - 1e-12)
    select od.year as year, od.origin as origin, od.dest as dest, round(case when od.origin = od.dest then 0 else min(r.d) end + 1e-9, 5) as cost from od join c on c.B = od.dest and c.year = od.year
    join r on r.year = od.year and r.origin = od.origin and r.linkid = c.linkid and r.reverse_link = c.reverse_link group by 1, 2, 3 having min(r.d) < 9e9 or od.origin = od.dest"""
)
def od_costs_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least impedance of each pair on the network of the year it is asked for."""
    return routes_by_year(spark, sf_dir, ways=False).select("year", "origin", "dest", F.round(F.col("d") + 1e-9, 5).alias("cost"))


@query()
def pso_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coefficients searched for in routes made with known ones: the best loss after each round, then each coefficient as it was and as it was found. Each
    round's swarm is priced and routed in one job."""
    lengths = street_network(spark, sf_dir)[0].select("linkid", "reverse_link", "len")
    routed = lambda population: P.edges_of_routes(street_routes(spark, sf_dir, population)).join(lengths, ["linkid", "reverse_link"])
    truth = cut(routed([STREETS]).drop("candidate"))

    def evaluate(population: list[list[I.Term]]) -> list[float]:
        every = truth.withColumn("candidate", F.explode(F.array(*[F.lit(i) for i in range(len(population))])))
        key = F.struct("candidate", "origin", "dest")
        pairs = M.jaccard(every.withColumn("trip", key), routed(population).withColumn("trip", key), "trip", ["linkid", "reverse_link"], "len").withColumn("candidate", F.col("trip.candidate"))
        found = {r["candidate"]: r["loss"] for r in C.LOSSES["jaccard_total"](pairs).collect()}
        return [found.get(i) for i in range(len(population))]

    free = [I.Term(x.col, x.type, range=r) for x, r in zip(STREETS, ((0.0, 2.0), (-0.9, 0.5), (0.0, 1.0), (0.0, 1.0)))]
    betas, loss, trace = C.fit(free, evaluate, C.Swarm(size=10, rounds=10, seed=1))
    rows = [(k, float(v), None, None, None) for k, v in trace] + [(None, loss, t.col, t.beta, round(b, 6)) for t, b in zip(STREETS, betas)]
    return spark.createDataFrame(rows, "round int, loss double, term string, known double, found double")


# --- transit -------------------------------------------------------------------------------------------------


def arrivals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = Z.Walks(fixture(spark, sf_dir, "fx_stops"), 400.0, 4.4)
    sources = fixture(spark, sf_dir, "fx_sources").select(F.col("stop_id").alias("source"), "stop_id", F.lit(1800).alias("at"))
    return Z.least_arrivals(sources, fixture(spark, sf_dir, "fx_stop_times"), walks, 2)


_ARRIVALS = """with recursive p as (select a.stop_id as a, b.stop_id as b from {fx_stops} a join {fx_stops} b on a.stop_id <> b.stop_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 400),
g(s, c) using key (s) as (select stop_id, stop_id from {fx_stops} union select p.b, min(g.c) from g join p on p.a = g.s join recurring.g q on q.s = p.b where g.c < q.c group by p.b),
w as (select x.s as f, y.s as t, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4.4 as sec from g x join g y on x.c = y.c and x.s <> y.s join {fx_stops} a on a.stop_id = x.s join {fx_stops} b on b.stop_id = y.s
  union all select stop_id, stop_id, 0 from {fx_stops}),
s as (select trip_id, stop_sequence as q, stop_id, cast(departure_sec as double) as c from {fx_stop_times}),
r0 as (select stop_id as source, t as stop_id, 1800 + sec as arr from {fx_sources} join w on f = stop_id),
b1 as (select source, trip_id, min(q) as q from r0 join s on s.stop_id = r0.stop_id and arr <= c group by 1, 2),
r1 as (select source, w.t as stop_id, min(c + sec) as arr from b1 join s on s.trip_id = b1.trip_id and s.q > b1.q join w on w.f = s.stop_id group by 1, 2),
m1 as (select source, stop_id, min(arr) as arr from (select * from r0 union all select * from r1) group by 1, 2),
b2 as (select source, trip_id, min(q) as q from m1 join s on s.stop_id = m1.stop_id and arr <= c group by 1, 2),
r2 as (select source, w.t as stop_id, min(c + sec) as arr from b2 join s on s.trip_id = b2.trip_id and s.q > b2.q join w on w.f = s.stop_id group by 1, 2),
m2 as (select source, stop_id, min(arr) as arr from (select * from m1 union all select * from r2) group by 1, 2)
"""


@query(_ARRIVALS + "select source, stop_id, round(arr, 4) as arrival from m2")
def raptor_earliest_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest arrival from a stop of each nation at every other with at most two rides, at one departure, as its SQL has it; raptor_all_departures is the whole."""
    return arrivals_of(spark, sf_dir).select("source", "stop_id", F.round("arrival", 4).alias("arrival"))


@query(_ARRIVALS + "select source as zone, count(*) as destinations, round(avg(arr - 1800), 4) as mean_s from m2 where source <> stop_id group by 1")
def taz_transit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrivals_of(spark, sf_dir).where("source <> stop_id").select(F.col("source").alias("zone"), F.col("stop_id").alias("dest"), (F.col("arrival") - 1800).alias("travel_s"), "rides")
    return Z.zone_metrics(a, "zone").select("zone", "destinations", F.round("mean_s", 4).alias("mean_s"))


def departures_of(trips: Z.Trips) -> range:
    """Every quarter of an hour until the last call."""
    last = trips.rows.agg(F.max("last")).first()[0]
    return range(0, -1 if last is None else int(last) + 1, 900)


def itineraries_from(sources: DataFrame, departures: range, trips: Z.Trips, walks: Z.Walks) -> DataFrame:
    """From stops (source) at each departure: source, departure, stop_id, arrival, rides."""
    slots = sources.sparkSession.range(departures.start, max(departures.stop, 0), departures.step).withColumnRenamed("id", "departure")
    every = sources.select("source", F.col("source").alias("stop_id")).distinct().crossJoin(F.broadcast(slots)).withColumn("at", F.col("departure"))
    return Z.search_itineraries(every, trips, walks, 2)


@query()
def raptor_all_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest arrival from every stop at every other with at most two rides, for each departure."""
    stops, trips = fixture(spark, sf_dir, "fx_stops"), Z.trips_of(fixture(spark, sf_dir, "fx_stop_times"))
    every = itineraries_from(stops.select(F.col("stop_id").alias("source")), departures_of(trips), trips, Z.Walks(stops, 400.0, 4.4))
    return every.select("source", "departure", "stop_id", F.round("arrival", 4).alias("arrival"), "rides")


@query()
def transit_metrics_all_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones (nations) by the best trips from any of their stops at any departure. Stops that a zone reaches on foot sooner than any ride ends need no search."""
    stops, trips = fixture(spark, sf_dir, "fx_stops"), Z.trips_of(fixture(spark, sf_dir, "fx_stop_times"))
    departures, walks = departures_of(trips), Z.Walks(stops, 400.0, 4.4)
    zones = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("source"), F.col("c_nationkey").cast("bigint").alias("zone"))
    zones = zones.join(stops.select(F.col("stop_id").alias("source")), "source")
    walked = Z.walked_bests(zones, departures, trips, walks)
    least = walked.where("settled").select("zone", "dest", F.lit(0).alias("rides"), "travel_s")
    left = walked.where("not settled").select(F.col("zone").alias("_zone"), F.col("dest").alias("_dest"))
    if not left.isEmpty():
        some = cut(zones.join(left.select("_zone").distinct(), F.col("zone").eqNullSafe(F.col("_zone")), "left_semi"))
        found = itineraries_from(some, departures, trips, walks).where("source <> stop_id").join(F.broadcast(some), "source")
        # only the least time of each number of rides can matter
        best = found.groupBy("zone", F.col("stop_id").alias("dest"), "rides").agg(F.min(F.col("arrival") - F.col("departure")).alias("travel_s"))
        least = least.unionByName(best.join(left, F.col("zone").eqNullSafe(F.col("_zone")) & (F.col("dest") == F.col("_dest")), "left_semi"))
    return Z.zone_metrics(least, "zone").select("zone", "destinations", F.round("mean_s", 4).alias("mean_s"), F.round("mean_rides", 4).alias("mean_rides"))


@query(
    """with r as (select distinct stop_id, route_id from {fx_stop_times}), p as (select a.stop_id as a, b.stop_id as b from {fx_stops} a join {fx_stops} b on a.stop_id < b.stop_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 900)
    select a, b from p where not exists (select 1 from r x join r y on x.route_id = y.route_id where x.stop_id = p.a and y.stop_id = p.b)"""
)
def same_route_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "fx_stops")
    a, b = s.select(F.col("stop_id").alias("a"), "x", "y"), s.select(F.col("stop_id").alias("b"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    pairs = distance_join(a, b, 900.0).where("a < b").select("a", "b")
    return Z.same_route_excluded(pairs, fixture(spark, sf_dir, "fx_stop_times"), "a", "b")
