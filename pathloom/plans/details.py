"""Queries of single rules and small steps: names, ways, times, bins, appends, batches, segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.common import table
from pathloom.functions import geometry as G
from pathloom.functions import scalars as S
from pathloom.functions import tags as T
from pathloom.operators import conflation as K
from pathloom.operators import impedance as I
from pathloom.operators import metrics as M
from pathloom.operators import relational as R
from pathloom.operators import spatial as X
from pathloom.operators import traces as O
from pathloom.operators import transit as Z
from pathloom.plans.fixtures import fixture
from pathloom.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def rounded(c: str | Column, digits: int) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


# --- numbers -------------------------------------------------------------------------------------------------


@query("select linkid, round(length_ft / 5280 / 9 * 60 + 1e-9, 6) as minutes, round(length_ft * 0.3048 + 1e-9, 4) as metres from {fx_links}")
def base_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes at a constant speed, and the length in metres."""
    return fixture(spark, sf_dir, "fx_links").select("linkid", rounded(S.base_minutes(F.col("length_ft"), 9.0), 6).alias("minutes"), rounded(F.col("length_ft") * 0.3048, 4).alias("metres"))


@query("select linkid, cast(linkid as varchar) as id from {fx_links}")
def normal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that came as decimals, as text without them."""
    return fixture(spark, sf_dir, "fx_links").select("linkid", S.normal_id(F.concat(F.col("linkid").cast("string"), F.lit(".0"))).alias("id"))


@query(
    """select linkid, case when grade < 2 then 'flat' when grade < 5 then 'mild' when grade < 9.5 then 'steep' end as grade, case speed_class when 0 then '25' when 1 then '35' when 2 then '45' end as speed,
    case when lanes_a is null or lanes_a < 0 then null when lanes_a <= 1 then 'one' when lanes_a <= 3 then 'few' when lanes_a <= 4 then 'many' end as lanes from {fx_attributes}"""
)
def attributes_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins closed on the left and on the right, and values by a dictionary."""
    a = fixture(spark, sf_dir, "fx_attributes")
    return a.select(
        "linkid", S.left_closed_bin(F.col("grade"), [0, 2, 5, 9.5], ["flat", "mild", "steep"]).alias("grade"), T.recoded(F.col("speed_class").cast("string"), {"0": "25", "1": "35", "2": "45"}).alias("speed"),
        S.right_closed_bin(F.col("lanes_a"), [0, 1, 3, 4], ["one", "few", "many"]).alias("lanes"),
    )


@query("select linkid, cast(linkid % 60 + 5 as double) as speed, cast(linkid % 9 as integer) as lanes from {fx_links}")
def tag_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from tag texts like '35 mph'; what is none is null."""
    rows = fixture(spark, sf_dir, "fx_links").withColumn("s", F.concat((F.col("linkid") % 60 + 5).cast("string"), F.lit(" mph"))).withColumn("l", (F.col("linkid") % 9).cast("string"))
    return rows.select("linkid", T.speed_of(F.col("s")).alias("speed"), T.number_of(F.col("l")).alias("lanes"))


@query(
    """select linkid, coalesce(lanes_a > 3, false)::int as wide, coalesce(facility_fwd = 'bike lane', false)::int as lane, not (coalesce(lanes_a > 3, false) or coalesce(facility_fwd = 'bike lane', false)) as base
    from {fx_attributes}"""
)
def base_case_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions as 0/1 columns and whether none holds."""
    a = fixture(spark, sf_dir, "fx_attributes")
    flagged = a.select("linkid", *S.flags({"wide": F.col("lanes_a") > 3, "lane": F.col("facility_fwd") == "bike lane"}))
    return flagged.withColumn("base", S.base_case(["wide", "lane"]))


@query("select linkid, case when year > 1995 then null else facility_fwd end as facility_fwd from {fx_attributes} where not (year > 1995 and link_type <> 'road')")
def future_facilities_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was built after a year: roads lose the facility, other links go."""
    a, later = fixture(spark, sf_dir, "fx_attributes"), F.col("year") > 1995
    return a.where(~(later & (F.col("link_type") != "road"))).select("linkid", F.when(~later, F.col("facility_fwd")).alias("facility_fwd"))


@query("select linkid, case linkid % 5 when 0 then false when 1 then true when 2 then false when 3 then false else true end as rideable from {fx_links}")
def paved_cycleways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycleways that are paved and open to bicycles."""
    surface = {0: {"highway": "cycleway", "surface": "gravel"}, 1: {"highway": "cycleway"}, 2: {"highway": "path"}, 3: {"highway": "cycleway", "bicycle": "no"}, 4: {"highway": "path", "bicycle": "yes", "surface": "asphalt"}}
    tags = F.coalesce(*[F.when(F.col("linkid") % 5 == k, F.create_map(*[F.lit(x) for p in t.items() for x in p])) for k, t in surface.items()])
    return fixture(spark, sf_dir, "fx_links").select("linkid", T.rideable(tags).alias("rideable"))


@query("select linkid, round(greatest(0.01, minutes * (1 + case when off then 0 else 0.2 * lanes + 0.1 * grade end)) + 1e-9, 6) as cost from (select linkid, round(length_ft / 5280 / 9 * 60 + 1e-9, 4) as minutes, linkid % 5 as lanes, linkid % 9 as grade, link_type = 'bike' as off from {fx_links})")
def legacy_impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_links").select("linkid", rounded(F.col("length_ft") / 5280 / 9 * 60, 4).alias("minutes"), (F.col("linkid") % 5).alias("lanes"), (F.col("linkid") % 9).alias("grade"), (F.col("link_type") == "bike").alias("off"))
    return rows.select("linkid", rounded(I.legacy_cost(F.col("minutes"), {"lanes": 0.2, "grade": 0.1}, F.col("off")), 6).alias("cost"))


@query("select linkid, round(length_ft * (1 + linkid % 4 * 0.25 + linkid % 3 * 0.5 * (1 - linkid % 2 * 0.5)) + 1e-9, 4) as cost from {fx_links}")
def lowry_impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("linkid")
    return fixture(spark, sf_dir, "fx_links").select("linkid", rounded(I.lowry_cost(F.col("length_ft"), k % 4 * 0.25, k % 3 * 0.5, k % 2 * 0.5), 4).alias("cost"))


@query("select linkid, reverse_link, round((cost - base_min) / nullif(base_min, 0) + 1e-9, 3) + 0.0 as share from {fx_costs} where not reverse_link")
def impedance_change_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which share the coefficients change a link's base cost."""
    c = fixture(spark, sf_dir, "fx_costs").where("not reverse_link")
    return c.select("linkid", "reverse_link", (rounded((F.col("cost") - F.col("base_min")) / F.nullif(F.col("base_min"), F.lit(0.0)), 3) + 0.0).alias("share"))


@query("select linkid, reverse_link, round(base_min + 1e-9, 6) as cost from {fx_costs}")
def base_costs_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs without coefficients are the base again."""
    return fixture(spark, sf_dir, "fx_costs").select("linkid", "reverse_link", rounded(I.link_cost([], F.col("base_min")), 6).alias("cost"))


@query(
    """select a, b, c, round(0.5 * a - 0.3 * b + 0.15 * c, 2) as impedance from (select unnest([0, 1]) as a) cross join (select unnest([0, 1]) as b) cross join (select unnest([0, 1]) as c)"""
)
def scenario_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of indicators with their impedance: the dot product with the coefficients."""
    bits = F.array(*[F.col(c) for c in "abc"])
    rows = spark.range(8).select(*[F.shiftright("id", i).bitwiseAND(F.lit(1)).cast("int").alias(c) for i, c in enumerate("abc")])
    dot = F.aggregate(F.zip_with(bits, F.array(*[F.lit(x) for x in (0.5, -0.3, 0.15)]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select("a", "b", "c", F.round(dot, 2).alias("impedance"))


# --- names and ways ------------------------------------------------------------------------------------------

_TOKENS = "list_filter(string_split_regex(trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda t: t <> '')"
_NAMED = "(select distinct linkid, name from {links} where linkid is not null and name is not null)"


def _cases(words: dict[str, str]) -> str:
    return "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in words.items()) + " else t end"


def _listed(words: object) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"select distinct linkid, name, array_to_string(list_transform({_TOKENS}, lambda t: {_cases({v: k for k, v in {**S.SUFFIXES, **S.DIRECTIONS}.items()} | S.ALSO_EXPANDED)}), ' ') as expanded from {_NAMED}")
def names_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street names with their abbreviations written out."""
    n = table(spark, sf_dir, "links").where("linkid is not null and name is not null").select("linkid", "name").distinct()
    return n.select("linkid", "name", S.expand_name(F.col("name")).alias("expanded"))


@query(
    f"""with t as (select linkid, name, list_filter({_TOKENS}, lambda t: t not in {_listed([*S.DIRECTIONS, *S.DIRECTIONS.values()])}) as w from {_NAMED})
    select linkid, name, nullif(array_to_string(case when len(w) > 1 and w[-1] in {_listed([*S.SUFFIXES, *S.SUFFIXES.values()])} then w[:-2] else w end, ' '), '') as own from t"""
)
def names_without_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets' own names."""
    n = table(spark, sf_dir, "links").where("linkid is not null and name is not null").select("linkid", "name").distinct()
    return n.select("linkid", "name", S.remove_suffix(F.col("name")).alias("own"))


_SIGNALS = "(select p_partkey as id, p_name || ' (' || p_brand || ') & ' || p_type || ' at ' || p_size as name from {part})"


@query(f"select id, unnest(list_filter(list_transform(string_split(regexp_replace(lower(name), '[()&@]|\\s+at\\s+', '/', 'g'), '/'), lambda t: trim(t)), lambda t: t <> '')) as street from {_SIGNALS}")
def signal_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets that one field of a signal names."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") & "), "p_type", F.lit(" at "), F.col("p_size").cast("string")).alias("name"))
    return s.select("id", F.explode(S.split_names(F.col("name"))).alias("street"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of six nodes (each third a ring), and links of three nodes along, against or across them."""
    k = F.col("linkid")
    way = F.concat(F.sequence(k * 10, k * 10 + 5), F.when(k % 3 == 0, F.array(k * 10)).otherwise(F.array().cast("array<bigint>")))
    part = F.sequence(k * 10 + k % 4, k * 10 + k % 4 + 2)
    nodes = F.when(k % 5 == 0, F.array(k * 10 + 5, k * 10, k * 10 + 1)).when(k % 5 == 1, F.reverse(part)).when(k % 5 == 2, F.array(k, k + 1)).otherwise(part)
    far = F.transform(way, lambda _, i: (i * 100).cast("double"))
    return fixture(spark, sf_dir, "fx_links").select("linkid", way.alias("way"), nodes.alias("nodes"), far.alias("far"))


@query("select linkid, case when linkid % 5 in (0, 1, 2) then -1 else cast(linkid % 4 as integer) end as place from {fx_links}")
def sublist_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a link's nodes begin in their way, -1 where they don't stand in it."""
    return ways(spark, sf_dir).select("linkid", F.coalesce(S.sublist_start(F.col("way"), F.col("nodes")), F.lit(-1)).alias("place"))


@query("select linkid, case linkid % 5 when 0 then case when linkid % 3 = 0 then 'forward' end when 1 then 'reverse' when 2 then null else 'forward' end as direction from {fx_links}")
def way_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether links run along their way, over the closing of a ring too."""
    return ways(spark, sf_dir).select("linkid", S.sequence_direction(F.col("nodes"), F.col("way")).alias("direction"))


@query(
    """select linkid, case linkid % 5 when 0 then case when linkid % 3 = 0 then 500.0 end when 2 then null else linkid % 4 * 100.0 end as start,
    case linkid % 5 when 0 then case when linkid % 3 = 0 then 700.0 end when 2 then null else linkid % 4 * 100.0 + 200 end as stop from {fx_links}"""
)
def places_along_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links begin and end along their way."""
    w = ways(spark, sf_dir).withColumn("a", S.along_way(F.col("nodes"), F.col("way"), F.col("far")))
    return w.select("linkid", F.col("a.start").alias("start"), F.col("a.end").alias("stop"))


@query("select linkid, linkid * 4 + case when reverse_link then 2 else 0 end + case when oneway then 1 else 0 end as packed, reverse_link, oneway from {fx_directed}")
def link_ids_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and flags in one number, and out of it again."""
    e = fixture(spark, sf_dir, "fx_directed").select("linkid", F.shiftleft("linkid", 2).bitwiseOR(F.col("reverse_link").cast("bigint") * 2).bitwiseOR(F.col("oneway").cast("bigint")).alias("packed"))
    bit = lambda i: F.shiftright("packed", i).bitwiseAND(F.lit(1)) == 1
    return e.select(F.shiftright("packed", 2).alias("linkid"), "packed", bit(1).alias("reverse_link"), bit(0).alias("oneway"))


# --- geometry ------------------------------------------------------------------------------------------------

_BEARING = "(degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360"


@query(
    f"""with n as (select N, max(lon) as lon, max(lat) as lat from {{nodes}} where lon is not null and lat is not null group by 1), l as (select distinct linkid, A, B from {{links}} where linkid is not null)
    select linkid, l.A as A, l.B as B, round({_BEARING} + 1e-9, 4) as bearing, round({_BEARING} + 1e-9, 1) % 360 as azimuth from l join n a on a.N = l.A join n b on b.N = l.B where a.N <> b.N"""
)
def link_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle bearing from a link's first node to its last, and the azimuth to a tenth of a degree."""
    n = table(spark, sf_dir, "nodes").where("lon is not null and lat is not null").groupBy("N").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"))
    end = lambda c: n.select(F.col("N").alias(c), F.col("lon").alias(f"lon_{c}"), F.col("lat").alias(f"lat_{c}"))
    l = table(spark, sf_dir, "links").where("linkid is not null").select("linkid", "A", "B").distinct().join(end("A"), "A").join(end("B"), "B").where("A <> B")
    b = S.bearing(F.col("lat_A"), F.col("lon_A"), F.col("lat_B"), F.col("lon_B"))
    return l.select("linkid", "A", "B", rounded(b, 4).alias("bearing"), (rounded(b, 1) % 360).alias("azimuth"))


@query("select linkid, 3 as points, round(2 * length_ft, 3) as length_ft, bx as mid_x from (select l.linkid, l.length_ft, l.bx from {fx_links} l)")
def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a link and its way back as one, as turns and routes are drawn."""
    there = G.line((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))
    both = fixture(spark, sf_dir, "fx_links").select("linkid", G.route_line(F.array(there, F.reverse(there))).alias("line"))
    return both.select("linkid", F.size("line").alias("points"), F.round(G.line_length(F.col("line")), 3).alias("length_ft"), F.get("line", F.lit(1))["x"].alias("mid_x"))


@query("select cast(floor(x / 500) as bigint) as cx, cast(floor(y / 500) as bigint) as cy, count(*) as nodes from {fx_nodes} group by 1, 2")
def grid_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes counted by the cells of a grid over their box; cells without any have no row."""
    n = fixture(spark, sf_dir, "fx_nodes")
    xs, ys = G.grid_cells(0.0, 0.0, 10_008.0, 10_008.0, 500.0)
    spots = n.where((F.col("x") >= xs[0]) & (F.col("x") < xs[-1] + 500) & (F.col("y") >= ys[0]) & (F.col("y") < ys[-1] + 500))
    return spots.groupBy(F.floor(F.col("x") / 500).alias("cx"), F.floor(F.col("y") / 500).alias("cy")).agg(F.count(F.lit(1)).alias("nodes"))


@query(
    """with p as (select s.stop_id, s.x, s.y, l.linkid, l.ax, l.ay, l.bx, l.by, greatest(0, least(1, ((s.x - l.ax) * (l.bx - l.ax) + (s.y - l.ay) * (l.by - l.ay)) / nullif((l.bx - l.ax) ** 2 + (l.by - l.ay) ** 2, 0))) as t
      from {fx_stops} s, {fx_links} l where l.link_type = 'bike'), d as (select stop_id, linkid, sqrt((x - (p.ax + t * (p.bx - p.ax))) ** 2 + (y - (p.ay + t * (p.by - p.ay))) ** 2) as d from p)
    select stop_id, linkid, round(d + 1e-9, 4) as distance from (select *, row_number() over (partition by stop_id order by round(d, 6), linkid) as r from d where d <= 300) where r = 1"""
)
def nearest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bike link nearest to each stop, within a distance."""
    links = fixture(spark, sf_dir, "fx_links").where("link_type = 'bike'").select("linkid", "ax", "ay", "bx", "by")
    near = X.near_segments(fixture(spark, sf_dir, "fx_stops").select("stop_id", "x", "y"), links, 300.0, 600.0).dropDuplicates(["stop_id", "linkid"])
    best = near.groupBy("stop_id").agg(F.min(F.struct(F.round("distance", 6).alias("d"), "linkid")).alias("b"))
    return best.select("stop_id", F.col("b.linkid").alias("linkid"), rounded("b.d", 4).alias("distance"))


@query(
    """with n as (select n.N, s.stop_id from {fx_nodes} n join {fx_stops} s on abs(n.x - s.x) <= 200 and abs(n.y - s.y) <= 200 and sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2) <= 200),
    e as (select N, round(avg(stop_id % 50), 6) as elevation, count(*) as points from n group by 1) select * from e"""
)
def elevation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the elevation points around each node."""
    points = fixture(spark, sf_dir, "fx_stops").select((F.col("stop_id") % 50).alias("elev"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    near = X.distance_join(fixture(spark, sf_dir, "fx_nodes").select("N", "x", "y"), points, 200.0)
    return near.groupBy("N").agg(F.round(F.avg("elev"), 6).alias("elevation"), F.count(F.lit(1)).alias("points"))


@query("select distinct N from {fx_nodes} n join {fx_stops} s on abs(n.x - s.x) <= 500 and abs(n.y - s.y) <= 500 and sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2) <= 500")
def stop_buffer_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones whose centre lies in the buffer of any stop."""
    stops = fixture(spark, sf_dir, "fx_stops").select(F.col("x").alias("qx"), F.col("y").alias("qy"))
    return X.distance_join(fixture(spark, sf_dir, "fx_nodes").select("N", "x", "y"), stops, 500.0).select("N").distinct()


@query("select link_type, count(*) as parts, round(sum(length_ft), 2) as length_ft from {fx_links} group by 1")
def dissolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each type as one multi-part geometry (parts joined, none lost), with their summed length."""
    return R.dissolve(fixture(spark, sf_dir, "fx_links").withColumn("line", G.line((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))), ["link_type"], "line", {"length_ft": F.sum("length_ft")}).select(
        "link_type", F.col("n").alias("parts"), F.round("length_ft", 2).alias("length_ft")
    )


# --- times ---------------------------------------------------------------------------------------------------


@query("select event_id, epoch_ms(cast(round_even(epoch_us(ts) / 60000000.0, 0) as bigint) * 60000) as minute, cast(hour(ts) as integer) as hour, cast(year(ts) as integer) as year, round(epoch_us(ts) % 86400000000 / 60000000.0 + 1e-9, 1) as minutes from {events}")
def times_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to the nearest minute, their parts, and minutes since midnight."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    of_day = F.pmod(F.unix_micros("t"), F.lit(86_400_000_000)) / 60_000_000.0
    return e.select("event_id", S.nearest_minute(F.col("t")).cast("timestamp_ntz").alias("minute"), F.hour("t").alias("hour"), F.year("t").alias("year"), rounded(of_day, 1).alias("minutes"))


@query("select distinct orig_N as origin, dest_N as dest, cast(year(built_at) as integer) as year from {od_matrix} where orig_N is not null and dest_N is not null and built_at is not null")
def od_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs with the year in which they are asked for, latest first."""
    o = table(spark, sf_dir, "od_matrix").where("orig_N is not null and dest_N is not null and built_at is not null")
    return o.select(F.col("orig_N").alias("origin"), F.col("dest_N").alias("dest"), F.year("built_at").alias("year")).distinct().orderBy(F.desc("year"), "origin", "dest")


# --- rows ----------------------------------------------------------------------------------------------------


@query("select linkid, cast(null as varchar) as other_linkid, cast(null as varchar) as other_A from {fx_links}")
def join_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty columns for the ids of another network's matches."""
    return fixture(spark, sf_dir, "fx_links").select("linkid", *[F.lit(None).cast("string").alias(f"other_{c}") for c in ("linkid", "A")])


@query("select a.n_nationkey as orig, b.n_nationkey as dest, s.scenario from {nation} a, {nation} b, (select unnest(['current', 'future']) as scenario) s where a.n_nationkey <> b.n_nationkey")
def zone_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of zones (a list of bounded length), in each scenario."""
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey"))
    pairs = n.select(F.col("n_nationkey").alias("orig")).join(n.select(F.col("n_nationkey").alias("dest")), F.col("orig") != F.col("dest"))
    return pairs.withColumn("scenario", F.explode(F.array(F.lit("current"), F.lit("future"))))


@query("select linkid, status, round(sum(price) over (partition by A), 2) as of_node, count(*) over (partition by A) as n, bool_or(oneway) over (partition by A) as any_oneway from {fx_links}")
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a group on each of its rows."""
    w = Window.partitionBy("A")
    total = F.round(F.sum("price").over(w), 2).cast("double").alias("of_node")
    return fixture(spark, sf_dir, "fx_links").withColumn("price", F.col("price").cast("decimal(18,2)")).select("linkid", "status", total, F.count(F.lit(1)).over(w).alias("n"), F.bool_or("oneway").over(w).alias("any_oneway"))


@query("select distinct linkid, reverse_link, added_at from {links}")
def rows_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "links").dropDuplicates(["linkid", "reverse_link", "added_at"]).select("linkid", "reverse_link", "added_at")


@query("select tripid, sequence, cast(row_number() over (partition by tripid order by sequence desc) as integer) as back, sequence // 100 as batch from {fx_trace}")
def rows_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered from the end of each trip, and in batches of a fixed size."""
    w = Window.partitionBy("tripid").orderBy(F.desc("sequence"))
    return fixture(spark, sf_dir, "fx_trace").select("tripid", "sequence", F.row_number().over(w).alias("back"), F.floor(F.col("sequence") / 100).cast("int").alias("batch"))


@query("select tripid, sequence from (select tripid, sequence, row_number() over (partition by tripid order by sequence) as r from (select tripid, sequence, sequence - lag(sequence) over (partition by tripid order by sequence) as d from (select * from {fx_trace} where event_id % 3 <> 0)) where d = 1) where r <= 5")
def consecutive_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first points of each trip that directly follow one another."""
    t = fixture(spark, sf_dir, "fx_trace").where("event_id % 3 <> 0")
    return O.first_gaps(t, "tripid", "sequence", 5).select("tripid", "sequence")


@query("select linkid, link_type from {fx_links} where link_type = 'road' union all select linkid, link_type from {fx_links} where link_type <> 'road' and linkid not in (select linkid - 1 from {fx_links} where link_type = 'road')")
def features_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of another network that no match covers, added to the base."""
    l = fixture(spark, sf_dir, "fx_links").select("linkid", "link_type")
    base = l.where("link_type = 'road'")
    rest = l.where("link_type <> 'road'").join(base.select((F.col("linkid") - 1).alias("linkid")), "linkid", "left_anti")
    return base.unionByName(rest)


@query("select linkid, sum(n) as n from (select l_suppkey as linkid, count(*) as n from {lineitem} where l_linenumber <= 3 group by 1 union all select l_suppkey, count(*) from {lineitem} where l_linenumber > 3 group by 1) group by 1")
def batches_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two batches, merged."""
    l = table(spark, sf_dir, "lineitem")
    part = lambda c: l.where(c).groupBy(F.col("l_suppkey").alias("linkid")).agg(F.count(F.lit(1)).alias("n"))
    return part("l_linenumber <= 3").unionByName(part("l_linenumber > 3")).groupBy("linkid").agg(F.sum("n").alias("n"))


@query(
    """with p as (select c_nationkey as key, c_custkey as id, c_custkey % 3 = 0 as no, c_custkey % 4 = 0 as yes, cast(c_custkey % 101 as double) as d from {customer}),
    q as (select *, count(*) filter (not no) over (partition by key) as n, min(case when not no then d end) over (partition by key) as least from p),
    s as (select *, not no and n = 1 and yes as sure from q), g as (select *, bool_or(sure) over (partition by key) as settled from s),
    r as (select *, not no and not settled and d = least and d <= 10 as near from g)
    select key, id, sure or (near and row_number() over (partition by key order by near desc, id, no, yes, d) = 1) as match from r"""
)
def suggested_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several suggested pairs is taken."""
    c = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), c.alias("id"), (c % 3 == 0).alias("no"), (c % 4 == 0).alias("yes"), (c % 101).cast("double").alias("d"))
    return K.decide(p, "key", F.col("no"), F.col("yes"), "d", 10.0).select("key", "id", "match")


# --- models and assessment -----------------------------------------------------------------------------------


@query("select case when a > b then 'improved' when a < b then 'worse' else 'same' end as outcome, count(*) as n from (select tripid, round(max(jaccard_exact), 6) as a, round(avg(jaccard_exact), 6) as b from {fx_models} group by 1) group by 1")
def improved_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.operators.calibration import improved_split

    t = fixture(spark, sf_dir, "fx_models").groupBy("tripid").agg(F.round(F.max("jaccard_exact"), 6).alias("a"), F.round(F.avg("jaccard_exact"), 6).alias("b"))
    return improved_split(t, "a", "b")


@query("select run_num, min(loss) over (order by run_num) as best from (select run_num, round(avg(jaccard_exact), 6) as loss from {fx_models} group by 1)")
def convergence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best loss after each round."""
    from pathloom.operators.calibration import convergence

    t = fixture(spark, sf_dir, "fx_models").groupBy("run_num").agg(F.round(F.avg("jaccard_exact"), 6).alias("loss"))
    return convergence(t, "run_num", "loss").select("run_num", "best")


@query("select subset, calibration_name, run_num, tripid, round(jaccard_exact, 6) as loss from {fx_models} where calibration_name <> 'R'")
def loss_by_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of each trip under each model, as a long table."""
    return fixture(spark, sf_dir, "fx_models").where("calibration_name <> 'R'").select("subset", "calibration_name", "run_num", "tripid", F.round("jaccard_exact", 6).alias("loss"))


_REDUCTION = "(select orig_taz, dest_taz, trips, cast(orig_taz * 7 + dest_taz + 10 as double) as now, cast(orig_taz * 7 + dest_taz + 10 - (orig_taz + dest_taz) % 3 as double) as later from {fx_od})"


@query(f"select round(sum((now - later) * trips) / sum(trips), 6) as weighted_mean, sum((now = later)::int) as unchanged, max(now - later) as most from {_REDUCTION}")
def weighted_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much a scenario lowers the least impedance, weighted by trips."""
    o = fixture(spark, sf_dir, "fx_od")
    now = (F.col("orig_taz") * 7 + F.col("dest_taz") + 10).cast("double")
    r = M.impedance_reduction(o.withColumn("now", now).withColumn("later", now - (F.col("orig_taz") + F.col("dest_taz")) % 3), "now", "later", "trips")
    return r.withColumn("weighted_mean", F.round("weighted_mean", 6))


@query(
    """select a.taz as taz, a.n as n_bike, b.n as n_walk, round(100.0 * (a.n - b.n) / b.n + 1e-9, 4) as percent from (select orig_taz as taz, count(*) as n from {fx_od} where trips > 1 group by 1) a
    join (select orig_taz as taz, count(*) as n from {fx_od} where dest_taz % 3 = 0 group by 1) b on a.taz = b.taz"""
)
def modes_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that two modes reach, with what each gives and the change between them."""
    o = fixture(spark, sf_dir, "fx_od").withColumnRenamed("orig_taz", "taz")
    count = lambda c: o.where(c).groupBy("taz").agg(F.count(F.lit(1)).alias("n"))
    both = Z.compared_modes({"bike": count("trips > 1"), "walk": count("dest_taz % 3 = 0")}, "taz", ["n"])
    return both.withColumn("percent", rounded(100.0 * (F.col("n_bike") - F.col("n_walk")) / F.col("n_walk"), 4))


@query("select link_type, count(*) as n, round(sum(length_ft) / 5280, 4) as miles, round(100.0 * sum(length_ft) / (select sum(length_ft) from {fx_links}), 4) as percent from {fx_links} group by 1")
def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, miles and percent of all by a user's attribute."""
    s = R.share_of_total(fixture(spark, sf_dir, "fx_links"), ["link_type"], F.col("length_ft"))
    return s.select("link_type", "n", F.round(F.col("amount") / 5280, 4).alias("miles"), F.round("percent", 4).alias("percent"))


@query(
    """select tripid, round(coalesce(sum(len) filter (linkid % 2 = 0), 0) / 5280 + 1e-9, 6) as lane_miles, round(coalesce(sum(len) filter (linkid % 5 = 0), 0) / 5280 + 1e-9, 6) as hill_miles, count(*) as links
    from {fx_routes} where kind = 'chosen' group by 1"""
)
def attribute_miles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Miles of each route by attribute, and its number of links."""
    r = fixture(spark, sf_dir, "fx_routes").where("kind = 'chosen'")
    miles = lambda c: rounded(F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0.0)) / 5280, 6)
    return r.groupBy("tripid").agg(miles(F.col("linkid") % 2 == 0).alias("lane_miles"), miles(F.col("linkid") % 5 == 0).alias("hill_miles"), F.count(F.lit(1)).alias("links"))


@query(
    """with a as (select * from {fx_attributes}), p as (select linkid, linkid + 32 as path_id from a where link_type = 'road')
    select r.linkid as road, q.linkid as path, coalesce(q.facility_fwd, r.facility_fwd) as road_facility, greatest(q.lanes_a, r.lanes_a) as path_lanes, greatest(q.speed_class, r.speed_class) as path_speed
    from p join a r on r.linkid = p.linkid join a q on q.linkid = p.path_id"""
)
def side_path_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road takes its side path's facility, the path the greater attributes of its road."""
    a = fixture(spark, sf_dir, "fx_attributes")
    pairs = a.where("link_type = 'road'").select("linkid", (F.col("linkid") + 32).alias("path_id"))
    return K.side_path_swapped(pairs, a, "facility_fwd", ["lanes_a", "speed_class"]).select(
        F.col("linkid").alias("road"), F.col("path_id").alias("path"), F.col("facility_fwd").alias("road_facility"), F.col("lanes_a").alias("path_lanes"), F.col("speed_class").alias("path_speed")
    )


@query("select orig_taz, dest_taz, trips from {fx_od} where not exists (select 1 from {nation} where n_nationkey = orig_taz and n_regionkey = dest_taz % 5) and orig_taz <> dest_taz")
def sheds_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a walk connects directly are no transit pairs."""
    near = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("orig_taz"), F.col("n_regionkey").cast("bigint").alias("_r"))
    o = fixture(spark, sf_dir, "fx_od").where("orig_taz <> dest_taz").withColumn("_r", F.col("dest_taz") % 5)
    return o.join(near, ["orig_taz", "_r"], "left_anti").select("orig_taz", "dest_taz", "trips")


@query("select tripid, sequence from {fx_trace} t where not exists (select 1 from {fx_stops} s where sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2) <= 400) and exists (select 1 from {fx_nodes} n where sqrt((t.x - n.x) ** 2 + (t.y - n.y) ** 2) <= 150)")
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that the network doesn't explain but the raw map does: where links are missing."""
    t = fixture(spark, sf_dir, "fx_trace").select("tripid", "sequence", "x", "y").withColumn("key", F.struct("tripid", "sequence"))
    return K.missing_links(t, "key", fixture(spark, sf_dir, "fx_stops").select(F.col("x").alias("qx"), F.col("y").alias("qy")), 400.0, fixture(spark, sf_dir, "fx_nodes").select(F.col("x").alias("qx"), F.col("y").alias("qy")), 150.0).select("key.tripid", "key.sequence")


@query("select userid, min(tripid) as tripid, count(distinct tripid) as trips from {trips_df} where userid is not null and tripid is not null group by 1")
def calibration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips grouped by rider for calibration, with the first of each."""
    t = table(spark, sf_dir, "trips_df").where("userid is not null and tripid is not null")
    return t.groupBy("userid").agg(F.min("tripid").alias("tripid"), F.countDistinct("tripid").alias("trips"))
