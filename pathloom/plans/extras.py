"""Queries of sinks, sources and the streaming extension on derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.common import table
from pathloom.functions import scalars as S
from pathloom.functions import tags as G
from pathloom.operators import conflation as K
from pathloom.operators import relational as R
from pathloom.operators import traces as T
from pathloom.plans.fixtures import fixture
from pathloom.plans.registry import Registry
from pathloom.sources import readers, writers
from pathloom.streaming.traces import sessions, windowed_speeds

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("select user_id, time_bucket(interval '1 day', ts) as start, count(*) as n, round(avg(value), 6) as mean_speed, max(value) as max_speed from {events} group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_speeds(e, "user_id", "ts", "value", "1 day").withColumn("mean_speed", F.round("mean_speed", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval '6 hours' or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as f from {events}),
    s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "user_id", "ts", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select link_type as layer, count(*) as links, round(sum(length_ft) / 5280, 4) as miles, round(avg(length_ft), 4) as mean_ft from {fx_links} where link_type in ('road', 'bike') group by 1")
def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, nodes = fixture(spark, sf_dir, "fx_links"), fixture(spark, sf_dir, "fx_nodes")
    out = writers.summary({k: (links.where(F.col("link_type") == k), nodes) for k in ("road", "bike")})
    return out.select("layer", "links", F.round("miles", 4).alias("miles"), F.round("mean_ft", 4).alias("mean_ft"))


@query(
    """select linkid, least(ax, l.bx) as minx, greatest(l.ay, l.by) as maxy from {fx_links} l where least(l.ax, l.bx) <= 5000 and greatest(l.ax, l.bx) >= 2000 and least(l.ay, l.by) <= 5000 and greatest(l.ay, l.by) >= 2000"""
)
def study_area_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose bounds touch a box."""
    links = fixture(spark, sf_dir, "fx_links")
    pts = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    b = readers.with_bounds(links.withColumn("geometry", pts), "geometry")
    return b.where("minx <= 5000 and maxx >= 2000 and miny <= 5000 and maxy >= 2000").select("linkid", "minx", "maxy")


@query("select linkid, reverse_link, case when reverse_link then l.bx else l.ax end as ascent, case when reverse_link then l.ax else l.bx end as descent from {fx_links} l, (select unnest([false, true]) as reverse_link)")
def sided_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that change sides on reverse links."""
    links = fixture(spark, sf_dir, "fx_links").select("linkid", F.explode(F.array(F.lit(False), F.lit(True))).alias("reverse_link"), F.col("ax").alias("ascent"), F.col("bx").alias("descent"))
    return writers.sided(links, [("ascent", "descent")])


@query("select o_orderkey, case when o_orderpriority = '1-URGENT' then 'new' else 'old' end as rating from {orders} where o_orderpriority = '1-URGENT' or o_orderstatus = 'O'")
def rating_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixture(spark, sf_dir, "orders")
    of = lambda condition, rating: o.where(condition).select("o_orderkey", F.lit(rating).alias("rating"))
    return R.upsert(of("o_orderstatus = 'O'", "old"), of("o_orderpriority = '1-URGENT'", "new"), ["o_orderkey"])


@query("select distinct o_custkey from {orders} where o_orderstatus = 'O' and o_custkey not in (select o_custkey from {orders} where o_orderstatus = 'P')")
def unfinished_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixture(spark, sf_dir, "orders")
    return writers.unfinished(o.where("o_orderstatus = 'O'").select("o_custkey").distinct(), o.where("o_orderstatus = 'P'"), ["o_custkey"])


@query(
    """select event_id, cast(epoch_us(ts) // 1000000 // 86400 as bigint) || 'd ' || cast(epoch_us(ts) // 1000000 % 86400 // 3600 as bigint) || 'h ' || cast(epoch_us(ts) // 1000000 % 3600 // 60 as bigint) || 'm' as elapsed from {events}"""
)
def elapsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture(spark, sf_dir, "events")
    return e.select("event_id", S.elapsed_text(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("elapsed"))


@query("select stop_id, route_id, unnest(generate_series(600 * route_id, 600 * route_id + 3600 - 900, 900)) as departure from {fx_stops}")
def departure_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "fx_stops")
    start = (F.col("route_id") * 600).cast("bigint")
    return s.select("stop_id", "route_id", F.explode(S.departures(start, start + 3600, 900)).alias("departure"))


@query(
    """with e as (select tripid, sequence, x from (select *, count(*) over (partition by tripid, cast(x as bigint) % 50) as n from {fx_trace}) where n = 1) select tripid, count(*) as n from e group by 1"""
)
def repeats_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of links that occur once in their trip, counted."""
    t = fixture(spark, sf_dir, "fx_trace").withColumn("linkid", F.col("x").cast("bigint") % 50)
    return T.without_repeats(t, "tripid", "linkid").groupBy("tripid").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with l as (select distinct linkid, reverse_link, added_at, A, B, link_type, length_ft from {links}), r as (select A as N from l where link_type = 'road' union select B from l where link_type = 'road'),
    b as (select A as N from l where link_type = 'bike' union select B from l where link_type = 'bike')
    select linkid, reverse_link, added_at, case when link_type = 'sidewalk' and length_ft < 100 and ((A in (select N from r) and B in (select N from b)) or (A in (select N from b) and B in (select N from r))) then 'pedestrian' else link_type end as link_type from l"""
)
def sidewalk_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sidewalks between a road and a bike link."""
    links = table(spark, sf_dir, "links").select("linkid", "reverse_link", "added_at", "A", "B", "link_type", "length_ft").distinct()
    return K.sidewalk_connectors(links).select("linkid", "reverse_link", "added_at", "link_type")


@query(
    """select linkid, osmid, case when highway in ('path', 'track', 'pedestrian', 'steps', 'corridor', 'footway') then 'pedestrian' when highway = 'cycleway' then 'bike' when highway = 'service' and name is null then 'service'
    when highway in ('primary', 'primary_link', 'residential', 'secondary', 'secondary_link', 'tertiary', 'tertiary_link', 'trunk', 'trunk_link', 'unclassified', 'living_street') or highway = 'service' then 'road'
    when highway in ('motorway', 'motorway_link') then 'restricted_access_road' end as kind from (select distinct linkid, reverse_link, added_at, osmid, highway, name from {links})"""
)
def tag_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link types by the tags the links table has."""
    links = table(spark, sf_dir, "links").select("linkid", "reverse_link", "added_at", "osmid", "highway", "name").distinct()
    tags = F.map_filter(F.create_map(F.lit("highway"), F.col("highway"), F.lit("name"), F.col("name")), lambda _, v: v.isNotNull())
    return links.select("linkid", "osmid", G.link_type(tags).alias("kind"))


@query()
def one_to_one_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops and trace points paired one to one within a distance."""
    stops = fixture(spark, sf_dir, "fx_stops").select(F.col("stop_id").alias("id"), "x", "y")
    other = fixture(spark, sf_dir, "fx_nodes").join(stops.select(F.col("id").alias("N")), "N", "left_anti")
    nodes = other.select(F.col("N").alias("jid"), F.col("x").alias("jx"), F.col("y").alias("jy"))
    return K.one_to_one(stops, nodes, 400.0).withColumn("distance", F.round("distance", 6))


@query("select tripid from (select tripid, x as ax, y as ay, coalesce(lead(x) over w, x) as bx, coalesce(lead(y) over w, y) as bz from {fx_trace} window w as (partition by tripid order by sequence)) t where "
       "(case when (bx - ax) ** 2 + (bz - ay) ** 2 = 0 then (ax - 5000) ** 2 + (ay - 5000) ** 2 else (ax + greatest(0, least(1, ((5000 - ax) * (bx - ax) + (5000 - ay) * (bz - ay)) / ((bx - ax) ** 2 + (bz - ay) ** 2))) * (bx - ax) - 5000) ** 2 "
       "+ (ay + greatest(0, least(1, ((5000 - ax) * (bx - ax) + (5000 - ay) * (bz - ay)) / ((bx - ax) ** 2 + (bz - ay) ** 2))) * (bz - ay) - 5000) ** 2 end) <= 10000 group by 1")
def trips_near_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips whose line touches a disc."""
    return K.touching(fixture(spark, sf_dir, "fx_trace"), "tripid", "sequence", 5000.0, 5000.0, 100.0)


@query()
def link_ends_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose nearest nodes aren't the ones they name, counted (several nodes share a place)."""
    links = fixture(spark, sf_dir, "fx_links").select("linkid", F.col("A").alias("oa"), "ax", "ay", "bx", "by")
    out = K.end_nodes(links, fixture(spark, sf_dir, "fx_nodes"))
    return out.agg(F.count(F.lit(1)).alias("links"), F.sum((F.col("A") == F.col("oa")).cast("bigint")).alias("same"), F.max("a_off").alias("farthest"))


@query()
def detour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of trips by detour rate and length, sizes of the clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    m = fixture(spark, sf_dir, "fx_models").groupBy("tripid").agg(F.avg("jaccard_exact").alias("rate"), (F.sum("union_len") / 100).alias("length"))
    rows = VectorAssembler(inputCols=["rate", "length"], outputCol="features").transform(m)
    model = KMeans(k=3, seed=1, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 4).alias("mean_length"))


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from {lineitem}")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares in one pass."""
    f = lambda n, d: F.round(F.expr(f"regr_{n}(l_extendedprice, l_quantity)"), d)
    return fixture(spark, sf_dir, "lineitem").agg(f("slope", 4).alias("slope"), f("intercept", 2).alias("intercept"), f("r2", 6).alias("r2"))
