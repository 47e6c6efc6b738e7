"""Queries of the general training-data problems: p1 (stops and trips), p4 (grid), p5 (references), p6 (spikes), p7 (nearby points)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.common import table
from pathloom.operators.grid import empty_cells, regular_grid
from pathloom.operators.nearby import latest_position, points_within
from pathloom.operators.references import Parent, Reference, orphan_references, orphans_per_period
from pathloom.operators.spikes import implausible_readings, score_readings, wrong_summaries
from pathloom.operators.stays import stops_and_trips

#: The first and the last year in which a clock value of coords can be right.
YEARS = (2012, 2017)
#: Latitude and longitude (south, north, west, east) in which a stop position can be right.
BOX = (35.0, 43.0, -33.0, -23.0)
WALK_M = 100.0


def right_clock(col: str) -> Column:
    """Whether a clock value lies in the years in which it can be right."""
    t = F.col(col).cast("timestamp")
    return (t >= F.lit(f"{YEARS[0]}-01-01").cast("timestamp")) & (t < F.lit(f"{YEARS[1] + 1}-01-01").cast("timestamp"))


def p1_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = table(spark, sf_dir, "coords")
    legs = stops_and_trips(coords, "tripid", "sequence", "datetime", "x", "y", "speed_mph", "haccuracy_ft", accept=right_clock("datetime"))
    return legs.withColumn("feet", F.round(F.col("metres") / 0.3048, 1)).drop("metres")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_legs(spark, sf_dir).select("tripid", "kind", "leg_no")


def speed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coords.speed_mph per recording and half-minute."""
    coords = table(spark, sf_dir, "coords")
    return regular_grid(coords, "tripid", "datetime", "speed_mph", step_s=30, accept=(F.col("speed_mph") >= 0) & right_clock("datetime"))


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speed_grid(spark, sf_dir).select(
        "tripid", "slot_start", "n_readings", F.round("mean_value", 4).alias("mean_speed"), F.round("coverage", 4).alias("coverage"), "state"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return empty_cells(speed_grid(spark, sf_dir)).select("tripid", "slot_start")


P4_FOUND = """
with u as (
  select distinct tripid, cast(floor(epoch_us(datetime) / 30000000.0) as bigint) * 30 as s from coords
  where datetime >= timestamp '2012-01-01' and datetime < timestamp '2018-01-01' and speed_mph >= 0 and tripid is not null and not isnan(speed_mph)),
g as (select tripid, s, lead(s) over (partition by tripid order by s) as n from u)
select tripid, unnest(generate_series(s + 30, n - 30, 30)) as slot_start from g where n > s + 30
"""

P4_GRID = """
with u as (
  select tripid, epoch_us(datetime) as t, avg(speed_mph) as v from coords
  where datetime >= timestamp '2012-01-01' and datetime < timestamp '2018-01-01' and speed_mph >= 0 and tripid is not null and not isnan(speed_mph)
  group by all),
i as (select *, lead(t) over (partition by tripid order by t) as n from u),
j as (select *, t // 30000000 as c0, case when n is null then t // 30000000 else greatest(t // 30000000, (n - 1) // 30000000) end as c1,
  least(t + 60000000, coalesce(n, t + 60000000)) as e from i),
k as (select *, unnest(generate_series(c0, c1)) as c from j),
o as (select *, greatest(0, least(e, (c + 1) * 30000000) - greatest(t, c * 30000000)) as d from k),
a as (select tripid, c, sum(d) as d, sum(d * v) as a, sum(case when c = c0 then 1 else 0 end) as n from o group by all)
select tripid, cast(c * 30 as bigint) as slot_start, cast(n as bigint) as n_readings, round(case when d > 0 then a / d end, 4) as mean_speed,
  round(d / 30000000.0, 4) as coverage, case when n > 0 then 'observed' when d > 0 then 'filled' else 'missing' end as state
from a
"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, od = table(spark, sf_dir, "turns_df"), table(spark, sf_dir, "od_matrix")
    return orphan_references(
        [
            Reference(turns, "turns_df", "source_linkid", "turn_id", "built_at", "links"),
            Reference(turns, "turns_df", "target_linkid", "turn_id", "built_at", "links"),
            Reference(od, "od_matrix", "orig_N", "od_id", "built_at", "nodes"),
            Reference(od, "od_matrix", "dest_N", "od_id", "built_at", "nodes"),
        ],
        {
            "links": Parent(table(spark, sf_dir, "links"), "linkid", "added_at", "removed_at"),
            "nodes": Parent(table(spark, sf_dir, "nodes"), "N", "added_at", "removed_at"),
        },
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("tab", "field", "row_id", "period")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_per_period(orphans(spark, sf_dir))


_P5 = """
with refs as (
  select distinct 'turns_df' as tab, 'source_linkid' as field, turn_id as row_id, source_linkid as key, built_at, 'links' as parent from turns_df
  union all select distinct 'turns_df', 'target_linkid', turn_id, target_linkid, built_at, 'links' from turns_df
  union all select distinct 'od_matrix', 'orig_N', od_id, orig_N, built_at, 'nodes' from od_matrix
  union all select distinct 'od_matrix', 'dest_N', od_id, dest_N, built_at, 'nodes' from od_matrix),
held as (
  select distinct 'links' as parent, linkid as key, added_at as a, removed_at as b from links
  union all select distinct 'nodes', N, added_at, removed_at from nodes),
o as (
  select * from refs r where key is not null and built_at is not null and not exists (
    select 1 from held h where h.parent = r.parent and h.key = r.key and h.a <= r.built_at and (h.b is null or h.b > r.built_at))),
f as (select parent, key, min(a) as a from held where b is null or b > a group by all)
"""
P5_FOUND = _P5 + "select tab, field, row_id, strftime(built_at, '%Y-%m') as period from o"
P5_REPORT = (
    _P5
    + """select tab, field, strftime(built_at, '%Y-%m') as period,
  case when f.key is null then 'missing' when f.a <= o.built_at then 'deleted' else 'late' end as reason, count(*) as n
from o left join f using (parent, key) group by all"""
)


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_readings(table(spark, sf_dir, "coords"), "tripid", "sequence", "datetime", "speed_mph")
    return scored.withColumn("score", F.round("score", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = implausible_readings(table(spark, sf_dir, "coords"), "tripid", "sequence", "datetime", "speed_mph")
    sums = wrong_summaries(found, table(spark, sf_dir, "trips_df"), "tripid", "avg_speed_mph_gps", "max_speed_mph_gps", "speed_mph")
    pings = found.where("rule <> 'source'").select("tripid", F.col("sequence").cast("int").alias("sequence"))
    return pings.unionByName(sums.select("tripid", F.lit(-1).alias("sequence")))


P6_FOUND = """
with p as (select distinct tripid, sequence as s, case when speed_mph = -1 or isnan(speed_mph) then null else speed_mph end as v from coords),
q as (select *, case when v > 0 and v = lag(v) over w then 0 else 1 end as fresh from p window w as (partition by tripid order by s)),
r as (select *, sum(fresh) over (partition by tripid order by s rows unbounded preceding) as run from q),
t as (select *, v is not null and (v < 0 or v > 70) as a, v > 0 and count(*) over (partition by tripid, run) >= 12 as b from r),
u as (select *, case when v is not null and not a and not b then v end as n from t),
w as (select *, least(n, lead(n, 1) over x, lead(n, 2) over x, lead(n, 3) over x) as l,
  n is not null and lead(n, 1) over x is not null and lead(n, 2) over x is not null and lead(n, 3) over x is not null as full4
  from u window x as (partition by tripid order by s)),
h as (select tripid, max(case when full4 then l end) as held from w group by tripid),
l as (select distinct tripid, n from u where n is not null),
g as (select *, lag(n) over (partition by tripid order by n) as under from l),
bar as (select tripid, min(n) as bar from g join h using (tripid) where n > coalesce(held, -1) and n > 4 * under / 3 and n > under + 7 group by tripid),
m as (select tripid, avg(v) as mean, max(v) as most from p where v is not null group by tripid)
select tripid, s as sequence from u where a or b
union all select tripid, s from u join bar using (tripid) where n >= bar
union all select distinct t.tripid, -1 from trips_df t left join m on m.tripid = t.tripid
where t.avg_speed_mph_gps not between mean / 2 and mean * 2 or t.max_speed_mph_gps not between most / 2 and most * 2 or t.avg_speed_mph_gps > t.max_speed_mph_gps
"""


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = latest_position(table(spark, sf_dir, "stops"), "stop_id", "stop_lat", "stop_lon", "feed_date", BOX)
    return points_within(stops, "stop_id", "lat", "lon", WALK_M)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pairs(spark, sf_dir).select(F.col("id_a").alias("stop_id_a"), F.col("id_b").alias("stop_id_b"))


P7_FOUND = """
with l as (select stop_id, stop_lat as lat, stop_lon as lon, row_number() over (
    partition by stop_id order by feed_date desc nulls last, stop_lat desc nulls last, stop_lon desc nulls last) as r from stops),
p as (select stop_id, lat, lon from l where r = 1 and stop_id is not null and lat between 35 and 43 and lon between -33 and -23)
select a.stop_id as stop_id_a, b.stop_id as stop_id_b from p a join p b
  on a.stop_id < b.stop_id and abs(a.lat - b.lat) < 0.001
where 2 * 6371008.8 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2
  + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) <= 100
"""

QUERIES = {"p1_found": p1_found, "p1_legs": p1_legs, "p4_found": p4_found, "p4_grid": p4_grid, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_scores": p6_scores, "p7_found": p7_found}
SQL = {"p4_found": P4_FOUND, "p4_grid": P4_GRID, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p6_found": P6_FOUND, "p7_found": P7_FOUND}
