"""Queries of the ordered-row operators: traces and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.common import micros
from pathloom.operators import traces as T
from pathloom.plans.fixtures import fixture
from pathloom.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(
    """with p as (select linkid, dist, elev - lag(elev) over (partition by linkid order by dist) as d, dist - lag(dist) over (partition by linkid order by dist) as r from {fx_profile}),
    a as (select linkid, coalesce(sum(case when d > 0 then d end), 0) as ascent, coalesce(sum(case when d < 0 then d end), 0) as descent, max(dist) - min(dist) as length,
      cast(sum(case when abs(d / r * 100) > 100 then 1 else 0 end) as bigint) as steep from p group by 1)
    select linkid, ascent, descent, length, steep, round(ascent / nullif(length, 0) * 100, 2) as ascent_grade, round(descent / nullif(length, 0) * 100, 2) as descent_grade from a"""
)
def profile_ascent_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ascents(fixture(spark, sf_dir, "fx_profile"), "linkid", "dist", "elev", 100.0)


@query("select linkid, dist, round((elev - lag(elev) over w) / 10 * 100, 6) as grade from {fx_profile} window w as (partition by linkid order by dist)")
def profile_lag_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lag_grades(fixture(spark, sf_dir, "fx_profile"), "linkid", "dist", "elev").select("linkid", "dist", F.round("grade", 6).alias("grade"))


@query()
def profile_knockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.knocked_out(fixture(spark, sf_dir, "fx_profile"), "linkid", "dist", "elev", 120.0)


@query(
    """with s as (select linkid, dist as d0, elev as e0, lead(dist) over w as d1, lead(elev) over w as e1, max(dist) over (partition by linkid) as b from {fx_profile} window w as (partition by linkid order by dist)),
    g as (select linkid, b, unnest(generate_series(0, cast(floor(b / 7) as bigint))) * 7.0 as at from (select distinct linkid, b from s where b > 0))
    select g.linkid, cast(g.at as double) as at, round(e0 + (e1 - e0) * (g.at - d0) / (d1 - d0), 6) as elev from g join s on g.linkid = s.linkid and s.d1 is not null and g.at >= d0 and (g.at < d1 or (g.at = d1 and d1 = s.b))"""
)
def profile_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resampled(fixture(spark, sf_dir, "fx_profile"), "linkid", "dist", "elev", 7.0).withColumn("elev", F.round("elev", 6))


@query("select linkid, max(abs(g)) > 150 as exceeds from (select linkid, (elev - lag(elev) over (partition by linkid order by dist)) / 10 * 100 as g from {fx_profile}) where g is not null group by 1")
def threshold_violators(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.lag_grades(fixture(spark, sf_dir, "fx_profile"), "linkid", "dist", "elev").where("grade is not null")
    return g.groupBy("linkid").agg(F.bool_or(F.abs("grade") > 150).alias("exceeds"))


@query("select tripid, sequence, event_type from (select *, lead(event_type) over (partition by tripid order by sequence) as n from {fx_trace}) where n is null or n <> event_type")
def run_length_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last_of_runs(fixture(spark, sf_dir, "fx_trace").select("tripid", "sequence", "event_type"), ["tripid"], ["sequence"], "event_type")


@query("select * from (select tripid, sequence, event_type, lead(event_type) over (partition by tripid order by sequence) as next_event_type from {fx_trace}) where next_event_type <> event_type")
def consecutive_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.consecutive_pairs(fixture(spark, sf_dir, "fx_trace"), ["tripid"], ["sequence"], "event_type", drop_same=True)


@query("select tripid, arg_min(x, sequence) as first_x, arg_max(y, sequence) as last_y from {fx_trace} group by 1")
def first_last_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ends_of(fixture(spark, sf_dir, "fx_trace"), ["tripid"], "sequence", "x", "y")


@query(
    """with d as (select user_id, cast(epoch_us(ts) // 86400000000 as bigint) as step, count(*) as n from {events} group by 1, 2), s as (select user_id, unnest(generate_series(min(step), max(step))) as step from d group by user_id)
    select s.user_id, s.step, coalesce(n, 0) as n from s left join d on s.user_id = d.user_id and s.step = d.step"""
)
def gap_fill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and day, days without any included."""
    days = fixture(spark, sf_dir, "events").groupBy("user_id", F.floor(micros("ts") / 86_400_000_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return T.filled_steps(days, ["user_id"], F.col("day"), ["n"]).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


@query(
    """with e as (select *, first_value(x) over w as sx, first_value(y) over w as sy, last_value(x) over w as ex, last_value(y) over w as ey from {fx_trace}
      window w as (partition by tripid order by sequence rows between unbounded preceding and unbounded following)),
    d as (select *, sqrt((x - sx) ** 2 + (y - sy) ** 2) as ds, sqrt((x - ex) ** 2 + (y - ey) ** 2) as de from e),
    b as (select tripid, max(ds) as reach, min(case when ds > 3000 then sequence end) as a, max(case when de > 3000 then sequence end) as b from d group by 1)
    select d.tripid, sequence, x, y from d join b on d.tripid = b.tripid where reach > 6000 and sequence between a and b"""
)
def privacy_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.privacy_trim(fixture(spark, sf_dir, "fx_trace").select("tripid", "sequence", "x", "y"), "tripid", "sequence", "x", "y", 3000.0)


@query(
    """with y as (select distinct cast(year(o_orderdate) as int) as year from {orders} where o_orderpriority = '1-URGENT')
    select e.event_id, (select max(year) from y where year <= year(e.ts) - e.event_id % 9) as found from {events} e"""
)
def asof_network_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest network year not after a trip's year."""
    years = fixture(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.year("o_orderdate").alias("year"))
    e = fixture(spark, sf_dir, "events").select("event_id", "ts")
    return T.as_of_small(e, F.year("ts") - F.col("event_id") % 9, years, "year").select("event_id", F.col("found").cast("int").alias("found"))


@query(
    """select a.event_id, b.value as last_purchase from (select * from {events} where event_type = 'click') a asof left join
    (select user_id, ts, max(value) as value from {events} where event_type = 'purchase' group by 1, 2) b on a.user_id = b.user_id and a.ts >= b.ts"""
)
def asof_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click, the user's latest purchase before or at it."""
    e = fixture(spark, sf_dir, "events").withColumn("us", micros("ts"))
    known = e.where("event_type = 'purchase'").groupBy("user_id", "us").agg(F.max("value").alias("last_purchase"))
    return T.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "us"), F.col("us"), known, "us", "last_purchase", ["user_id"]).select("event_id", "last_purchase")


@query(
    """select a.event_id as slot, b.event_id as departure from {events} a join {events} b on a.user_id = b.user_id and epoch_us(b.ts) // 1000000 between epoch_us(a.ts) // 1000000 and epoch_us(a.ts) // 1000000 + 7200
    where a.event_type = 'signup' and b.event_type = 'view'"""
)
def interval_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a start slot and a departure at most two hours after it."""
    e = fixture(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(micros("ts") / 1_000_000).alias("s"))
    slots = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("slot"), F.col("s").alias("start"))
    deps = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("departure"), "s")
    return T.within_interval(deps, "s", slots, "start", 7200, ["user_id"]).select("slot", "departure")


@query("select cast(o_custkey as bigint) as tripid, count(*) as n, count(distinct l_suppkey) as different from {lineitem} join {orders} on l_orderkey = o_orderkey group by 1 having count(*) > count(distinct l_suppkey)")
def backtracking_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = fixture(spark, sf_dir, "lineitem"), fixture(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").cast("bigint").alias("tripid"), "l_suppkey")
    return T.repeating(rows, "tripid", "l_suppkey")


@query(
    """with p as (select *, epoch_us(ts) / 1e6 as t from {fx_trace}), a as (select *, (speed_mph - lag(speed_mph) over w) / nullif(t - lag(t) over w, 0) as accel from p window w as (partition by tripid order by sequence))
    select tripid, round(min(speed_mph), 6) as min_speed, round(avg(speed_mph), 6) as mean_speed, round(max(speed_mph), 6) as max_speed, round(max(accel) * 1000, 4) as max_accel from a group by 1"""
)
def trip_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = T.kinematics(fixture(spark, sf_dir, "fx_trace"), "tripid", "sequence", "speed_mph", micros("ts") / 1e6)
    return k.select("tripid", *[F.round(f"{a}_speed_mph", 6).alias(f"{a}_speed") for a in ("min", "mean", "max")], F.round(F.col("max_accel") * 1000, 4).alias("max_accel"))
