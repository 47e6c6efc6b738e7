"""Queries of the relational and scalar operators on derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import scalars as S
from pathloom.operators import relational as R
from pathloom.plans.fixtures import fixture
from pathloom.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("select orig_taz, dest_taz, trips from {fx_od}")
def od_trip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips per pair of zones."""
    li, o, c, s = (fixture(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    trips = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return trips.groupBy(F.col("c_nationkey").cast("bigint").alias("orig_taz"), F.col("s_nationkey").cast("bigint").alias("dest_taz")).agg(F.count(F.lit(1)).alias("trips"))


@query(
    """with r as (select l_orderkey, l_quantity, l_discount, l_returnflag, o_orderstatus, o_custkey from {lineitem} join {orders} on l_orderkey = o_orderkey)
    select 1 as stage_no, 'all' as stage, count(*) as n, count(distinct o_custkey) as riders from r
    union all select 2, 'open', count(*), count(distinct o_custkey) from r where o_orderstatus = 'O'
    union all select 3, 'short', count(*), count(distinct o_custkey) from r where o_orderstatus = 'O' and l_quantity < 25
    union all select 4, 'kept', count(*), count(distinct o_custkey) from r where o_orderstatus = 'O' and l_quantity < 25 and l_returnflag <> 'R'"""
)
def od_filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and riders left after each filter."""
    li, o = fixture(spark, sf_dir, "lineitem"), fixture(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    stages: list[tuple[str, Column]] = [("all", F.lit(True)), ("open", F.col("o_orderstatus") == "O"), ("short", F.col("l_quantity") < 25), ("kept", F.col("l_returnflag") != "R")]
    return R.funnel(rows, stages, {"n": F.count(F.lit(1)), "riders": F.countDistinct("o_custkey")})


@query("select orig_taz, round(sum(trips * (dest_taz + 0.5)) / sum(trips), 6) as mean_zone, cast(sum(trips) as bigint) as trips from {fx_od} group by 1")
def weighted_mean_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = fixture(spark, sf_dir, "fx_od")
    return od.groupBy("orig_taz").agg(F.round(R.weighted_mean(F.col("dest_taz") + 0.5, F.col("trips")), 6).alias("mean_zone"), F.sum("trips").alias("trips"))


@query(
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as r from {orders}) where r = 1"""
)
def argmin_best_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest order of each customer, ties by key."""
    return R.best_row(fixture(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.col("o_totalprice"), ["o_orderkey"])


@query(
    """with m as (select A, linkid, round(length_ft - 5000, 4) as multiplier from {fx_links})
    select A, linkid, multiplier from (select *, row_number() over (partition by A order by abs(multiplier) desc, linkid) as r from m) where r = 1"""
)
def abs_argmax_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "fx_links").select("A", "linkid", F.round(F.col("length_ft") - 5000, 4).alias("multiplier"))
    return R.best_row(m, ["A"], F.abs("multiplier"), ["linkid"], largest=True)


@query(
    """with c as (select user_id, event_type, count(*) as n from {events} group by 1, 2), m as (select user_id, max(n) as n from c group by 1)
    select c.user_id, case when count(*) > 1 then 'Mixed' else min(event_type) end as event_type, max(c.n) as n from c join m on c.user_id = m.user_id and c.n = m.n group by 1"""
)
def mode_with_tie_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_or_mixed(fixture(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("select p_partkey, p_brand, round(p_retailprice / p_size, 6) as per_mile from {part} order by p_retailprice / p_size, p_partkey limit 10")
def top_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of the smallest signed contribution per mile."""
    per = F.col("p_retailprice") / F.col("p_size")
    return fixture(spark, sf_dir, "part").orderBy(per, "p_partkey").limit(10).select("p_partkey", "p_brand", F.round(per, 6).alias("per_mile"))


@query("select linkid, A, B from (select *, row_number() over (partition by least(A, B), greatest(A, B) order by linkid) as r from {fx_links}) where r = 1")
def undirected_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.undirected(fixture(spark, sf_dir, "fx_links").select("linkid", "A", "B"))


@query(
    """select coalesce(a.calibration_name, b.calibration_name) as calibration_name, coalesce(a.run_num, b.run_num) as run_num, coalesce(a.loss, 0) as loss_F, coalesce(b.loss, 0) as loss_O
    from (select calibration_name, run_num, round(-avg(jaccard_exact), 6) as loss from {fx_models} where subset = 'F' and run_num < 5 group by 1, 2) a
    full join (select calibration_name, run_num, round(-avg(jaccard_exact), 6) as loss from {fx_models} where subset = 'O' and run_num > 2 group by 1, 2) b
    on a.calibration_name = b.calibration_name and a.run_num = b.run_num"""
)
def scenario_align_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "fx_models")
    loss = lambda d: d.groupBy("calibration_name", "run_num").agg(F.round(-F.avg("jaccard_exact"), 6).alias("loss"))
    return R.align({"F": loss(m.where("subset = 'F' and run_num < 5")), "O": loss(m.where("subset = 'O' and run_num > 2"))}, ["calibration_name", "run_num"], ["loss"], 0.0)


@query(
    """with y as (select o_orderkey, year(o_orderdate) as coa_year, case when o_orderkey % 5 = 0 then null else year(min(l_shipdate)) end as arc_year, o_orderpriority < '3' as coa_type_fits,
      max(l_quantity) > 45 as arc_type_fits from {orders} join {lineitem} on l_orderkey = o_orderkey group by o_orderkey, o_orderdate, o_orderpriority)
    select o_orderkey, cast(case when coa_year = arc_year then coa_year when coa_type_fits and coa_year is not null then coa_year when arc_type_fits and arc_year is not null then arc_year
      else coalesce(coa_year, arc_year) end as int) as year from y"""
)
def year_conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreeing years, else the source whose type fits, else either."""
    o, li = fixture(spark, sf_dir, "orders"), fixture(spark, sf_dir, "lineitem")
    y = o.join(li, li.l_orderkey == o.o_orderkey).groupBy("o_orderkey", "o_orderdate", "o_orderpriority").agg(F.year(F.min("l_shipdate")).alias("ship"), F.max("l_quantity").alias("q"))
    coa, arc = F.year("o_orderdate"), F.when(F.col("o_orderkey") % 5 != 0, F.col("ship"))
    year = F.when(coa == arc, coa).when((F.col("o_orderpriority") < "3") & coa.isNotNull(), coa).when((F.col("q") > 45) & arc.isNotNull(), arc).otherwise(F.coalesce(coa, arc))
    return y.select("o_orderkey", year.alias("year"))


@query("select linkid, coalesce(least(lanes_a, lanes_b), 1) as lanes from {fx_attributes}")
def lane_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_attributes").select("linkid", S.lanes_reconciled(F.col("lanes_a"), F.col("lanes_b")).alias("lanes"))


@query(
    """select linkid, case when oneway then case when lanes_a >= 3 then 3 when lanes_a = 2 then 2 when lanes_a = 1 then 1 end
    else case when lanes_a > 5 then 3 when lanes_a in (3, 4) then 2 when lanes_a <= 2 then 1 end end as lanes_per_direction from {fx_attributes}"""
)
def lanes_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_attributes").select("linkid", S.lanes_per_direction(F.col("lanes_a"), F.col("oneway")).alias("lanes_per_direction"))


@query("select linkid, coalesce(aadt_class, case when link_type = 'road' then 1 else 0 end) as aadt_class, coalesce(speed_class, case when link_type = 'road' then 1 else 0 end) as speed_class from {fx_attributes}")
def aadt_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixture(spark, sf_dir, "fx_attributes")
    return a.select("linkid", *[S.impute_class(F.col(c), F.col("link_type"), ["road"]).alias(c) for c in ("aadt_class", "speed_class")])


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then 'restricted_access_road' else case when o_orderpriority = '5-LOW' and o_totalprice < 50000 then 'sidewalk'
    when o_orderpriority = '5-LOW' then 'pedestrian' when o_orderpriority = '1-URGENT' then 'bike' when o_totalprice > 200000 then 'service' else 'road' end end as link_type from {orders}"""
)
def link_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule wins, then overrides."""
    p, low = F.col("o_totalprice"), F.col("o_orderpriority") == "5-LOW"
    rules = [(low & (p < 50000), "sidewalk"), (low, "pedestrian"), (F.col("o_orderpriority") == "1-URGENT", "bike"), (p > 200000, "service")]
    kind = S.first_rule(rules, "road", [(F.col("o_orderstatus") == "P", "restricted_access_road")])
    return fixture(spark, sf_dir, "orders").select("o_orderkey", kind.alias("link_type"))


ORDER = ["sharrow", "bike lane", "buffered bike lane", "cycletrack", "multi use path"]


@query(
    """with r as (select linkid, list_position(['sharrow', 'bike lane', 'buffered bike lane', 'cycletrack', 'multi use path'], facility_fwd) as f,
      list_position(['sharrow', 'bike lane', 'buffered bike lane', 'cycletrack', 'multi use path'], facility_rev) as g from {fx_attributes})
    select linkid, (['sharrow', 'bike lane', 'buffered bike lane', 'cycletrack', 'multi use path'])[greatest(f, g)] as facility from r"""
)
def facility_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_attributes").select("linkid", S.best_of(ORDER, F.col("facility_fwd"), F.col("facility_rev")).alias("facility"))


@query(
    """select linkid, case when grade < 0 then null when grade <= 4 then '[0,4)' when grade <= 6 then '[4,6)' when grade <= 100 then '[6,inf)' end as grade_bin,
    case when grade < 0 then null when grade < 5 then '[0,5)' when grade < 9 then '[5,9)' end as wait_bin from {fx_attributes}"""
)
def grade_bins_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("grade")
    return fixture(spark, sf_dir, "fx_attributes").select(
        "linkid", S.right_closed_bin(g, [0, 4, 6, 100], ["[0,4)", "[4,6)", "[6,inf)"]).alias("grade_bin"), S.left_closed_bin(g, [0, 5, 9], ["[0,5)", "[5,9)"]).alias("wait_bin")
    )


@query(
    """select *, cast(lpd1 + speed40 + aadt4 + grade4 + lane = 0 as boolean) as base from (select linkid, cast(coalesce(lanes_a = 1, false) as int) as lpd1, cast(coalesce(speed_class = 2, false) as int) as speed40,
    cast(coalesce(aadt_class = 1, false) as int) as aadt4, cast(coalesce(grade > 4 and grade <= 6, false) as int) as grade4,
    cast(coalesce(facility_fwd = 'bike lane', false) as int) as lane from {fx_attributes})"""
)
def dummy_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators and whether all are zero. As in the reference's table, 'bike lane' doesn't count buffered lanes."""
    c = F.col
    d = {"lpd1": c("lanes_a") == 1, "speed40": c("speed_class") == 2, "aadt4": c("aadt_class") == 1, "grade4": (c("grade") > 4) & (c("grade") <= 6), "lane": c("facility_fwd") == "bike lane"}
    return fixture(spark, sf_dir, "fx_attributes").select("linkid", *S.flags(d)).withColumn("base", S.base_case(list(d)))


@query(
    """select attribute, round(share, 6) as share from (select sum(case when lanes_a is not null then length_ft else 0 end) / sum(length_ft) as lanes_a,
      sum(case when aadt_class is not null then length_ft else 0 end) / sum(length_ft) as aadt_class, sum(case when facility_fwd is not null then length_ft else 0 end) / sum(length_ft) as facility_fwd
      from {fx_attributes}) unpivot (share for attribute in (lanes_a, aadt_class, facility_fwd))"""
)
def attribute_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.completeness(fixture(spark, sf_dir, "fx_attributes"), ["lanes_a", "aadt_class", "facility_fwd"], F.col("length_ft"))
    return out.withColumn("share", F.round("share", 6))


@query(
    """select subset, calibration_name, round(avg(jaccard_exact), 6) as mean, round(stddev_samp(jaccard_exact), 6) as sd, round(quantile_cont(jaccard_exact, 0.5), 6) as median,
    round(quantile_cont(jaccard_exact, 0.025), 6) as low, round(quantile_cont(jaccard_exact, 0.975), 6) as high from {fx_models} group by 1, 2"""
)
def percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.interval_of(fixture(spark, sf_dir, "fx_models"), ["subset", "calibration_name"], "jaccard_exact")
    return out.select("subset", "calibration_name", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "low", "high")])


_CORR = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 2) as r from {{lineitem}}" for a in _CORR for b in _CORR))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.correlations(fixture(spark, sf_dir, "lineitem"), _CORR)


@query("select cast(floor(dest_taz / 5.0) as bigint) as bin, cast(sum(trips) as bigint) as weight from {fx_od} group by 1")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(fixture(spark, sf_dir, "fx_od"), F.col("dest_taz"), 5.0, F.col("trips"))


@query("select link_type, count(*) as n, round(sum(length_ft) / 5280, 4) as miles, round(sum(length_ft) / (select sum(length_ft) from {fx_links}) * 100, 4) as percent from {fx_links} group by 1")
def link_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.share_of_total(fixture(spark, sf_dir, "fx_links"), ["link_type"], F.col("length_ft") / 5280)
    return out.select("link_type", "n", F.round("amount", 4).alias("miles"), F.round("percent", 4).alias("percent"))


@query("select linkid, round((length_ft - lo) / (hi - lo), 6) as length_ft_scaled from {fx_links}, (select min(length_ft) as lo, max(length_ft) as hi from {fx_links})")
def min_max_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scaled(fixture(spark, sf_dir, "fx_links"), "length_ft").select("linkid", F.round("length_ft_scaled", 6).alias("length_ft_scaled"))


@query(
    """with k as (select distinct c_custkey, (cast(c_custkey as bigint) * 7919) % 1000003 as o from {customer}), p as (select *, o % 64 as p from k),
    n as (select p, count(*) as n from p group by 1), b as (select p, coalesce(sum(n) over (order by p rows between unbounded preceding and 1 preceding), 0) as before from n)
    select c_custkey, cast((row_number() over (partition by p.p order by o, c_custkey) + before - 1) % 5 as int) as fold from p join b on p.p = b.p"""
)
def kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of equal size, in an order by arithmetic that both engines share."""
    return R.equal_folds(fixture(spark, sf_dir, "customer"), "c_custkey", 5, (F.col("c_custkey").cast("bigint") * 7919) % 1000003)


@query()
def bootstrap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled mean per replicate."""
    m = fixture(spark, sf_dir, "fx_models").where("subset = 'F'").groupBy("tripid").agg(F.avg("jaccard_exact").alias("j"))
    draws = R.bootstrap(m, ["tripid"], 50, seed=7)
    return draws.groupBy("replicate").agg(F.sum("draws").alias("n"), F.round(F.sum(F.col("draws") * F.col("j")) / F.sum("draws"), 8).alias("mean"))


@query()
def holdout_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One random order per customer, the rest held out; and a stratified sample: sizes."""
    o = fixture(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    one = R.one_per_group(o, "o_custkey", "o_orderkey")
    rest = o.join(one, "o_orderkey", "left_anti")
    some = R.stratified(o, "o_orderpriority", "o_orderkey", 200)
    count = lambda d, n: d.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(one, "chosen").unionByName(count(rest, "held out")).unionByName(count(some, "stratified"))


@query(
    """select id, trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')) as plain, array_to_string(list_transform(list_filter(string_split_regex(trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda t: t <> ''),
    lambda t: case t when 'street' then 'st' when 'road' then 'rd' when 'lane' then 'ln' when 'way' then 'way' else t end), ' ') as contracted from {fx_names}"""
)
def name_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixture(spark, sf_dir, "fx_names")
    return n.select("id", F.trim(F.regexp_replace(F.lower("name"), r"[^a-z0-9\s]", "")).alias("plain"), S.contract_suffix(F.col("name")).alias("contracted"))


@query(
    """select a.id, coalesce(len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) > 0, false) as shared from {fx_names} a join {fx_names} b on b.id = a.id + 1"""
)
def name_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixture(spark, sf_dir, "fx_names")
    m = n.select((F.col("id") - 1).alias("id"), F.col("name").alias("other"))
    return n.join(m, "id").select("id", S.shares_token(F.col("name"), F.col("other")).alias("shared"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from {events}")
def json_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a JSON text, by a pattern of their keys."""
    tags = F.from_json("props", "map<string,string>")
    return fixture(spark, sf_dir, "events").select("event_id", F.element_at(S.keys_like(tags, "k"), "k").cast("int").alias("k"))


@query(
    """with p as (select linkid, dist, (elev - lag(elev) over w) / 10 * 100 as slope from {fx_profile} window w as (partition by linkid order by dist)),
    f as (select *, dist * 3 as len, case when slope > 3 and slope <= 5 and dist * 3 > 120 then 6 when slope > 5 and slope <= 8 and dist * 3 > 60 then 5 when slope > 8 and slope <= 10 and dist * 3 > 30 then 4.5
      when slope > 10 and slope <= 13 and dist * 3 > 15 then 4 else 7 end as g from p where slope is not null)
    select linkid, dist, round(least(10, case when slope < -30 then 1.5 when slope < 0 then 1 + 2 * (0.7 / 13) * slope + 0.7 / 13 / 13 * slope * slope when slope <= 20 then 1 + (slope / g) ** 2 else 10 end), 6) as factor from f"""
)
def speed_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("linkid").orderBy("dist")
    p = fixture(spark, sf_dir, "fx_profile").withColumn("slope", (F.col("elev") - F.lag("elev").over(w)) / 10 * 100).where("slope is not null")
    return p.select("linkid", "dist", F.round(S.slope_factor(F.col("slope"), F.col("dist") * 3), 6).alias("factor"))


@query(
    """select 'semi' as kind, count(*) as n from {orders} where o_custkey in (select B from {fx_links} where link_type = 'bike') union all
    select 'anti', count(*) from {orders} where o_custkey not in (select B from {fx_links} where link_type = 'bike')"""
)
def links_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, ends = fixture(spark, sf_dir, "orders"), fixture(spark, sf_dir, "fx_links").where("link_type = 'bike'").select("B")
    count = lambda how: o.join(ends, o.o_custkey == ends.B, f"left_{how}").agg(F.lit(how).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("semi").unionByName(count("anti"))


@query(
    """select s, n, round(m, 6) as m from (select 'union' as s, count(*) as n, avg(N) as m from (select A as N from {fx_links} union select B from {fx_links})
    union all select 'intersect', count(*), avg(N) from (select A as N from {fx_links} intersect select B from {fx_links}) union all select 'except', count(*), avg(N) from (select N from {fx_nodes} except select A from {fx_links}))"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, nodes = fixture(spark, sf_dir, "fx_links"), fixture(spark, sf_dir, "fx_nodes").select("N")
    a, b = links.select(F.col("A").alias("N")), links.select(F.col("B").alias("N"))
    sets = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": nodes.subtract(a)}
    parts = [d.agg(F.lit(n).alias("s"), F.count(F.lit(1)).alias("n"), F.round(F.avg("N"), 6).alias("m")) for n, d in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
