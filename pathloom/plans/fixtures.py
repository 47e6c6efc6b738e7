"""Domain tables derived from the star schema, each written once as SQL that both Spark and DuckDB run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pathloom.common import table

#: name -> SQL; a word in braces is another fixture or a stored table.
FIXTURES: dict[str, str] = {
    "fx_nodes": "select cast(c_custkey as bigint) as N, cast((c_custkey * 7919) % 10007 as double) as x, cast((cast(c_custkey as bigint) * 104729) % 10009 as double) as y from {customer}",
    "fx_size": "select count(*) as n from {customer}",
    "fx_link_rows": """select cast(o_orderkey as bigint) as linkid, cast(o_custkey as bigint) as A, (cast(o_custkey as bigint) * 31 + cast(o_orderkey as bigint) * 17 + 1) % n as B,
        o_orderkey % 5 = 0 as oneway, cast(year(o_orderdate) as int) as year, o_orderpriority as priority, o_orderstatus as status, o_totalprice as price
        from {orders} cross join {fx_size}""",
    "fx_links": """select l.linkid, l.A, l.B, l.oneway, l.year, l.status, l.price,
        case l.priority when '1-URGENT' then 'road' when '2-HIGH' then 'bike' when '3-MEDIUM' then 'pedestrian' when '4-NOT SPECIFIED' then 'service' else 'sidewalk' end as link_type,
        a.x as ax, a.y as ay, b.x as bx, b.y as by, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 4) as length_ft
        from {fx_link_rows} l join {fx_nodes} a on a.N = l.A join {fx_nodes} b on b.N = l.B where l.A <> l.B""",
    "fx_attributes": """select linkid, A, B, year, link_type, length_ft, oneway,
        case when linkid % 7 = 0 then null else cast(linkid % 6 as int) end as lanes_a, case when linkid % 11 = 0 then null else cast(linkid % 4 + 1 as int) end as lanes_b,
        case when linkid % 3 = 0 then null when linkid % 3 = 1 then 1 else 2 end as aadt_class, case when linkid % 9 = 0 then null else cast(linkid % 3 as int) end as speed_class,
        case linkid % 8 when 0 then 'bike lane' when 1 then 'cycletrack' when 2 then 'multi use path' when 3 then 'buffered bike lane' when 4 then 'sharrow' else null end as facility_fwd,
        case linkid % 10 when 0 then 'bike lane' when 3 then 'cycletrack' when 7 then 'sharrow' else null end as facility_rev,
        cast((linkid * 13) % 90 as double) / 10 as grade from {fx_links}""",
    "fx_directed": """select l.linkid, l.A, l.B, false as reverse_link, l.ax, l.ay, l.bx, l.by, l.length_ft, l.oneway, l.link_type, l.year from {fx_links} l
        union all select l.linkid, l.B as A, l.A as B, true as reverse_link, l.bx as ax, l.by as ay, l.ax as bx, l.ay as by, l.length_ft, l.oneway, l.link_type, l.year from {fx_links} l""",
    "fx_azimuths": """select e.*, ((degrees(atan2(e.bx - e.ax, e.by - e.ay)) % 360) + 360) % 360 as azimuth from {fx_directed} e""",
    "fx_turn_rows": """select s.linkid as source_linkid, s.reverse_link as source_reverse_link, s.A as source_A, s.B as source_B, t.linkid as target_linkid, t.reverse_link as target_reverse_link, t.A as target_A, t.B as target_B,
        s.link_type as source_link_type, t.link_type as target_link_type, t.length_ft as target_length_ft, (((t.azimuth - s.azimuth) % 360) + 360) % 360 as azimuth_change
        from {fx_azimuths} s join {fx_azimuths} t on s.B = t.A and s.linkid <> t.linkid""",
    "fx_turns": """select *, case when azimuth_change > 330 or azimuth_change < 30 then 'straight' when azimuth_change <= 150 then 'right' when azimuth_change < 210 then 'uturn' else 'left' end as turn_type from {fx_turn_rows}""",
    "fx_costs": """select linkid, reverse_link, A, B, link_type, length_ft, length_ft / 5280 / 9 * 60 as base_min,
        round(length_ft / 5280 / 9 * 60 * (1 + case link_type when 'road' then 0.5 when 'bike' then -0.2 else 0 end), 8) as cost from {fx_directed}""",
    "fx_priced": """select t.source_linkid, t.source_reverse_link, t.target_linkid, t.target_reverse_link, l.cost as target_cost,
        case turn_type when 'left' then 0.1 when 'uturn' then 0.3 else 0 end as turn_cost, l.cost + case turn_type when 'left' then 0.1 when 'uturn' then 0.3 else 0 end as total_cost
        from {fx_turns} t join {fx_costs} l on t.target_linkid = l.linkid and t.target_reverse_link = l.reverse_link""",
    "fx_costs_then": """select linkid, reverse_link, A, B, link_type, length_ft, base_min, round(base_min * (1 + case link_type when 'road' then 0.1 when 'bike' then -0.2 else 0 end), 8) as cost from {fx_costs}""",
    "fx_priced_then": """select p.source_linkid, p.source_reverse_link, p.target_linkid, p.target_reverse_link, l.cost as target_cost, p.turn_cost, l.cost + p.turn_cost as total_cost
        from {fx_priced} p join {fx_costs_then} l on p.target_linkid = l.linkid and p.target_reverse_link = l.reverse_link""",
    "fx_zones": """select cast(c_nationkey as bigint) as taz, min(N) as N from (select A as N from {fx_links} union select B from {fx_links}) n join {customer} on c_custkey = N group by 1""",
    "fx_od_nodes": "select o.orig_taz, o.dest_taz, o.trips, a.N as origin, b.N as dest from {fx_od} o join {fx_zones} a on a.taz = o.orig_taz join {fx_zones} b on b.taz = o.dest_taz",
    "fx_trace": """select cast(user_id as bigint) as tripid, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as sequence, ts, event_id, event_type,
        value / 20 as speed_mph, cast((event_id * 37) % 10007 as double) as x, cast((event_id * 53) % 10009 as double) as y from {events}""",
    "fx_profile": """select cast(l_orderkey as bigint) as linkid, cast(10 * (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) as double) as dist,
        cast(l_quantity as double) as elev from {lineitem}""",
    "fx_routes": """select distinct cast(o_custkey as bigint) as tripid, case when o_orderstatus = 'F' then 'chosen' else 'modeled' end as kind, cast(l_suppkey as bigint) as linkid,
        round(1 + abs(s_acctbal), 2) as len from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey where o_orderstatus in ('F', 'O')""",
    "fx_models": """select l_linestatus as subset, l_returnflag as calibration_name, cast(l_linenumber as int) as run_num, cast(l_orderkey as bigint) as tripid, avg(l_discount) as jaccard_exact,
        sum(l_quantity) as intersection_len, sum(l_quantity + l_linenumber) as union_len from {lineitem} group by 1, 2, 3, 4""",
    "fx_od": """select cast(c_nationkey as bigint) as orig_taz, cast(s_nationkey as bigint) as dest_taz, count(*) as trips from {lineitem} join {orders} on l_orderkey = o_orderkey
        join {customer} on o_custkey = c_custkey join {supplier} on l_suppkey = s_suppkey group by 1, 2""",
    "fx_stops": "select N as stop_id, N % 7 as route_id, x, y from {fx_nodes} where N in (select (cast(s_suppkey as bigint) * 10) % n from {supplier} cross join {fx_size})",
    "fx_stop_times": """select cast(o_orderkey as bigint) as trip_id, cast(o_custkey % 7 as bigint) as route_id,
        cast(row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as stop_sequence, (cast(l_suppkey as bigint) * 10) % n as stop_id,
        cast((o_orderkey % 120) * 60 + 300 * row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as departure_sec
        from {lineitem} join {orders} on l_orderkey = o_orderkey cross join {fx_size}""",
    "fx_sources": "select min(N) as stop_id from {fx_nodes} join {customer} on c_custkey = N where N in (select stop_id from {fx_stops}) group by c_nationkey",
    "fx_names": "select cast(p_partkey as bigint) as id, p_name as name from {part}",
}
_NAME = re.compile(r"\{(\w+)\}")


def needed(sql: str) -> list[str]:
    """The fixtures a text needs, each after those it needs itself."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in FIXTURES:
            for n in [*needed(FIXTURES[name]), name]:
                if n not in out:
                    out.append(n)
    return out


def oracle(sql: str) -> str:
    """The text with its fixtures as common table expressions."""
    names = needed(sql)
    plain = lambda s: _NAME.sub(r"\1", s)
    body = plain(sql)
    if not names:
        return body
    ctes = ",\n".join(f"{n} as ({plain(FIXTURES[n])})" for n in names)
    if re.match(r"\s*with\s+recursive\b", body, re.I):
        return f"with recursive {ctes},\n{re.sub(r'^\s*with\s+recursive', '', body, flags=re.I)}"
    if re.match(r"\s*with\b", body, re.I):
        return f"with {ctes},\n{re.sub(r'^\s*with', '', body, flags=re.I)}"
    return f"with {ctes}\n{body}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture or a stored table as a DataFrame."""
    if name not in FIXTURES:
        return table(spark, sf_dir, name)
    text = FIXTURES[name]
    return spark.sql(text, **{n: fixture(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))})
