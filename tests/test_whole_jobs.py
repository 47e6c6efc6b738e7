"""Operators and queries do the whole job: every source, point and candidate."""

import math
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathloom.operators import conflation as K
from pathloom.operators import map_matching as H
from pathloom.operators import transit as Z
from pathloom.plans.fixtures import fixture


def _arrivals(sources, times, walks, rides):
    """Best (arrival, rides) of (source, departure, stop) by plain rounds."""
    trips = {}
    for trip, q, stop, at in sorted(times):
        trips.setdefault(trip, []).append((q, stop, at))
    out = {}
    for source, departure, stop, at in sources:
        walk = lambda t: {s: min([t.get(s, math.inf), *[t[a] + sec for a, b, sec in walks if b == s and a in t]]) for s in {*t, *[b for a, b, _ in walks if a in t]}}
        best = {s: (v, 0) for s, v in walk({stop: float(at)}).items()}
        for k in range(1, rides + 1):
            rode = {}
            for c in trips.values():
                on = [q for q, s, v in c if s in best and best[s][0] <= v]
                for q, s, v in c:
                    if on and q > min(on):
                        rode[s] = min(rode.get(s, math.inf), float(v))
            for s, v in walk(rode).items():
                if s not in best or v < best[s][0]:
                    best[s] = (v, k)
        out |= {(source, departure, s): v for s, v in best.items()}
    return out


def test_itineraries_against_plain_rounds(spark):
    rnd = random.Random(5)
    times = [(t, q, rnd.randrange(14), 80 * (t * 7 % 25) + 150 * q) for t in range(25) for q in range(1, 6)]
    walks = [(a, b, 40.0 + a) for a, b in ((0, 1), (1, 0), (5, 6), (6, 5), (20, 3), (3, 20))]
    sources = [(s, d, s, d) for s in [*range(14), 20, 99] for d in (0, 900, 1800)]
    frames = [spark.createDataFrame(sources, "source bigint, departure bigint, stop_id bigint, at bigint"), spark.createDataFrame(times, "trip_id bigint, stop_sequence int, stop_id bigint, departure_sec bigint")]
    frames.append(spark.createDataFrame(walks, "from_stop bigint, to_stop bigint, seconds double"))
    want = _arrivals(sources, times, walks, 2)
    for small in (Z.SMALL_TIMETABLE, 0):
        got = {(r["source"], r["departure"], r["stop_id"]): (r["arrival"], r["rides"]) for r in Z.search_itineraries(*frames, 2, small).collect()}
        assert got == want


def test_every_stop_is_a_source(spark, data):
    got = entry.queries()["raptor_all_departures"](spark, data).cache()
    stops = {r["stop_id"] for r in fixture(spark, data, "fx_stops").collect()}
    last = fixture(spark, data, "fx_stop_times").agg(F.max("departure_sec")).first()[0]
    assert {(r["source"], r["departure"]) for r in got.select("source", "departure").distinct().collect()} == {(s, d) for s in stops for d in range(0, last + 1, 900)}
    old = {(r["source"], r["stop_id"]): r["arrival"] for r in entry.queries()["raptor_earliest_arrival"](spark, data).collect()}
    new = {(r["source"], r["stop_id"]): r["arrival"] for r in got.where("departure = 1800").collect()}
    assert old and old == {k: v for k, v in new.items() if k[0] in {s for s, _ in old}}
    zones = entry.queries()["transit_metrics_all_stops"](spark, data).collect()
    assert zones and all(z["destinations"] <= len(stops) for z in zones)


def test_triage_counts_recordings_without_pings(spark, tmp_path):
    pings = [(1, k, 10.0 + 20 * k, 1.0) for k in range(10)]
    spark.createDataFrame(pings, "tripid bigint, sequence int, x double, y double").write.parquet(str(tmp_path / "coords.parquet"))
    spark.createDataFrame([(1,), (1,), (2,), (None,)], "tripid bigint").write.parquet(str(tmp_path / "trips_df.parquet"))
    links = [(k, False, k, k + 1, [(100.0 * k, 0.0), (100.0 * k + 100, 0.0)], None) for k in range(2)]
    spark.createDataFrame(links, "linkid bigint, reverse_link boolean, A bigint, B bigint, geometry array<struct<x:double,y:double>>, removed_at timestamp").write.parquet(str(tmp_path / "links.parquet"))
    got = {r["status"]: (r["n"], r["percent"]) for r in entry.queries()["match_triage"](spark, str(tmp_path)).collect()}
    assert got == {"matched": (1, 50.0), "failed": (1, 50.0)}


def test_one_to_one_at_one_place_and_with_ties(spark):
    rnd = random.Random(2)
    base = [(i, 100.0, 100.0) for i in range(60)] + [(100 + i, float(rnd.randrange(6)), float(rnd.randrange(6))) for i in range(40)]
    join = [(i, 100.0, 101.0) for i in range(60)] + [(100 + i, float(rnd.randrange(6)), float(rnd.randrange(6))) for i in range(45)]
    want, left, right = [], {b[0] for b in base}, {j[0] for j in join}
    for d, i, j in sorted((math.hypot(x - u, y - v), i, j) for i, x, y in base for j, u, v in join):
        if d <= 4.0 and i in left and j in right:
            want.append((i, j))
            left.discard(i)
            right.discard(j)
    frames = spark.createDataFrame(base, "id bigint, x double, y double"), spark.createDataFrame(join, "jid bigint, jx double, jy double")
    got = K.one_to_one(*frames, 4.0).collect()
    assert sorted((r["id"], r["jid"]) for r in got) == sorted(want) and len(want) >= 60


def test_failures_are_matched_with_wider_rules(spark):
    links = [(k, False, k, k + 1, 100.0 * k, 0.0, 100.0 * k + 100, 0.0) for k in range(3)]
    edges = spark.createDataFrame(links, "linkid bigint, reverse_link boolean, A bigint, B bigint, ax double, ay double, bx double, by double")
    pings = [(t, k, 10.0 + 20 * k, y) for t, y in ((1, 2.0), (2, 80.0), (3, 500.0)) for k in range(14)]
    got = {r["tripid"]: (r["match_ratio"], len(r["edges"])) for r in H.match_summary(H.match_again(spark.createDataFrame(pings, "tripid bigint, sequence int, x double, y double"), edges, H.MatchRules(radius=50.0))).collect()}
    assert got == {1: (1.0, 3), 2: (1.0, 3)}


def test_every_link_within_the_radius_is_a_candidate(spark):
    near = [(k, False, 100 + k, 200 + k, 0.0, 1.0 + 0.01 * k, 50.0, 1.0 + 0.01 * k) for k in range(15)]  # all nearer at the first fix than the link that goes on
    edges = spark.createDataFrame([*near, (99, False, 1, 2, 0.0, 2.0, 100.0, 2.0), (98, False, 2, 3, 100.0, 2.0, 200.0, 2.0)], "linkid bigint, reverse_link boolean, A bigint, B bigint, ax double, ay double, bx double, by double")
    pings = spark.createDataFrame([(1, 0, 25.0, 0.0), (1, 1, 95.0, 0.0), (1, 2, 150.0, 0.0)], "tripid bigint, sequence int, x double, y double")
    got = H.match_traces(pings, edges, H.MatchRules(radius=20.0, noise=30.0)).orderBy("sequence").collect()
    assert [r["linkid"] for r in got] == [99, 99, 98]
