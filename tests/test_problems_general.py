"""Grid, references, nearby points, spikes, stays: defined cases, small hand-made ones and brute force."""

import math
import random
import unittest.mock

import numpy as np
import pandas as pd
import pytest

import pathloom.operators.spikes as spikes_module
from pathloom.operators.grid import empty_cells, regular_grid
from pathloom.operators.nearby import haversine_m, latest_position, places_within, points_in_regions, points_within
from pathloom.operators.pieces import whole_groups
from pathloom.operators.references import Parent, Reference, orphan_references, orphans_per_period
from pathloom.operators.spikes import SpikeRules, forest_scores, implausible_readings, score_readings, wrong_summaries
from pathloom.operators.stays import StayRules, in_order, smooth, stops_and_trips, wild_fixes

T = "cast(timestamp_seconds({}) as timestamp)"
PINGS = "rec bigint, seq bigint, t double, x double, y double, v double, acc double, extra string"


def timed(df):
    return df.selectExpr("*", "timestamp_micros(cast(t * 1000000 as bigint)) as at")


class TestGrid:
    def grid(self, spark, data, **kw):
        df = timed(spark.createDataFrame(data, "src bigint, t double, v double, slot_start string"))
        return regular_grid(df, "src", "at", "v", **kw)

    def test_time_weights_and_gaps(self, spark):
        g = {r["slot_start"]: r for r in self.grid(spark, [(1, 0.0, 10.0, "x"), (1, 15.0, 20.0, "x"), (1, 130.0, 1.0, "x")]).collect()}
        assert sorted(g) == [0, 30, 60, 90, 120]
        assert g[0]["mean_value"] == pytest.approx(15.0) and g[0]["coverage"] == 1.0 and g[0]["n_readings"] == 2
        assert g[30]["state"] == "filled" and g[30]["mean_value"] == 20.0
        assert g[60]["coverage"] == pytest.approx(0.5) and g[90]["state"] == "missing" and g[90]["mean_value"] is None
        assert g[120]["state"] == "observed"

    def test_defined_cases(self, spark, rows):
        data = [(1, 0.0, 10.0, "x"), (1, 0.0, 20.0, "x"), (1, 0.0, 10.0, "x"), (None, 5.0, 1.0, "x"), (2, None, 1.0, "x"), (2, 5.0, None, "x"), (2, 5.0, float("nan"), "x"), (3, -31.0, 1.0, None)]
        got = rows(self.grid(spark, data).select("src", "slot_start", "n_readings", "mean_value"))
        assert got == [(1, 0, 1, 40 / 3), (3, -60, 1, 1.0)]
        assert self.grid(spark, []).count() == 0

    def test_blocks_join(self, spark):
        """Readings hours apart: cells of the gap, across blocks and slices."""
        g = self.grid(spark, [(1, 10.0, 1.0, ""), (1, 3 * 86400.0, 1.0, ""), (1, 3 * 86400.0 + 7300, 1.0, "")])
        assert empty_cells(g).count() == 3 * 2880 - 1 + 7300 // 30 - 1
        assert g.where("n_readings > 0").count() == 3

    def test_against_brute_force(self, spark):
        rnd = random.Random(1)
        data = [(s, round(rnd.uniform(0, 9000), 3), rnd.random(), "") for s in (1, 2) for _ in range(150)]
        found = {(r[0], r[1]) for r in empty_cells(self.grid(spark, data)).select("src", "slot_start").collect()}
        want = set()
        for s in (1, 2):
            slots = {int(t // 30) * 30 for x, t, _, _ in data if x == s}
            want |= {(s, c) for c in range(min(slots), max(slots), 30) if c not in slots}
        assert found == want


class TestReferences:
    def run(self, spark, refs, parents, **kw):
        ts = lambda c: f"timestamp_seconds({c}) as {c}"
        r = spark.createDataFrame(refs, "id bigint, ref bigint, at bigint, key string, part int").selectExpr("id", "ref", ts("at"), "key", "part")
        p = spark.createDataFrame(parents, "k bigint, a bigint, b bigint, us int").selectExpr("k", ts("a"), ts("b"), "us")
        return orphan_references([Reference(r, "t", "ref", "id", "at", "p")], {"p": Parent(p, "k", "a", "b")}, **kw)

    def test_reasons_and_bounds(self, spark, rows):
        refs = [(1, 7, 100, "", 0), (2, 7, 200, "", 0), (3, 7, 99, "", 0), (4, 8, 100, "", 0), (5, None, 100, "", 0), (6, 7, None, "", 0), (7, 7, 350, "", 0), (1, 7, 100, "", 0), (2, 7, 200, "", 0), (8, 9, 100, "", 0)]
        parents = [(7, 100, 200, 0), (7, 100, 200, 1), (7, 300, None, 0), (None, 1, 2, 0), (9, 50, 50, 0)]
        got = rows(self.run(spark, refs, parents).select("row_id", "reason"))
        assert got == [(2, "deleted"), (3, "late"), (4, "missing"), (8, "missing")]
        split = rows(self.run(spark, refs, parents, part_rows=2).select("row_id", "reason"))
        assert split == got

    def test_empty(self, spark):
        assert self.run(spark, [], []).count() == 0
        only = self.run(spark, [(1, 1, 0, "", 0)], [])
        assert [r["reason"] for r in only.collect()] == ["missing"]
        assert orphans_per_period(only).first()["period"] == "1970-01"

    def test_against_brute_force(self, spark):
        rnd = random.Random(2)
        parents = [(rnd.randrange(6), a := rnd.randrange(100), None if rnd.random() < 0.2 else a + rnd.randrange(-2, 40), 0) for _ in range(30)]
        refs = [(i, rnd.randrange(8), rnd.randrange(130), "", 0) for i in range(400)]
        got = {r["row_id"] for r in self.run(spark, refs, parents, part_rows=20).collect()}
        assert got == {i for i, k, t, _, _ in refs if not any(p == k and a <= t and (b is None or t < b) for p, a, b, _ in parents)}


class TestNearby:
    def pairs(self, spark, pts, radius, **kw):
        df = spark.createDataFrame(pts, "k string, la double, lo double, id string, lat string")
        return {(r[0], r[1]) for r in points_within(df, "k", "la", "lo", radius, **kw).select("id_a", "id_b").collect()}

    def brute(self, pts, radius):
        ok = sorted({(k, a, o) for k, a, o, *_ in pts if k is not None and a is not None and o is not None and not math.isnan(a) and abs(a) <= 90 and abs(o) <= 180})
        return {(p[0], q[0]) for i, p in enumerate(ok) for q in ok[i + 1 :] if haversine_m(p[1], p[2], q[1], q[2]) <= radius}

    @pytest.mark.parametrize("piece_points", [2, 40, 10_000])
    def test_against_brute_force(self, spark, piece_points):
        rnd = random.Random(3)
        pts = [(f"s{i:03}", 36 + rnd.gauss(0, 0.004), -32 + rnd.gauss(0, 0.01), "", "") for i in range(250)]
        pts += [(f"d{i:03}", 36.0, -32 + i * 0.0002, "", "") for i in range(60)] + [(f"e{i}", 36.0, -32.0, "", "") for i in range(6)]
        assert self.pairs(spark, pts, 150.0, piece_points=piece_points) == self.brute(pts, 150.0)

    def test_defined_cases(self, spark):
        pts = [("a", 10.0, 179.9999, "", ""), ("b", 10.0, -179.9999, "", ""), ("c", None, 1.0, "", ""), (None, 10.0, 180.0, "", ""), ("d", float("nan"), 0.0, "", ""), ("e", 91.0, 0.0, "", ""), ("a", 10.0, 179.9999, "", "")]
        assert self.pairs(spark, pts, 100.0) == {("a", "b")}
        assert self.pairs(spark, [], 100.0) == set()
        assert self.pairs(spark, [("p", 89.9999, 10.0, "", ""), ("q", 89.9999, -170.0, "", "")], 100.0) == {("p", "q")}

    def test_batches_and_members(self, spark):
        rnd = random.Random(5)
        pts = [(f"s{i:03}", 36 + rnd.gauss(0, 0.001), -32 + rnd.gauss(0, 0.001), "", "") for i in range(150)] + [(f"e{i}", 36.0, -32.0, "", "") for i in range(9)]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            assert self.pairs(spark, pts, 150.0, piece_points=4) == self.brute(pts, 150.0)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        pairs, members = places_within(spark.createDataFrame(pts, "k string, la double, lo double, id string, lat string"), "k", "la", "lo", 150.0)
        of = {}
        for rep, i in members.collect():
            of.setdefault(rep, []).append(i)
        assert len(of["e0"]) == 9 and sum(map(len, of.values())) == len(pts)
        found = {tuple(sorted((x, y))) for a, b, _ in pairs.collect() for x in of[a] for y in of[b]} | {(x, y) for m in of.values() for x in m for y in m if x < y}
        assert found == self.brute(pts, 150.0)

    def test_poles_have_each_pair_once(self, spark):
        pts = [(f"p{i}", 89.9995, i * 30.0 - 175, "", "") for i in range(12)]
        df = spark.createDataFrame(pts, "k string, la double, lo double, id string, lat string")
        got = [(r[0], r[1]) for r in points_within(df, "k", "la", "lo", 500.0).collect()]
        assert sorted(got) == sorted(self.brute(pts, 500.0)) and len(got) == 66

    def test_regions(self, spark):
        rnd = random.Random(6)
        polys = {i: [(x + math.cos(t) * s, y + math.sin(t) * s * 0.6) for t in (0.1, 1.0, 2.5, 3.0, 5.0)] for i, (x, y, s) in enumerate((rnd.uniform(-90, 90), rnd.uniform(-90, 90), 2.0 ** rnd.randrange(-3, 7)) for _ in range(40))}
        polys[98], polys[99] = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]
        pts = [(i, rnd.uniform(-100, 100), rnd.uniform(-100, 100), "c") for i in range(500)] + [(501, 1.0, 0.5, "c"), (502, 0.0, 0.0, "c"), (503, None, 1.0, "c"), (None, 0.5, 0.5, "c"), (504, float("nan"), 0.0, "c"), (0, 1.0, 1.0, "c")]

        def inside(x, y, p):
            return sum((p[i][1] > y) != (p[i - 1][1] > y) and x < p[i][0] + (y - p[i][1]) * (p[i - 1][0] - p[i][0]) / (p[i - 1][1] - p[i][1]) for i in range(len(p))) % 2 == 1

        regions = spark.createDataFrame([(k, v, 0) for k, v in polys.items()] + [(7, None, 0), (None, polys[98], 0), (8, polys[98][:2], 0)], "r bigint, p array<struct<x:double,y:double>>, x bigint")
        df = spark.createDataFrame(pts, "k bigint, x double, y double, p string")
        got = {(a, b) for a, b in points_in_regions(df, "k", "x", "y", regions, "r", "p").collect()}
        assert got == {(i, k) for i, x, y, _ in pts if i is not None and x is not None and x == x for k, p in polys.items() if inside(x, y, p)}
        assert (501, 99) in got and (501, 98) not in got
        assert points_in_regions(df.limit(0), "k", "x", "y", regions, "r", "p").count() == 0 == points_in_regions(df, "k", "x", "y", regions.limit(0), "r", "p").count()

    def test_latest_position(self, spark, rows):
        df = spark.sql(
            "select * from values ('a', 1D, 1D, 1), ('a', 2D, 2D, 2), ('b', 1D, 1D, 1), ('b', null, null, 2), ('c', 50D, 1D, null), ('d', 3D, 3D, 1), ('d', 4D, 3D, 1), (null, 1D, 1D, 1) as t(k, la, lo, v)"
        )
        assert rows(latest_position(df, "k", "la", "lo", "v", (0, 10, 0, 10))) == [("a", 2.0, 2.0), ("d", 4.0, 3.0)]


def ride(t0, t1, x0, speed, step=5.0):
    n = int((t1 - t0) / step)
    return [(t0 + i * step, x0 + speed * i * step) for i in range(n + 1)]


class TestStays:
    def legs(self, spark, pings, **kw):
        df = timed(spark.createDataFrame(pings, PINGS))
        got = stops_and_trips(df, "rec", "seq", "at", "x", "y", "v", "acc", to_metres=1.0, to_mps=1.0, **kw)
        return sorted((r["rec"], r["started"], r["kind"], r["leg_no"]) for r in got.collect())

    def kinds(self, spark, pings, **kw):
        return [(r[2], r[3]) for r in self.legs(spark, pings, **kw)]

    def make(self, points, rec=1, seed=0):
        rnd = np.random.default_rng(seed)
        return [(rec, i, float(t), float(x + rnd.normal(0, 4)), float(rnd.normal(0, 4)), None, 8.0, "") for i, (t, x) in enumerate(points)]

    def test_stop_between_rides(self, spark):
        pts = ride(0, 300, 0, 5) + [(300 + i * 15, 1500) for i in range(1, 30)] + ride(750, 1000, 1500, 5)
        pings = self.make(pts)
        pings[90] = (1, 90, pings[90][2], 5000.0, 5000.0, 90.0, None, "")  # a wild fix in the stop
        assert self.kinds(spark, pings) == [("trip", 1), ("stop", 1), ("trip", 2)]
        assert self.kinds(spark, pings + pings[:5] + [(None, 1, 1.0, 1.0, 1.0, 1.0, 1.0, ""), (2, 0, 1.0, 0.0, 0.0, 1.0, 1.0, ""), (1, None, 1.0, 1.0, 1.0, 1.0, 1.0, "")]) == [("trip", 1), ("stop", 1), ("trip", 2)]

    def test_silences(self, spark):
        there = ride(0, 300, 0, 5)
        assert self.kinds(spark, self.make(there + ride(1300, 1600, 1505, 5))) == [("trip", 1), ("stop", 1), ("trip", 2)]
        assert self.kinds(spark, self.make(there + ride(1300, 1600, 4000, 5))) == [("trip", 1), ("trip", 2)]
        assert self.kinds(spark, self.make(there + ride(700, 1000, 3000, 5))) == [("trip", 1)]

    def test_short_waits_and_circles(self, spark):
        assert self.kinds(spark, self.make(ride(0, 300, 0, 5) + [(300 + i * 10, 1500) for i in range(1, 18)] + ride(480, 700, 1500, 5))) == [("trip", 1)]
        circle = [(1, i, 5.0 * i, 40 * math.cos(i * 5 * 4 / 40), 40 * math.sin(i * 5 * 4 / 40), 4.0, 8.0, "") for i in range(150)]
        assert ("stop", 1) not in self.kinds(spark, circle)

    def test_long_recordings_in_pieces(self, spark, monkeypatch):
        pts = ride(0, 1500, 0, 5) + [(1500 + i * 5, 7500) for i in range(1, 120)] + ride(2100, 4000, 7500, 5)
        whole = self.kinds(spark, self.make(pts))
        monkeypatch.setattr("pathloom.operators.stays.PIECE", 128)
        monkeypatch.setattr("pathloom.operators.stays.CONTEXT", 40)
        assert self.kinds(spark, self.make(pts)) == whole == [("trip", 1), ("stop", 1), ("trip", 2)]

    def test_empty_and_still(self, spark):
        assert self.legs(spark, []) == []
        assert self.kinds(spark, self.make([(i * 10, 0) for i in range(60)])) == [("stop", 1)]

    def test_smoother_is_close_to_the_truth(self):
        rnd = np.random.default_rng(1)
        t = np.arange(200.0)[:, None] * 2
        x = 5 * t + rnd.normal(0, 6, t.shape)
        sx, _, speed, used = smooth(t, x, np.zeros_like(t), np.full_like(t, 36.0), np.ones_like(t, bool), StayRules())
        assert used.all() and np.abs(sx - 5 * t).mean() < 3 and abs(speed[20:-20].mean() - 5) < 0.2

    def test_clocks_out_of_order(self):
        t = np.array([1.0, 2, 99, 3, 4, 0, 5, 5])
        assert t[in_order(t)].tolist() == [1, 2, 3, 4, 5, 5] and in_order(t[:0]).tolist() == []

    def test_wild_fixes(self):
        x = np.array([0.0, 10, 900, 30, 40, 2000])
        t = np.arange(6.0) * 5
        assert wild_fixes(t, x, np.zeros(6), np.full(6, np.nan), StayRules()).tolist() == [False, False, True, False, False, True]


class TestSpikes:
    def found(self, spark, series, **kw):
        data = [(rec, i, float(i * 5), None, None, v, None, "") for rec, vs in series.items() for i, v in enumerate(vs)]
        df = timed(spark.createDataFrame(data, PINGS))
        return implausible_readings(df, "rec", "seq", "at", "v", **kw)

    def cases(self, df):
        return {(r["rec"], r["seq"], r["rule"]) for r in df.where("rule <> 'source'").select("rec", "seq", "rule").collect()}

    def test_rules(self, spark):
        usual = [10 + math.sin(i) * 3 for i in range(60)]
        a = list(usual)
        a[10], a[11], a[20], a[30], a[40], a[41] = 40.0, 45.0, -5.0, 71.0, None, -1.0
        b = usual[:20] + [7.0] * 12 + usual[:20]
        c = usual[:20] + [7.0] * 6 + [-1.0] + [7.0] * 6 + [0.0] * 20
        d = usual[:30] + [40.0] * 4 + usual[:30]
        got = self.cases(self.found(spark, {1: a, 2: b, 3: c, 4: d}))
        assert got == {(1, 10, "spike"), (1, 11, "spike"), (1, 20, "limit"), (1, 30, "limit")} | {(2, i, "stuck") for i in range(20, 32)}

    def test_forest_decides(self, spark):
        """Where the forest says nothing, no spike is found; where it says anything, few are."""
        rnd = np.random.default_rng(3)
        frame = []
        for rec in range(40):
            v = rnd.normal(10, 1.5, 80).round(2)
            v[rnd.choice(np.arange(5, 75, 5), 2, replace=False)] = [33.0, 41.5]
            frame += [(rec, i, i * 5_000_000, x) for i, x in enumerate(v)]
        frame = pd.DataFrame(frame, columns=["rec", "seq", "us", "v"]).assign(piece=0, own=True)

        def spikes(scores):
            with unittest.mock.patch.object(spikes_module, "forest_scores", scores):
                r = SpikeRules()
                first = pd.concat(spikes_module._scored(r, False)(iter([frame])))
                return int((pd.concat(spikes_module._judged(r)(iter([first.sort_values(["rec", "rule", "seq"])])))["rule"] == "spike").sum())

        assert spikes(forest_scores) == 80
        assert spikes(lambda f, group, seed, r: np.full(len(f), 0.5)) == 0
        assert spikes(lambda f, group, seed, r: rnd.random(len(f))) < 60

    def test_pieces_agree_with_whole(self, spark, monkeypatch):
        rnd = random.Random(4)
        vs = [round(rnd.uniform(5, 12), 2) for _ in range(900)]
        for i in (100, 255, 256, 511, 700):
            vs[i] = 50.0 + i / 100
        vs[505:520] = [9.0] * 15
        whole = self.cases(self.found(spark, {1: vs}))
        monkeypatch.setattr("pathloom.operators.spikes.PIECE", 256)
        assert self.cases(self.found(spark, {1: vs})) == whole
        assert len(whole) == 4 + 15

    def test_pieces_with_holes_between(self, spark, monkeypatch):
        """A stuck run goes on over a hole in the counter that is wider than a piece."""
        vs = [(i, 5.0 + i % 3) for i in range(250)] + [(250 + i, 9.0) for i in range(6)] + [(2000 + i, 9.0) for i in range(6)] + [(2006 + i, 5.0 + i % 3) for i in range(50)]
        data = [(1, i, float(i * 5), None, None, v, None, "") for i, v in vs]
        monkeypatch.setattr("pathloom.operators.spikes.PIECE", 256)
        got = self.cases(implausible_readings(timed(spark.createDataFrame(data, PINGS)), "rec", "seq", "at", "v"))
        assert got == {(1, i, "stuck") for i in [*range(250, 256), *range(2000, 2006)]}

    def test_defined_cases(self, spark):
        assert self.found(spark, {}).count() == 0
        none = self.found(spark, {1: [None, -1.0, float("nan")], 2: [5.0]})
        assert self.cases(none) == set()
        assert {(r["rec"], r["v"], r["score"]) for r in none.collect()} == {(1, None, None), (2, 5.0, 5.0)}

    def test_every_reading_has_a_score(self, spark):
        data = [(1, i, float(i), None, None, 5.0 + (i % 7) if i != 50 else 60.0, None, "") for i in range(100)] + [(1, 100, 0.0, None, None, None, None, "")] * 2
        got = {r["seq"]: r["score"] for r in score_readings(timed(spark.createDataFrame(data, PINGS)), "rec", "seq", "at", "v").collect()}
        assert len(got) == 101 and got[100] is None and max((s, i) for i, s in got.items() if s is not None)[1] == 50

    def test_forest_is_repeatable_and_separate(self):
        rnd = np.random.default_rng(5)
        f = rnd.normal(size=(300, 2))
        f[7] = 9
        r = SpikeRules(trees=100)
        one = forest_scores(f, np.zeros(300, int), np.array([3], np.uint64), r)
        two = forest_scores(np.vstack([f, f * 100]), np.repeat([0, 1], 300), np.array([3, 9 << 16], np.uint64), r)
        assert np.allclose(one, two[:300]) and one.argmax() == 7 and (two[300:] > two[307]).sum() <= 2

    def test_summaries(self, spark, rows):
        found = self.found(spark, {1: [4.0, 6.0], 2: [4.0, 6.0], 3: [4.0, 6.0], 4: [4.0, 6.0], 5: [-1.0]})
        sums = spark.createDataFrame([(1, 5.0, 6.0), (1, 5.0, 6.0), (2, 2.0, 6.0), (3, 5.0, 13.0), (4, None, None), (5, 3.0, 2.0), (None, 1.0, 0.5)], "rec bigint, m double, x double")
        assert rows(wrong_summaries(found, sums, "rec", "m", "x", "v")) == [(2,), (3,), (5,)]


def test_whole_groups_keeps_groups_together():
    import pandas as pd

    frame = pd.DataFrame({"k": np.repeat(np.arange(20), np.arange(1, 21)), "v": 1})
    parts = list(whole_groups((frame.iloc[i : i + 7] for i in range(0, len(frame), 7)), ["k"], 10))
    assert sum(map(len, parts)) == len(frame)
    seen = [k for p in parts for k in p["k"].unique()]
    assert seen == sorted(set(seen))
