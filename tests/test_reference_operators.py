"""Reference operators: hand-made cases at the boundaries, brute force, and invariants."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geometry as G
from pathloom.functions import scalars as S
from pathloom.operators import calibration as C
from pathloom.operators import impedance as I
from pathloom.operators import map_matching as H
from pathloom.operators import metrics as M
from pathloom.operators import network as N
from pathloom.operators import relational as R
from pathloom.operators import routing as P
from pathloom.operators import spatial as X
from pathloom.operators import traces as T
from pathloom.operators import transit as Z


def one(spark, column, **values):
    """The value of a column expression on one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(column.alias("r")).first()["r"]


class TestScalars:
    @pytest.mark.parametrize("change,kind", [(0.0, "straight"), (29.9, "straight"), (30.0, "right"), (150.0, "right"), (150.1, "uturn"), (209.9, "uturn"), (210.0, "left"), (330.0, "left"), (330.1, "straight")])
    def test_turn_classes_part_the_circle(self, spark, change, kind):
        assert one(spark, S.turn_class(F.col("c")), c=change) == kind

    def test_bins(self, spark):
        label = lambda v: one(spark, S.right_closed_bin(F.col("v"), [0, 4, 6, 9], ["a", "b", "c"]), v=v)
        assert [label(v) for v in (-0.1, 0.0, 4.0, 4.1, 6.0, 9.0, 9.1)] == [None, "a", "a", "b", "b", "c", None]
        left = lambda v: one(spark, S.left_closed_bin(F.col("v"), [0, 4, 6], ["a", "b"]), v=v)
        assert [left(v) for v in (-1.0, 0.0, 4.0, 6.0)] == [None, "a", "b", None]

    def test_slope_factor(self, spark):
        f = lambda s, m: one(spark, S.slope_factor(F.col("s"), F.col("m")), s=s, m=m)
        assert f(-31.0, 10.0) == 1.5 and f(25.0, 10.0) == 10.0 and f(0.0, 10.0) == 1.0
        assert f(4.0, 121.0) == pytest.approx(1 + (4 / 6) ** 2) and f(4.0, 120.0) == pytest.approx(1 + (4 / 7) ** 2)
        assert f(-13.0, 10.0) == pytest.approx(1 - 1.4 + 0.7)

    def test_bearings(self, spark):
        b = lambda *v: one(spark, S.bearing(*[F.lit(x) for x in v]))
        assert b(0.0, 0.0, 1.0, 0.0) == pytest.approx(0) and b(0.0, 0.0, 0.0, 1.0) == pytest.approx(90) and b(0.0, 0.0, 0.0, -1.0) == pytest.approx(270)
        assert one(spark, S.planar_azimuth(F.lit(-1.0), F.lit(0.0))) == pytest.approx(270)

    def test_names(self, spark):
        n = lambda f, v: one(spark, f(F.col("v")), v=v)
        assert n(S.contract_suffix, "Peachtree Street, N.E.") == "peachtree st ne" and n(S.contract_suffix, None) is None
        assert n(S.expand_name, "n main st") == "north main street"
        assert n(S.remove_suffix, "North MLK Drive") == "martin luther king" and n(S.remove_suffix, "Street") == "street" and n(S.remove_suffix, "") is None and n(S.remove_suffix, None) is None
        assert n(S.split_names, "A St & B Ave (C Ln)") == ["a st", "b ave", "c ln"]
        assert n(S.normal_id, "12.0") == "12" and one(spark, S.shares_token(F.lit("a b"), F.lit(None).cast("string"))) is False

    def test_arrays(self, spark):
        a = lambda *v: F.array(*[F.lit(x) for x in v])
        assert one(spark, S.sublist_start(a(1, 2, 3, 2, 3), a(2, 3))) == 1 and one(spark, S.sublist_start(a(1, 2), a(3, 4, 5))) is None
        way = a(1, 2, 3, 4, 1)
        d = lambda *v: one(spark, S.sequence_direction(a(*v), way))
        assert d(2, 3) == "forward" and d(3, 2) == "reverse" and d(4, 1, 2) == "forward" and d(2, 1, 4) == "reverse" and d(1, 3) is None
        assert one(spark, S.departures(F.lit(0).cast("bigint"), F.lit(3600).cast("bigint"), 900)) == [0, 900, 1800, 2700]

    def test_along_way(self, spark):
        a = lambda *v: F.array(*[F.lit(x) for x in v])
        line, ring, m = a(1, 2, 3, 4), a(1, 2, 3, 1), a(0.0, 5.0, 7.0, 10.0)
        w = lambda nodes, way: one(spark, S.along_way(a(*nodes), way, m))
        assert tuple(w((2, 3), line)) == (5.0, 7.0) and tuple(w((4, 3, 2), line)) == (5.0, 10.0) and w((1, 3), line) is None
        assert tuple(w((3, 1, 2), ring)) == (7.0, 15.0)

    def test_rules(self, spark):
        c = F.col("x")
        kind = S.first_rule([(c > 5, "a"), (c > 3, "b")], "z", [(c == 9, "last")])
        assert [one(spark, kind, x=v) for v in (9, 6, 4, 1)] == ["last", "a", "b", "z"]
        assert one(spark, S.best_of(["lo", "hi"], F.lit("hi"), F.lit("lo"))) == "hi" and one(spark, S.best_of(["lo", "hi"], F.lit("?"), F.lit(None).cast("string"))) is None
        assert one(spark, S.lanes_per_direction(F.lit(5), F.lit(False))) is None and one(spark, S.lanes_reconciled(F.lit(None).cast("int"), F.lit(2))) == 2


class TestGeometry:
    def test_lines(self, spark):
        ln = G.line((F.lit(0.0), F.lit(0.0)), (F.lit(3.0), F.lit(4.0)), (F.lit(3.0), F.lit(10.0)))
        assert one(spark, G.line_length(ln)) == 11.0 and one(spark, G.measures(ln)) == [0.0, 5.0, 11.0]
        assert tuple(one(spark, G.point_at(ln, F.lit(8.0)))) == (3.0, 7.0)
        assert [tuple(p) for p in one(spark, G.points_every(ln, 5.0))] == [(0.0, 0.0), (3.0, 4.0), (3.0, 9.0)]
        assert [tuple(p) for p in one(spark, G.points_every(ln, 20.0))] == [(0.0, 0.0), (3.0, 10.0)]
        assert len(one(spark, G.route_line(F.array(ln, ln)))) == 5
        assert one(spark, G.line_length(F.array().cast("array<struct<x:double,y:double>>"))) == 0.0

    def test_measures_of_two_lines(self, spark):
        p, q = np.array([[0.0, 0], [10, 0]]), np.array([[0.0, 3], [10, 3]])
        assert G.frechet(p, q) == 3.0 and G.frechet(p, q[::-1]) == pytest.approx(math.hypot(10, 3))
        i, u = G.buffer_overlap(p, p + [0, 2], 5.0, 0.25)
        # two stadiums two apart: a shorter rectangle and a lens of the circles
        area = 100 + math.pi * 25
        inter = 80 + 50 * math.acos(0.2) - math.sqrt(96)
        assert i == pytest.approx(inter, rel=0.01) and u == pytest.approx(2 * area - inter, rel=0.01)
        assert G.simplified(np.array([[0.0, 0], [5, 0.1], [10, 0]]), 0.5).tolist() == [True, False, True]

    def test_hausdorff_with_jts(self, spark):
        jts = spark.sparkContext._jvm.org.locationtech.jts
        rnd = random.Random(1)
        pts = [[(rnd.random() * 10, rnd.random() * 10) for _ in range(6)] for _ in range(2)]
        wkt = lambda p: "MULTIPOINT (" + ", ".join(f"({x} {y})" for x, y in p) + ")"
        reader = jts.io.WKTReader()
        want = jts.algorithm.distance.DiscreteHausdorffDistance.distance(reader.read(wkt(pts[0])), reader.read(wkt(pts[1])))
        a, b = (G.line(*[(F.lit(x), F.lit(y)) for x, y in p]) for p in pts)
        assert one(spark, G.vertex_hausdorff(a, b)) == pytest.approx(want)


class TestRelational:
    def test_mode_and_best(self, spark, rows):
        df = spark.createDataFrame([(1, "a", 2.0, 1), (1, "a", 1.0, 2), (1, "b", 1.0, 1), (2, "a", None, 1), (2, "b", 5.0, 1)], "k int, v string, x double, i int")
        assert rows(R.mode_or_mixed(df, ["k"], "v").select("k", "v")) == [(1, "a"), (2, "Mixed")]
        assert rows(R.best_row(df, ["k"], F.col("x"), ["i"]).select("k", "v", "i")) == [(1, "b", 1), (2, "b", 1)]
        assert R.best_row(df.where("false"), ["k"], F.col("x"), ["i"]).count() == 0

    def test_folds_and_draws(self, spark):
        df = spark.range(1003).withColumnRenamed("id", "k")
        sizes = [r["count"] for r in R.equal_folds(df, "k", 5, F.xxhash64("k")).groupBy("fold").count().collect()]
        assert sorted(sizes) == [200, 200, 201, 201, 201]
        draws = R.bootstrap(df, ["k"], 20).groupBy("replicate").agg(F.sum("draws").alias("n")).collect()
        assert all(850 < r["n"] < 1160 for r in draws)
        assert R.bootstrap(df, ["k"], 20).exceptAll(R.bootstrap(df.repartition(7), ["k"], 20)).count() == 0
        one_ = R.one_per_group(df.withColumn("g", F.col("k") % 7), "g", "k")
        assert one_.count() == 7 and one_.exceptAll(R.one_per_group(df.repartition(3).withColumn("g", F.col("k") % 7), "g", "k")).count() == 0

    def test_registry_and_upsert(self, spark, rows):
        stored = spark.createDataFrame([(0, "a"), (1, "b")], "i bigint, s string")
        assert rows(R.register(stored, spark.createDataFrame([("b",), ("c",)], "s string"), "i").select("i", "s")) == [(0, "a"), (1, "b"), (2, "c")]
        assert rows(R.upsert(stored, spark.createDataFrame([(1, "z"), (2, "y")], "i bigint, s string"), ["i"])) == [(0, "a"), (1, "z"), (2, "y")]


class TestTraces:
    def test_knock_out(self, spark, rows):
        p = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 9.0), (1, 20.0, 1.0), (1, 30.0, 2.0), (2, 0.0, 1.0)], "l bigint, d double, e double")
        got = rows(T.knocked_out(p, "l", "d", "e", 30.0))
        assert got == [(1, 0.0, 0.0), (1, 10.0, None), (1, 20.0, None), (1, 30.0, 2.0), (2, 0.0, 1.0)]

    def test_as_of(self, spark, rows):
        r = spark.createDataFrame([(1, 5), (2, 1), (3, 9)], "id int, t int")
        k = spark.createDataFrame([(3, "a"), (5, "b"), (8, "c")], "t int, v string")
        assert rows(T.as_of(r, F.col("t"), k, "t", "v").select("id", "v")) == [(1, "b"), (2, None), (3, "c")]
        assert rows(T.as_of_small(r, F.col("t"), k, "t").select("id", "found")) == [(1, 5), (2, None), (3, 8)]
        assert rows(T.as_of_small(r, F.col("t"), k, "t", most=1).select("id", "found")) == [(1, 5), (2, None), (3, 8)]

    def test_runs_and_trim(self, spark, rows):
        t = spark.createDataFrame([(1, i, float(x), 0.0, v) for i, (x, v) in enumerate([(0, "a"), (300, "a"), (600, None), (900, None), (1200, "b"), (700, "b"), (200, "b")])], "k int, i int, x double, y double, v string")
        assert [r[1] for r in rows(T.last_of_runs(t, ["k"], ["i"], "v"))] == [1, 3, 6]
        assert [r[1] for r in rows(T.privacy_trim(t, "k", "i", "x", "y", 500.0))] == [2, 3, 4]
        assert T.privacy_trim(t, "k", "i", "x", "y", 700.0).count() == 0


LINKS = "linkid bigint, A bigint, B bigint, ax double, ay double, bx double, by double, length_ft double, oneway boolean, link_type string"


def graph(spark, edges, oneway=False):
    at = lambda n: (float(n % 5), float(n // 5))
    return spark.createDataFrame([(i, a, b, *at(a), *at(b), float(w), oneway, "road") for i, (a, b, w) in enumerate(edges)], LINKS)


class TestNetwork:
    def test_components_against_union_find(self, spark):
        rnd = random.Random(3)
        edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
        parent = {n: n for e in edges for n in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame([*edges, (None, 5)], "a bigint, b bigint")
        assert {(r[0], r[1]) for r in N.components(df, "a", "b").collect()} == {(n, find(n)) for n in parent}
        assert N.components(df.where("false"), "a", "b").count() == 0

    def test_turns_and_directions(self, spark):
        links = graph(spark, [(0, 1, 1), (1, 2, 1), (1, 6, 1), (1, 0, 2)])
        e = N.directed(links)
        assert e.count() == 2 * links.count() and N.directed(links.withColumn("oneway", F.lit(True)), honour_oneway=True).count() == links.count()
        t = N.turns(e)
        assert t.where("source_linkid = target_linkid").count() == 0
        kinds = {r["target_linkid"]: r["turn_type"] for r in t.where("source_linkid = 0 and not source_reverse_link").collect()}
        assert kinds == {1: "straight", 2: "left", 3: "uturn"}
        assert N.without_wrong_way(t, links.withColumn("oneway", F.lit(True))).where("source_reverse_link or target_reverse_link").count() == 0

    def test_chains(self, spark):
        links = graph(spark, [(0, 1, 1), (1, 2, 2), (2, 3, 4), (3, 4, 1), (3, 8, 1)])
        got = {tuple(r["links"]): (r["length_ft"], r["ends"]) for r in N.chains_merged(links).collect()}
        assert got == {(0, 1, 2): (7.0, [0, 3]), (3,): (1.0, [3, 4]), (4,): (1.0, [3, 8])}

    def test_halves(self, spark):
        links = graph(spark, [(i, i + 1, 10) for i in range(100)])
        h = N.halves(links, 1000, 5000)
        assert h.count() == 200 and h.select("linkid").distinct().count() == 200 and h.agg(F.sum("length_ft")).first()[0] == 1000.0
        assert h.select("B").where("B >= 1000").distinct().count() == 100


class TestSpatial:
    def test_nearest_against_brute_force(self, spark):
        rnd = random.Random(4)
        pts = [(i, rnd.random() * 100, rnd.random() * 100) for i in range(150)] + [(999, 5000.0, -3000.0), (1000, None, 1.0)]
        tgt = [(i, rnd.random() ** 4 * 100, rnd.random() ** 4 * 100) for i in range(60)] + [(77, 50.0, 50.0), (76, 50.0, 50.0)]
        p, t = spark.createDataFrame(pts, "id bigint, x double, y double"), spark.createDataFrame(tgt, "t bigint, qx double, qy double")
        got = {r["id"]: r["t"] for r in X.nearest(p, "id", t, "t").collect()}
        want = {i: None if x is None else min((math.hypot(x - a, y - b), k) for k, a, b in tgt)[1] for i, x, y in pts}
        assert got == want
        assert {r["t"] for r in X.nearest(p, "id", t.where("false"), "t").collect()} == {None}

    def test_distance_join_and_segments(self, spark):
        rnd = random.Random(5)
        a = [(i, rnd.random() * 50, rnd.random() * 50) for i in range(80)]
        b = [(i, rnd.random() * 50, rnd.random() * 50) for i in range(80)]
        got = X.distance_join(spark.createDataFrame(a, "i bigint, x double, y double"), spark.createDataFrame(b, "j bigint, qx double, qy double"), 6.0)
        assert {(r["i"], r["j"]) for r in got.collect()} == {(i, j) for (i, x, y), (j, u, v) in itertools.product(a, b) if math.hypot(x - u, y - v) <= 6}
        seg = spark.createDataFrame([(0, 0.0, 0.0, 50.0, 50.0), (1, 10.0, 10.0, 10.0, 10.0)], "s bigint, ax double, ay double, bx double, by double")
        near = {(r["i"], r["s"]) for r in X.near_segments(spark.createDataFrame(a, "i bigint, x double, y double"), seg, 5.0, 4.0).collect()}
        assert near == {(i, 0) for i, x, y in a if abs(x - y) / math.sqrt(2) <= 5} | {(i, 1) for i, x, y in a if math.hypot(x - 10, y - 10) <= 5}

    def test_covered_share(self, spark):
        base = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "k bigint, ax double, ay double, bx double, by double")
        other = spark.createDataFrame([(2, 0.0, 5.0, 50.0, 5.0), (3, 50.0, -50.0, 50.0, 50.0)], "o bigint, ax double, ay double, bx double, by double")
        got = {r["o"]: (r["share"], r["angle"]) for r in X.covered_share(base, "k", other, "o", 10.0, 1.0).collect()}
        assert got[2][0] == pytest.approx(0.58, abs=0.02) and got[2][1] == 0.0 and got[3][1] == 90.0


def dijkstra(links, turn):
    """Least cost and path of directed links between all nodes, by brute force over the turn graph."""
    edges = {(i, r): ((b, a) if r else (a, b), w) for i, (a, b, w) in enumerate(links) for r in (False, True)}
    out = {}
    for o in {n for a, b, _ in links for n in (a, b)}:
        dist = {}
        heap = [(w, s) for s, ((a, _), w) in edges.items() if a == o]
        heapq.heapify(heap)
        while heap:
            d, s = heapq.heappop(heap)
            if s in dist:
                continue
            dist[s] = d
            for t, ((a, _), w) in edges.items():
                if a == edges[s][0][1] and t[0] != s[0]:
                    heapq.heappush(heap, (d + w + turn, t))
        for s, d in dist.items():
            b = edges[s][0][1]
            if b != o:
                out[o, b] = min(out.get((o, b), math.inf), d)
    return out


class TestRouting:
    def setup_graph(self, spark, links, turn=0.25):
        e = N.directed(graph(spark, links)).withColumn("cost", F.col("length_ft"))
        t = I.priced_turns(N.turns(e), e, F.col("cost"), F.lit(turn))
        nodes = sorted({n for a, b, _ in links for n in (a, b)})
        ods = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "origin bigint, dest bigint")
        return e, t, ods

    @pytest.mark.parametrize("small", [0, 10_000])
    def test_against_dijkstra(self, spark, small):
        rnd = random.Random(6)
        links = [(rnd.randrange(9), rnd.randrange(9), rnd.randrange(1, 9)) for _ in range(14)] + [(20, 21, 3)]
        links = [x for x in links if x[0] != x[1]]
        e, t, ods = self.setup_graph(spark, links)
        got = P.routes(P.starts_of(e, ods), t, e, ods, small=small).collect()
        want = dijkstra(links, 0.25)
        assert {(r["origin"], r["dest"]): pytest.approx(r["d"]) for r in got if r["origin"] != r["dest"]} == want
        for r in got:
            path = r["edges"]
            ends = [(links[x["linkid"]][:2][::-1] if x["reverse_link"] else links[x["linkid"]][:2]) for x in path]
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
            if path:
                assert ends[0][0] == r["origin"] and ends[-1][1] == r["dest"]
                assert sum(links[x["linkid"]][2] for x in path) + 0.25 * (len(path) - 1) == pytest.approx(r["d"])

    def test_cutoff_and_variants(self, spark):
        links = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 10)]
        e, t, ods = self.setup_graph(spark, links, 0.0)
        for search in (P.search, P.relax):
            d = {(r["linkid"], r["reverse_link"]): r["d"] for r in search(P.starts_of(e, ods.where("origin = 0")), t, 2.0).collect()}
            assert d == {(0, False): 1.0, (1, False): 2.0}
        starts, turns = P.starts_of(e, ods.where("origin = 0")), t
        cheap = lambda df, c: df.withColumn(c, F.col(c) / 10)
        both = starts.withColumn("candidate", F.lit(0)).unionByName(cheap(starts, "d").withColumn("candidate", F.lit(1)))
        tb = turns.withColumn("candidate", F.lit(0)).unionByName(turns.withColumn("candidate", F.lit(1)))
        got = {(r["candidate"], r["dest"]): r["d"] for r in P.routes(both, tb, e, ods).collect()}
        assert got[0, 3] == 3.0 and got[1, 3] == pytest.approx(1.0)

    def test_negative_costs_are_refused(self, spark):
        e, t, ods = self.setup_graph(spark, [(0, 1, 1), (1, 2, 1)], -5.0)
        with pytest.raises(Exception, match="negative"):
            t.collect()


class TestImpedance:
    def test_terms(self, spark):
        df = spark.createDataFrame([(2.0, 1, 3, True), (2.0, 1, 3, False)], "b double, x int, y int, base boolean")
        terms = [I.Term("x", "link", 0.5), I.Term("y", "link", 0.1, bypass_base=True), I.Term("x", "turn", 9.0)]
        assert [r[0] for r in df.select(I.link_cost(terms, F.col("b"), F.col("base"))).collect()] == [3.0, pytest.approx(3.6)]
        assert [r[0] for r in df.select(I.link_cost([], F.col("b"))).collect()] == [2.0, 2.0]
        assert one(spark, I.lowry_cost(F.lit(2.0), F.lit(0.5), F.lit(1.0), F.lit(0.25))) == 4.5

    def test_year_networks(self, spark, rows):
        links = spark.createDataFrame([(1, 2010, 1, 1), (2, 2015, 1, 0), (3, None, 1, 1)], "linkid int, year int, lane int, path int")
        years = spark.createDataFrame([(2012,), (2016,)], "network_year int")
        got = rows(I.year_networks(links, years, "year", ["lane"], ["path"]).select("network_year", "linkid", "lane", "blocked"))
        assert got == [(2012, 1, 1, False), (2012, 2, 0, False), (2012, 3, 1, False), (2016, 1, 1, False), (2016, 2, 1, False), (2016, 3, 1, False)]


class TestMetrics:
    def test_jaccard_bounds(self, spark):
        a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 2, 3.0), (2, 1, 1.0)], "k int, e int, l double")
        b = spark.createDataFrame([(1, 2, 3.0), (1, 3, 5.0), (3, 1, 1.0)], "k int, e int, l double")
        j = {r["k"]: r["jaccard"] for r in M.jaccard(a, b, "k", ["e"], "l").collect()}
        k = {r["k"]: r["jaccard"] for r in M.jaccard(b, a, "k", ["e"], "l").collect()}
        assert j == k == {1: pytest.approx(0.3), 2: 0.0, 3: 0.0}

    def test_shares(self, spark):
        r = spark.createDataFrame([(1, 2.0, "a", True), (1, 6.0, "b", False), (2, 1.0, None, None)], "k int, l double, c string, road boolean")
        got = {x["k"]: (x["a"], x["onroad"]) for x in M.attribute_shares(r, "k", "l", {"a": F.col("c") == "a", "onroad": F.col("c") == "a"}, {"onroad": F.col("road")}).collect()}
        assert got == {1: (0.25, 1.0), 2: (0.0, 0.0)}


class TestMatchingAndTransit:
    def test_trace_on_a_grid(self, spark):
        links = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 7, 1), (1, 6, 1), (6, 7, 1)]).withColumns({c: F.col(c) * 100 for c in ("ax", "ay", "bx", "by")})
        rnd = random.Random(7)
        way = [(x, 0.0) for x in range(0, 200, 20)] + [(200.0, y) for y in range(0, 100, 20)]
        pts = spark.createDataFrame([(1, i, x + rnd.gauss(0, 5), y + rnd.gauss(0, 5)) for i, (x, y) in enumerate(way)] + [(2, 0, 9000.0, 9000.0)], "tripid bigint, sequence int, x double, y double")
        m = H.match_traces(pts, N.directed(links), H.MatchRules(radius=60, noise=8, way=20))
        s = H.match_summary(m).collect()
        assert len(s) == 1 and s[0]["match_ratio"] == 1.0 and [(e["linkid"], e["reverse_link"]) for e in s[0]["edges"]] == [(0, False), (1, False), (2, False)]
        t = {r["status"]: r["n"] for r in H.triage(H.match_summary(m), pts).collect()}
        assert t == {"matched": 1, "failed": 1}

    def test_swarm_finds_a_minimum(self):
        terms = [I.Term("a", "link", range=(-2.0, 2.0)), I.Term("b", "link", range=(-2.0, 2.0))]
        f = lambda pop: [None if t[0].beta < -1.5 else (t[0].beta - 0.5) ** 2 + (t[1].beta + 1) ** 2 for t in pop]
        betas, loss, trace = C.fit(terms, f, C.Swarm(size=20, rounds=60, seed=3))
        assert loss < 1e-3 and betas == pytest.approx([0.5, -1.0], abs=0.05)
        assert all(a[1] >= b[1] for a, b in zip(trace, trace[1:]))
        assert C.fit(terms, f, C.Swarm(size=5, rounds=5, seed=3)) == C.fit(terms, f, C.Swarm(size=5, rounds=5, seed=3))

    def test_arrivals(self, spark):
        times = spark.createDataFrame([(1, 1, 10, 100), (1, 2, 20, 200), (1, 3, 30, 300), (2, 1, 21, 260), (2, 2, 40, 400), (3, 1, 20, 150), (3, 2, 50, 180)], "trip_id bigint, stop_sequence int, stop_id bigint, departure_sec bigint")
        walks = spark.createDataFrame([(20, 21, 50.0), (21, 20, 50.0)], "from_stop bigint, to_stop bigint, seconds double")
        src = spark.createDataFrame([(10, 10, 90)], "source bigint, stop_id bigint, at bigint")
        got = {(r["stop_id"], r["rides"]): r["arrival"] for r in Z.earliest_arrivals(src, times, walks, 2).collect()}
        assert got == {(10, 0): 90.0, (20, 1): 200.0, (30, 1): 300.0, (21, 1): 250.0, (40, 2): 400.0}
        assert {r["stop_id"] for r in Z.itineraries(Z.earliest_arrivals(src, times, walks, 1)).collect()} == {10, 20, 21, 30}

    def test_transfers_close(self, spark):
        s = spark.createDataFrame([(i, float(i * 10), 0.0) for i in range(4)] + [(9, 500.0, 0.0)], "stop_id bigint, x double, y double")
        got = {(r[0], r[1]) for r in Z.transfers(s, 11.0, 1.0).select("from_stop", "to_stop").collect()}
        assert got == {(i, j) for i in range(4) for j in range(4) if i != j}
