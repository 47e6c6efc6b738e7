"""Conflation operators and tag rules on hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions import tags as G
from pathloom.operators import conflation as K
from pathloom.operators import impedance as I
from pathloom.operators import network as N

LINKS = "linkid bigint, A bigint, B bigint, ax double, ay double, bx double, by double, length_ft double, link_type string"


def tagged(spark, column, **tags):
    pairs = [F.lit(x) for kv in tags.items() for x in (kv[0].replace("__", ":"), kv[1])]
    m = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return spark.range(1).select(m.alias("t")).select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "tags,kind",
    [
        ({"footway": "sidewalk", "highway": "footway"}, "sidewalk"), ({"highway": "steps"}, "pedestrian"), ({"highway": "path", "bicycle": "yes"}, "bike"), ({"highway": "cycleway"}, "bike"),
        ({"highway": "service", "service": "driveway"}, "parking_and_driveways"), ({"highway": "service"}, "service"), ({"highway": "service", "name": "x"}, "road"), ({"highway": "motorway"}, "restricted_access_road"),
        ({"highway": "residential", "bicycle": "no"}, "no_bike"), ({"highway": "construction"}, "road"), ({"highway": "proposed", "bicycle": "no"}, "no_access_or_private"), ({}, None),
    ],
)
def test_link_types(spark, tags, kind):
    assert tagged(spark, G.link_type, **tags) == kind


@pytest.mark.parametrize(
    "tags,kind,forward,back",
    [
        ({"highway": "residential"}, "road", "no facility", "no facility"), ({"highway": "cycleway"}, "bike", "cycletrack", "cycletrack"), ({"highway": "cycleway", "oneway": "yes"}, "bike", "cycletrack", "multi use path"),
        ({"highway": "cycleway", "foot": "yes"}, "bike", "multi use path", "multi use path"), ({"highway": "primary", "cycleway": "shared_lane"}, "road", "sharrow", "sharrow"),
        ({"highway": "primary", "cycleway__right": "lane"}, "road", "bike lane", "no facility"), ({"highway": "primary", "cycleway__left": "lane", "cycleway__left__buffer": "yes"}, "road", "no facility", "buffered bike lane"),
        ({"highway": "primary", "cycleway": "lane"}, "road", "bike lane", "bike lane"), ({"highway": "primary", "cycleway": "lane", "access": "private"}, "road", "no facility", "no facility"),
    ],
)
def test_facilities(spark, tags, kind, forward, back):
    assert [tagged(spark, lambda t, f=f: G.facility(t, F.lit(kind), f), **tags) for f in (True, False)] == [forward, back]


def test_attributes(spark):
    assert tagged(spark, G.rideable, highway="path") is False and tagged(spark, G.rideable, highway="path", bicycle="yes") is True and tagged(spark, G.rideable, highway="cycleway", surface="dirt") is False
    r = spark.sql("select '35 mph' as a, 'none' as b, '2' as c").select(G.speed_of(F.col("a")), G.speed_of(F.col("b")), G.number_of(F.col("c")), G.recoded(F.col("c"), {"1": "x"})).first()
    assert tuple(r) == (35.0, None, 2, None)


def test_one_to_one(spark):
    rnd = random.Random(1)
    base = [(i, rnd.random() * 20, rnd.random() * 20) for i in range(40)]
    join = [(i, rnd.random() * 20, rnd.random() * 20) for i in range(30)]
    got = K.one_to_one(spark.createDataFrame(base, "id bigint, x double, y double"), spark.createDataFrame(join, "jid bigint, jx double, jy double"), 4.0).collect()
    want, left, right = [], {b[0] for b in base}, {j[0] for j in join}
    for d, i, j in sorted((math.hypot(x - u, y - v), i, j) for i, x, y in base for j, u, v in join):
        if d <= 4.0 and i in left and j in right:
            want.append((i, j))
            left.discard(i)
            right.discard(j)
    assert sorted((r["id"], r["jid"]) for r in got) == sorted(want)
    assert K.one_to_one(spark.createDataFrame([], "id bigint, x double, y double"), spark.createDataFrame(join, "jid bigint, jx double, jy double"), 4.0).count() == 0


def test_decide(spark):
    rows = [(1, "a", True, False, 5.0), (1, "b", False, True, 9.0), (2, "c", False, True, 5.0), (2, "d", False, False, 3.0), (3, "e", False, False, 90.0), (4, "f", None, None, 4.0), (4, "g", False, False, 4.0)]
    df = spark.createDataFrame(rows, "k int, o string, no boolean, yes boolean, d double")
    assert sorted(r["o"] for r in K.decide(df, "k", F.col("no"), F.col("yes"), "d", 50.0).where("match").collect()) == ["b", "d", "f"]


def test_split_and_ends(spark):
    links = spark.createDataFrame([(1, None, None, 0.0, 0.0, 100.0, 0.0, 100.0, "road"), (2, None, None, 0.0, 50.0, 0.0, 90.0, 40.0, "road")], LINKS)
    pts = spark.createDataFrame([(25.0, 0.5), (75.0, -0.5), (0.0, 0.0), (25.0, 0.5), (500.0, 500.0)], "x double, y double")
    got = {(r["linkid"], r["part"]): (r["ax"], r["bx"], r["length_ft"]) for r in K.split_at(links, pts, 1.0).collect()}
    assert got == {(1, 0): (0.0, 25.0, 25.0), (1, 1): (25.0, 75.0, 50.0), (1, 2): (75.0, 100.0, 25.0), (2, 0): (0.0, 0.0, 40.0)}
    nodes = spark.createDataFrame([(7, 1.0, 0.0), (8, 99.0, 1.0), (9, 0.0, 70.0)], "N bigint, x double, y double")
    ends = {r["linkid"]: (r["A"], r["B"]) for r in K.end_nodes(links, nodes).collect()}
    assert ends == {1: (7, 8), 2: (9, 9)}


def test_study_area(spark):
    ring = [(1, i, x * 5280.0, y * 5280.0) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 1), (0, 1)])]
    r = K.study_area(spark.createDataFrame(ring, "p int, i int, x double, y double"), "p", "i", "x", "y").first()
    assert r["square_miles"] == pytest.approx(2.0) and r["maxx"] == 2 * 5280.0


def test_names_at_signals(spark):
    signals = spark.createDataFrame([(1, 0.0, 0.0, ["peachtree", "tenth"])], "signal int, x double, y double, streets array<string>")
    nodes = spark.createDataFrame([(5, 3.0, 4.0), (6, 300.0, 4.0)], "N bigint, x double, y double")
    links = spark.createDataFrame([(1, 5, 9, "peachtre"), (2, 5, 8, "juniper"), (3, 6, 8, "tenth"), (4, 5, 6, None)], "linkid bigint, A bigint, B bigint, name string")
    assert [tuple(r) for r in K.signal_links(signals, nodes, links, 10.0).collect()] == [(1, 1)]


def test_side_paths_and_gaps(spark):
    roads = [(i, i, i + 1, i * 300.0, 0.0, (i + 1) * 300.0, 0.0, 300.0, "road") for i in range(2)] + [(9, 20, 21, 0.0, 900.0, 300.0, 900.0, 300.0, "road")]
    df = spark.createDataFrame(roads, LINKS)
    paths = spark.createDataFrame([(1, -10.0, 20.0, 700.0, 20.0), (2, 0.0, 905.0, 300.0, 905.0)], "path_id bigint, ax double, ay double, bx double, by double")
    assert sorted((r["linkid"], r["path_id"]) for r in K.side_path_roads(df, paths).collect()) == [(0, 1), (1, 1)]
    e = N.directed(df).withColumn("cost", F.col("length_ft"))
    t = I.priced_turns(N.turns(e), e, F.col("cost"), F.lit(0.0))
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "N bigint")
    assert [tuple(r) for r in K.gap_connectors(df, e, t, nodes(0, 20), nodes(2), 1000.0).collect()] == [(0, 2, 600.0)]
    assert K.gap_connectors(df, e, t, nodes(0), nodes(2), 500.0).count() == 0


def test_touching(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 100.0, 0.0), (2, 0, 0.0, 50.0), (2, 1, 10.0, 50.0), (3, 0, 50.0, 3.0)], "k int, i int, x double, y double")
    assert sorted(r[0] for r in K.touching(t, "k", "i", 50.0, 5.0, 6.0).collect()) == [1, 3]
