"""Queries on the network whose turns follow from its links: right results without a table of turns."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.operators import network as N
from pathloom.operators import routing as P

DATA = "/root/testdata/sf0.001"


def by_sql(name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("name", ["betweenness", "percent_detour", "bikeshed", "bounded_sssp", "bikeshed_change", "impedance_change_zone", "shortest_path_cost"])
def test_no_table_of_turns(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("turns grow with the square of a node's degree")

    monkeypatch.setattr(N, "turns", refuse)
    monkeypatch.setattr(P, "relax", refuse)
    rows = [tuple(r) for r in entry.queries()[name](spark, DATA).collect()]
    if name in entry.oracle_sql():
        assert sorted(rows) == sorted(by_sql(name))
    assert rows


def test_against_joins(spark):
    """Least costs with turns by class, circles of links without length, loops and a node of high degree, as relaxing a table of turns has them."""
    from pyspark.sql import functions as F

    from pathloom.functions import scalars as S
    from pathloom.operators import impedance as I

    rnd = random.Random(3)
    at = [(rnd.randrange(6), rnd.randrange(6)) for _ in range(12)]  # some nodes share a place
    ends = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(40)] + [(0, rnd.randrange(12)) for _ in range(20)]
    rows = [(i, a, b, *map(float, (*at[a], *at[b])), float(abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1]))) for i, (a, b) in enumerate(ends)]
    e = N.directed(spark.createDataFrame(rows, "linkid bigint, A bigint, B bigint, ax double, ay double, bx double, by double, length_ft double")).withColumn("cost", F.col("length_ft") / 7)
    e = e.withColumn("azimuth", S.planar_azimuth(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    turn = {"left": 0.1, "uturn": 0.3}
    t = N.turns(e.drop("azimuth"))
    t = I.priced_turns(t, e, F.col("cost"), F.when(F.col("turn_type") == "left", 0.1).when(F.col("turn_type") == "uturn", 0.3).otherwise(0.0))
    o = spark.createDataFrame([(i,) for i in range(12)], "origin bigint")
    want = {(r["origin"], r["linkid"], r["reverse_link"]): r["d"] for r in P.relax(P.starts_of(e, o), t).collect()}
    links = P.link_graph(e, {"now": ("cost", turn)})
    assert {(r["origin"], r["linkid"], r["reverse_link"]): r["d_now"] for r in P.link_reach(links, o, whole=True).collect()} == want
    price = {(r["source_linkid"], r["source_reverse_link"], r["target_linkid"], r["target_reverse_link"]): r["total_cost"] for r in t.collect()}
    own = {(r["linkid"], r["reverse_link"]): (r["A"], r["B"], r["cost"]) for r in e.collect()}
    for r in P.link_routes(links, o.crossJoin(o.withColumnRenamed("origin", "dest"))).collect():
        way = [tuple(x) for x in r["edges"]]
        if r["origin"] == r["dest"]:
            assert not way and r["d"] == 0
            continue
        assert own[way[0]][0] == r["origin"] and own[way[-1]][1] == r["dest"]
        assert own[way[0]][2] + sum(price[(*a, *b)] for a, b in zip(way, way[1:])) == pytest.approx(r["d"])
        assert r["d"] == min(d for (o_, *k), d in want.items() if o_ == r["origin"] and own[tuple(k)][1] == r["dest"])


def test_few_rounds_and_the_same_costs(spark):
    """States are gone on from together over a fifth of a link's mean cost: few rounds; costs don't depend on it."""
    import numpy as np

    from pathloom.operators import sweeps as W

    rnd = random.Random(9)
    rows = [(i, bool(r), *(ends if not r else ends[::-1]), rnd.uniform(0, 360), rnd.uniform(0.5, 10)) for i, ends in enumerate([(rnd.randrange(40), rnd.randrange(40)) for _ in range(160)]) for r in (0, 1)]
    e = spark.createDataFrame(rows, "linkid bigint, reverse_link boolean, A bigint, B bigint, azimuth double, cost double")
    links = P.link_graph(e, {"now": ("cost", {"left": 0.1, "uturn": 0.3})})
    g = links.make(links.graph.open(), 0)
    usual, found, rounds = g.step, [], []
    for step in (usual, usual / 4, usual * 50):
        g.step, calls, make = step, [], W.LinkGraph.expander.__get__(g)
        g.expander = lambda s, make=make, calls=calls: (lambda *x, f=make(s): calls.append(1) or f(*x))
        found.append(W.least(g, np.arange(40)))
        rounds.append(len(calls))
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()
    assert usual == pytest.approx(np.mean([r[-1] for r in rows]) / 5) and rounds[0] < rounds[1]
