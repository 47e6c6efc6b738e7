"""Many trips are decoded side by side, and segments come only into cells that something near them can lie in."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.operators import map_matching as H
from pathloom.operators import spatial as X


def candidates(trips, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for trip in range(trips):
        for s in range(int(rng.integers(1, 6))):
            x, y = rng.uniform(0, 300, 2)
            near = sorted({(float(rng.uniform(0, 90)), int(rng.integers(0, 6)), bool(rng.integers(0, 2))) for _ in range(int(rng.integers(1, 4)))})
            rows += [(trip, s * 3, x, y, link, back, d, int(rng.integers(0, 4)), int(rng.integers(0, 4)), x + rng.uniform(-60, 60), y + rng.uniform(-60, 60), float(rng.uniform(0, 200)), 7) for d, link, back in near]
    return pd.DataFrame(rows, columns="tripid sequence x y linkid reverse_link distance A B px py along points".split())


def likelihood(way, r):
    total = 0.0
    for k, t in enumerate(way):
        total -= 0.5 * (t.distance / r.noise) ** 2
        if k:
            s = way[k - 1]
            same = s.linkid == t.linkid and s.reverse_link == t.reverse_link
            kept = 0.0 if same and t.along >= s.along - r.noise else 0.5 if not same and s.B == t.A and s.linkid != t.linkid else r.unlinked
            total -= abs(np.hypot(s.px - t.px, s.py - t.py) - np.hypot(s.x - t.x, s.y - t.y)) / r.way + kept
    return total


@pytest.mark.parametrize("pairs", [1, 20, 400_000])
def test_most_likely_of_all_ways(monkeypatch, pairs):
    monkeypatch.setattr(H, "PAIRS", pairs, raising=False)
    r, t = H.MatchRules(), candidates(40)
    got = pd.concat(H._viterbi(r)(iter([t.iloc[:25], t.iloc[25:]])))
    assert len(got) == len(t.groupby(["tripid", "sequence"]))
    for trip, rows in t.groupby("tripid"):
        points = [list(g.itertuples()) for _, g in rows.groupby("sequence")]
        best = max(itertools.product(*points), key=lambda w: likelihood(w, r))
        own = got[got["tripid"] == trip]
        assert [(w.sequence, w.linkid, w.reverse_link, w.distance) for w in best] == list(own[["sequence", "linkid", "reverse_link", "distance"]].itertuples(index=False, name=None))
        assert set(own["last_matched"]) == {len(points) - 1} and set(own["points"]) == {7}


def test_steps_are_shared_by_trips(monkeypatch):
    """The work of Python follows the longest trip, not the number of trips' points."""
    calls, hypot = [0], np.hypot

    def counted(*args):
        calls[0] += 1
        return hypot(*args)

    t = candidates(400)
    monkeypatch.setattr(np, "hypot", counted)
    list(H._viterbi(H.MatchRules())(iter([t])))
    assert calls[0] < 20


def test_cells_of_segments(spark):
    """A segment comes into the cells within the margin and half a cell, and everything near is found."""
    rng = np.random.default_rng(5)
    seg = [(i, *map(float, rng.uniform(-900, 900, 4))) for i in range(30)]
    s = spark.createDataFrame(seg, "s bigint, ax double, ay double, bx double, by double")
    pts = [(i, *map(float, rng.uniform(-1000, 1000, 2))) for i in range(400)]
    got = {(r["i"], r["s"]) for r in X.near_segments(spark.createDataFrame(pts, "i bigint, x double, y double"), s, 50.0, 100.0).collect()}
    want = set()
    for i, x, y in pts:
        for k, ax, ay, bx, by in seg:
            f = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            if np.hypot(x - ax - f * (bx - ax), y - ay - f * (by - ay)) <= 50:
                want.add((i, k))
    assert got == want
    assert X.segment_cells(spark.createDataFrame([(0, 50.0, 50.0, 50.0, 50.0)], "s bigint, ax double, ay double, bx double, by double"), 100.0, 50.0).count() == 9


def test_links_of_a_long_trip(spark):
    """The list of a trip's links is made once, not for each of its points."""
    n = 30_000
    m = spark.range(0, n, 1, 1).selectExpr("5L as tripid", "cast(id as int) as sequence", "id div 3 as linkid", "id % 2 = 0 and id < 2 as reverse_link", "1.0D as distance", f"{n - 1} as last_matched", f"{n}L as points")
    began = time.monotonic()
    (r,) = H.match_summary(m).where(F.size("edges") >= 2).collect()  # as match_again asks, what makes the list goes into the filter
    assert time.monotonic() - began < 15
    assert r["match_ratio"] == 1.0
    assert [tuple(e) for e in r["edges"]] == [(0, True), (0, False), *((k, False) for k in range(1, n // 3))]
