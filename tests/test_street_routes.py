"""Routes of the street network."""

import pytest

import __spark_entry__ as entry
from pathloom.operators import sweeps as W

DATA = "/root/testdata/sf0.001"


def test_costs_alone_walk_nothing_back(spark, monkeypatch):
    """Costs need no routes; they are those of the routes."""
    seen = []
    routed = entry.importlib.import_module("pathloom.operators.routing")._routed
    monkeypatch.setattr("pathloom.operators.routing._routed", lambda *a, ways=True, **k: seen.append(ways) or routed(*a, ways=ways, **k))
    costs = {(r["origin"], r["dest"]): r["cost"] for r in entry.queries()["od_route_costs"](spark, DATA).collect()}
    routes = {(r["origin"], r["dest"]): r["cost"] for r in entry.queries()["od_routes"](spark, DATA).collect()}
    assert seen == [False, True] and costs.keys() == routes.keys() and costs
    assert all(costs[k] == pytest.approx(routes[k], abs=1e-5) for k in costs)


def test_routes_in_steps_of_arrays(spark, monkeypatch):
    """No search by heap per origin: routes of many origins are walked back together."""
    calls = []
    monkeypatch.setattr(W, "share", lambda s, a, f=W.share: calls.append(set(a)) or f(s, a))
    rows = entry.queries()["od_routes"](spark, DATA).collect()
    assert rows and calls and {"src", "dst", "start_state", "end_state"} <= calls[0]


def test_years_share_a_graph_and_walk_nothing_back(spark, monkeypatch):
    seen = []
    routed = entry.importlib.import_module("pathloom.operators.routing")._routed
    monkeypatch.setattr("pathloom.operators.routing._routed", lambda *a, ways=True, **k: seen.append(ways) or routed(*a, ways=ways, **k))
    assert entry.queries()["od_costs_by_year"](spark, DATA).count() > 0
    assert seen == [False]


def test_sets_of_coefficients_in_one_plan(spark):
    """All sets priced in one plan cost what each costs alone, and the plan doesn't grow with them."""
    from pathloom.operators import impedance as I
    from pathloom.plans import journeys as J

    sets = [J.STREETS, [I.Term(t.col, t.type, t.beta / 3) for t in J.STREETS]]
    both = {(r["candidate"], r["origin"], r["dest"]): (r["d"], r["edges"]) for r in J.street_routes(spark, DATA, sets).collect()}
    alone = {(i, r["origin"], r["dest"]): (r["d"], r["edges"]) for i, x in enumerate(sets) for r in J.street_routes(spark, DATA, [x]).collect()}
    assert both == alone and both


def test_many_origins_share_a_step():
    """On a street network of 162,000 states two dozen origins are searched together."""
    assert [p.stop - p.start for p in W.groups(50, 162_000, True)] == [24, 24, 2]


def test_years_searched_together_cost_what_each_origin_costs(monkeypatch):
    """Two years' costs, one with closed links, as a search of each origin by heap has them, however many are searched at once."""
    import heapq
    import random

    import numpy as np

    rnd = random.Random(6)
    n = 60
    turns = [(c, rnd.randrange(n), rnd.randrange(n), 9e9 if c and rnd.random() < 0.2 else rnd.choice([0.0, 0.5, rnd.random()])) for c in (0, 1) for _ in range(150)]
    turns.sort()
    starts = sorted((c, i, rnd.randrange(n), rnd.random()) for c in (0, 1) for i in range(12) for _ in range(2))
    a = {k: np.array([x[i] for x in rows], t) for rows, cols in ((turns, (("candidate", "i4"), ("src", "i4"), ("dst", "i4"), ("cost", "f8"))), (starts, (("start_candidate", "i4"), ("start_node", "i8"), ("start_state", "i4"), ("start_cost", "f8")))) for i, (k, t) in enumerate(cols)}
    a |= {"code": np.arange(n) * 2, "end_node": np.arange(n), "end_state": np.arange(n, dtype="i4")}
    for c in (0, 1):
        want = np.full((12, n), np.inf)
        for i in range(12):
            heap = sorted((d, s) for x, o, s, d in starts if x == c and o == i)
            while heap:
                d, s = heapq.heappop(heap)
                if d >= want[i, s]:
                    continue
                want[i, s] = d
                for x, f, t, w in turns:
                    if x == c and f == s:
                        heapq.heappush(heap, (d + w, t))
        for at_once in (1, 5 * n, 12 * n):
            monkeypatch.setattr(W, "AT_ONCE_TURNS", at_once)
            got = np.vstack([W.least(W.TurnGraph(a, c), np.arange(12)[p]) for p in W.groups(12, n, True)])
            assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
