"""Least-cost routes on turn graphs: frontier relaxation on DataFrames, or in memory, many origins at once, where the graph is small or its turns follow from the links."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pathloom.common import cut, written
from pathloom.operators import sweeps as W

#: Turns up to which the graph is given to every task (from a file, 16 bytes each); beyond, frontiers are relaxed by joins.
SMALL_GRAPH = 8_000_000


def starts_of(edges: DataFrame, origins: DataFrame, cost: str = "cost") -> DataFrame:
    """First states of routes: the directed links that leave each origin, at their own cost."""
    return origins.select(F.col("origin")).distinct().join(edges, F.col("origin") == F.col("A")).select("origin", "linkid", "reverse_link", F.col(cost).alias("d"))


def relax(starts: DataFrame, turns: DataFrame, cutoff: float | None = None, most_rounds: int = 10_000) -> DataFrame:
    """Least cost of every directed link reached from each origin: origin, linkid, reverse_link, d, and the link before it (p_linkid, p_reverse_link; null at the start).

    Rounds of joins: the states improved last are joined with the turns, the best candidate per state is kept (ties: the smallest link before), and those that
    improve a state are the next frontier. Each round's table is written to the shared folder in place of the last one's. With a cutoff no state beyond it is kept.
    Costs must not be negative (priced_turns sees to it).
    """
    state = ["origin", "linkid", "reverse_link"]
    first = starts.groupBy(*state).agg(F.min("d").alias("d")).withColumn("p_linkid", F.lit(None).cast("bigint")).withColumn("p_reverse_link", F.lit(None).cast("boolean"))
    if cutoff is not None:
        first = first.where(F.col("d") <= cutoff)
    best = written(first.withColumn("fresh", F.lit(True)))
    t = turns.select(
        F.col("source_linkid").alias("linkid"), F.col("source_reverse_link").alias("reverse_link"), F.col("target_linkid").alias("t_linkid"), F.col("target_reverse_link").alias("t_reverse_link"), F.col("total_cost"),
    )
    for _ in range(most_rounds):
        step = best.where("fresh").join(t, ["linkid", "reverse_link"])
        step = step.select("origin", F.col("t_linkid").alias("linkid"), F.col("t_reverse_link").alias("reverse_link"), (F.col("d") + F.col("total_cost")).alias("d"), F.col("linkid").alias("p_linkid"), F.col("reverse_link").alias("p_reverse_link"))
        if cutoff is not None:
            step = step.where(F.col("d") <= cutoff)
        # old states and candidates meet in one aggregation; a candidate wins only if it is better
        both = best.select(*state, "d", "p_linkid", "p_reverse_link", F.lit(0).alias("new")).unionByName(step.withColumn("new", F.lit(1)))
        best = written(
            both.groupBy(*state).agg(F.min(F.struct("d", "new", "p_linkid", "p_reverse_link")).alias("b"))
            .select(*state, F.col("b.d").alias("d"), F.col("b.p_linkid").alias("p_linkid"), F.col("b.p_reverse_link").alias("p_reverse_link"), (F.col("b.new") == 1).alias("fresh")), best,
        )
        if best.where("fresh").isEmpty():
            break
    else:
        raise RuntimeError(f"routes still improved after {most_rounds} rounds")
    return best.drop("fresh")


def _with_candidate(df: DataFrame) -> DataFrame:
    return df if "candidate" in df.columns else df.withColumn("candidate", F.lit(0))


def _code(linkid: str, back: str) -> Column:
    return F.col(linkid).cast("bigint") * 2 + F.col(back).cast("bigint")


def _gathered(df: DataFrame, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    parts = list(W.columns(df, kinds))
    return {c: np.concatenate([x[c] for x in parts]) if parts else np.zeros(0, k) for c, k in kinds.items()}


def _turn_graph(starts: DataFrame, turns: DataFrame, edges: DataFrame | None, small: int) -> W.Shared | None:
    """The graph of turns for every task, or None if it has more than `small` turns."""
    t = turns.select(F.col("candidate").cast("int"), _code("source_linkid", "source_reverse_link").alias("s"), _code("target_linkid", "target_reverse_link").alias("t"), F.col("total_cost").cast("double"))
    if t.limit(small + 1).count() > small:
        return None
    t = _gathered(t, {"candidate": "i4", "s": "i8", "t": "i8", "total_cost": "f8"})
    first = starts.select(F.col("candidate").cast("int"), F.col("origin").cast("bigint"), _code("linkid", "reverse_link").alias("s"), F.col("d").cast("double")).where("origin is not null and d is not null")
    first = _gathered(first, {"candidate": "i4", "origin": "i8", "s": "i8", "d": "f8"})
    last = {"B": np.zeros(0, "i8"), "s": np.zeros(0, "i8")}
    if edges is not None:
        last = _gathered(edges.select(F.col("B").cast("bigint").alias("B"), _code("linkid", "reverse_link").alias("s")).where("B is not null"), {"B": "i8", "s": "i8"})
    code = np.unique(np.concatenate([np.unique(x) for x in (t["s"], t["t"], first["s"])]))
    place = lambda x: np.searchsorted(code, x).astype(np.int32)
    src = place(t.pop("s"))
    by = np.lexsort((src, t["candidate"]))
    out = {"code": code, "candidate": t["candidate"][by], "src": src[by], "dst": place(t.pop("t"))[by], "cost": t["total_cost"][by]}
    by = np.lexsort((first["origin"], first["candidate"]))
    out |= {"start_candidate": first["candidate"][by], "start_node": first["origin"][by], "start_state": place(first["s"])[by], "start_cost": first["d"][by]}
    known = np.flatnonzero(np.isin(last["s"], code))
    known = known[np.argsort(last["B"][known], kind="stable")]
    out |= {"end_node": last["B"][known], "end_state": place(last["s"][known])}
    return W.share(turns.sparkSession, out)


def _reached(graph, nodes: np.ndarray, cutoff: float | None) -> Iterator[pd.DataFrame]:
    """Reached states of each node and the ones before them (-1: none), a part of the nodes at a time."""
    nodes = np.unique(nodes)
    for part in W.groups(len(nodes), graph.n):
        some = nodes[part]
        dist = W.least(graph, some, cutoff)
        started = _started(graph, some)
        for r in range(len(some)):
            reached = np.flatnonzero(np.isfinite(dist[r]))
            for k in np.array_split(reached, -(-len(reached) // 200_000)):
                if not len(k):
                    continue
                of, i, w = graph.before(k)
                fits = np.flatnonzero((np.abs(dist[r][i] + w - dist[r][k][of]) < W.SAME) & (dist[r][k] < started[r][k] - W.SAME)[of])
                fits = fits[np.lexsort((graph.code[i[fits]], dist[r][i[fits]] >= dist[r][k][of[fits]], of[fits]))]
                head = fits[np.r_[True, of[fits][1:] != of[fits][:-1]]] if len(fits) else fits
                before = np.full(len(k), -1, np.int64)
                before[of[head]] = i[head]
                yield pd.DataFrame({"origin": some[r], "k": k, "d": dist[r][k], "before": before})


def _started(graph, nodes: np.ndarray) -> np.ndarray:
    out = np.full((len(nodes), graph.n), np.inf)
    row, k, d = graph.starts(nodes)
    np.minimum.at(out, (row, k), d)
    return out


def search(starts: DataFrame, turns: DataFrame, cutoff: float | None = None, small: int = SMALL_GRAPH) -> DataFrame:
    """The same as relax, in memory where the graph has at most `small` turns: it is then given to every task, origins (whole numbers) are spread over them."""
    turns = _with_candidate(turns)
    graph = _turn_graph(_with_candidate(starts), turns, None, small)
    if graph is None:
        return relax(starts, turns, cutoff)
    kind = starts.schema["origin"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = np.concatenate([b["origin"].to_numpy(np.int64) for b in batches] or [np.zeros(0, np.int64)])
        if not len(nodes):
            return
        g = W.TurnGraph(graph.open(), 0)
        for x in _reached(g, nodes, cutoff):
            k, p = x["k"].to_numpy(), x["before"].to_numpy()
            code, before, none = g.code[k], g.code[p], p < 0
            yield pd.DataFrame({
                "origin": x["origin"], "linkid": code >> 1, "reverse_link": (code & 1).astype(bool), "d": x["d"],
                "p_linkid": pd.Series(before >> 1).astype("Int64").mask(none), "p_reverse_link": pd.Series((before & 1).astype(bool)).astype("boolean").mask(none),
            })

    origins = starts.select("origin").where("origin is not null").distinct()
    return origins.repartition(W.tasks(starts.sparkSession, 1_000_000, 1), "origin").mapInPandas(run, f"origin {kind}, linkid bigint, reverse_link boolean, d double, p_linkid bigint, p_reverse_link boolean")


def _routed(graph: W.Shared, make: Callable, pairs: DataFrame, few: bool = False, ways: bool = True) -> DataFrame:
    """Routes of pairs (candidate, origin, dest) on a graph: candidate, origin, dest, d, edges. `few`: of few origins, each much work; origins are dealt evenly. Without `ways` edges are empty."""
    kinds = {c: pairs.schema[c].dataType for c in ("candidate", "origin", "dest")}
    step = pa.struct([("linkid", pa.int64()), ("reverse_link", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        c, o, t = (rows[x].to_numpy().astype(np.int64) for x in ("candidate", "origin", "dest"))
        by = np.lexsort((t, o, c))
        c, o, t = c[by], o[by], t[by]
        arrays = graph.open()
        for i in np.unique(c):
            a, b = np.searchsorted(c, [i, i + 1])
            g = make(arrays, int(i))
            nodes, row = np.unique(o[a:b], return_inverse=True)
            for part in W.groups(len(nodes), g.n, isinstance(g, W.TurnGraph)):
                f, l = np.searchsorted(row, [part.start, part.stop])
                yield from found(g, i, nodes[part], row[f:l] - part.start, t[a:b][f:l])

    def found(g, i: int, nodes: np.ndarray, row: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = nodes[row] == to
        of, k = g.ends(to)
        of, k = of[~own[of]], k[~own[of]]
        dist = W.least(g, nodes, None, (row[of], of, k))
        d = np.full(len(to), np.inf)
        np.minimum.at(d, of, dist[row[of], k])
        # of last links at the same cost the smallest
        fits = np.flatnonzero(np.isfinite(d[of]) & (dist[row[of], k] < d[of] + W.SAME))
        fits = fits[np.lexsort((g.code[k[fits]], of[fits]))]
        fits = fits[np.r_[True, of[fits][1:] != of[fits][:-1]]] if len(fits) else fits
        pair, last = of[fits], k[fits]
        order = np.sort(np.r_[pair, np.flatnonzero(own)])
        d[own] = 0.0
        if not ways or not len(pair):
            n, code = np.zeros(len(to), np.int64), np.zeros(0, np.int64)
        else:
            way, state = W.walk_back(g, dist, row[pair], last, _started(g, nodes))
            n, code = np.bincount(pair[way], minlength=len(to)), np.asarray(g.code[state])
        for some in np.array_split(order, -(-len(order) // 20_000)) if len(order) else []:
            lengths = n[some]
            begin = int(n[: some[0]].sum())
            e = code[begin : begin + int(lengths.sum())]
            edges = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(e >> 1), pa.array((e & 1).astype(bool))], fields=list(step)))
            ids = [pa.array(x).cast(to_arrow_type(kinds[c])) for c, x in (("candidate", np.full(len(some), i)), ("origin", nodes[row[some]]), ("dest", to[some]))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(d[some]), edges], ["candidate", "origin", "dest", "d", "edges"])

    schema = ", ".join(f"{c} {k.simpleString()}" for c, k in kinds.items()) + ", d double, edges array<struct<linkid:bigint,reverse_link:boolean>>"
    spread = pairs.select(*kinds).where("candidate is not null and origin is not null and dest is not null").distinct()
    if not few:
        return spread.repartition(W.tasks(pairs.sparkSession, 1_000_000), "candidate", "origin").mapInArrow(run, schema)
    spread = cut(spread)
    place = spread.select("candidate", "origin").distinct().withColumn("_i", F.row_number().over(Window.orderBy("candidate", "origin")) - 1)
    dealt = spread.join(F.broadcast(place), ["candidate", "origin"])
    n = W.tasks(pairs.sparkSession, place.count())
    return dealt.repartitionById(n, F.col("_i").cast("int")).select(*kinds).mapInArrow(run, schema)


def routes(starts: DataFrame, turns: DataFrame, edges: DataFrame, ods: DataFrame, small: int = SMALL_GRAPH, ways: bool = True) -> DataFrame:
    """Least-cost routes: (candidate,) origin, dest, d, edges (array of linkid and reverse_link in order). Unconnected pairs are left out; a pair to itself has no edges and costs 0.

    Starts and turns may have a `candidate`, a number of a variant of costs (a set of coefficients, a year): all variants are routed in one job, each for all
    pairs or, if the pairs have a `candidate` too, for its own. Small graphs (nodes are whole numbers) go to every task; with others, of one
    variant, frontiers are relaxed and walked back by joins. Without `ways` only costs are asked for, `edges` have no meaning.
    """
    varied = "candidate" in turns.columns
    starts, turns = _with_candidate(starts), _with_candidate(turns)
    graph = _turn_graph(starts, turns, edges, small)
    own = ["candidate"] if varied and "candidate" in ods.columns else []
    pairs = ods.select(*own, "origin", "dest").distinct()
    if graph is None and varied:
        # too many turns for one graph of all variants: one after the other, as many as the caller made
        parts = None
        for (i,) in starts.select("candidate").distinct().orderBy("candidate").collect():
            one = routes(starts.where(F.col("candidate") == i).drop("candidate"), turns.where(F.col("candidate") == i).drop("candidate"), edges, (ods.where(F.col("candidate") == i) if own else ods).select("origin", "dest"), small, ways).withColumn("candidate", F.lit(i))
            parts = one if parts is None else parts.unionByName(one)
        return parts.select("candidate", "origin", "dest", "d", "edges")
    if graph is None:
        reached = cut(relax(starts, turns))
        last = to_nodes(reached, edges, pairs)
        if not ways:
            return last.select("origin", "dest", "d", F.array().cast("array<struct<linkid:bigint,reverse_link:boolean>>").alias("edges"))
        steps = route_edges(reached, last)
        packed = steps.groupBy("origin", "dest").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "linkid", "reverse_link"))).alias("e"))
        e = F.transform(F.coalesce("e", F.array().cast("array<struct<k:int,linkid:bigint,reverse_link:boolean>>")), lambda x: F.struct(x["linkid"].alias("linkid"), x["reverse_link"].alias("reverse_link")))
        return last.join(packed, ["origin", "dest"], "left").select("origin", "dest", "d", e.alias("edges"))
    # a pair to itself counts where the origin has streets and the node is one that streets end at
    if not own:
        pairs = pairs.crossJoin(F.broadcast(turns.select("candidate").union(starts.select("candidate")).distinct())) if varied else pairs.withColumn("candidate", F.lit(0))
    self_ok = starts.select("candidate", "origin").distinct()
    ends = edges.select(F.col("B").alias("dest")).distinct()
    pairs = pairs.join(self_ok, ["candidate", "origin"], "left_semi").join(ends, "dest", "left_semi")
    found = _routed(graph, W.TurnGraph, pairs.withColumn("candidate", F.col("candidate").cast("int")), ways=ways)
    return found if varied else found.drop("candidate")


# --- turns that follow from the links ------------------------------------------------------------------------


@dataclass(frozen=True)
class Links:
    """A shared graph of directed links whose turns follow from their ends; `costs`: by variant the costs of turns by class."""

    graph: W.Shared
    costs: dict[str, dict[str, float]]

    def make(self, arrays: dict[str, np.ndarray], variant: int) -> W.LinkGraph:
        name = list(self.costs)[variant]
        return W.LinkGraph(arrays, name, self.costs[name])


def link_graph(edges: DataFrame, costs: dict[str, tuple[str, dict[str, float]]], keep: str | None = None) -> Links:
    """The graph of all turns between directed links (linkid, reverse_link, A, B, azimuth): a link is followed by every link of another id that begins where it ends.

    `costs` names variants: the column of a link's cost, and what turns cost by class (scalars.turn_class). A cost that is null or negative raises. `keep` is a column that link_reach returns.
    The turns are never stored: there are as many of them as the square of a node's degree. Links are sorted by node in the cluster, their arrays
    (33 bytes a link, 8 more a variant) pass the driver a part at a time into a file that tasks map.
    """
    spark = edges.sparkSession
    kinds = {"A": "i8", "code": "i8", "B": "i8", "azimuth": "f8"} | {f"cost_{v}": "f8" for v in costs} | ({"keep": "f8"} if keep else {})
    checked = [F.when(F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0), F.raise_error(F.lit("a link has no cost or a negative one")).cast("double")).otherwise(F.col(c).cast("double")).alias(f"cost_{v}") for v, (c, _) in costs.items()]
    e = edges.where("A is not null").select(F.col("A").cast("bigint").alias("A"), _code("linkid", "reverse_link").alias("code"), F.coalesce(F.col("B").cast("bigint"), F.lit(int(W.NO_NODE))).alias("B"), F.col("azimuth").cast("double"), *checked, *([F.col(keep).cast("double").alias("keep")] if keep else []))
    e = cut(e)
    parts = max(8, -(-e.count() // 500_000))
    at = e.repartitionByRange(parts, "A").sortWithinPartitions("A", "code")
    held: dict[str, list[np.ndarray]] = {k: [] for k in kinds if k != "A"}
    nodes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in W.columns(at, kinds):
        v, n = np.unique(x["A"], return_counts=True)
        if len(nodes[-1]) and nodes[-1][-1] == v[0]:
            counts[-1][-1] += n[0]
            v, n = v[1:], n[1:]
        if len(v):
            nodes.append(v)
            counts.append(n)
        for k in held:
            held[k].append(x[k])
    got = {k: np.concatenate(held.pop(k)) if held[k] else np.zeros(0, kinds[k]) for k in list(held)}
    node, out = np.concatenate(nodes), np.r_[0, np.cumsum(np.concatenate(counts))]
    ends = got.pop("B")
    # where links end in a node that none begins at, they are found by it all the same
    known = np.union1d(node, np.unique(ends[ends != W.NO_NODE]))
    if len(known) > len(node):
        n = np.zeros(len(known), np.int64)
        n[np.searchsorted(known, node)] = np.diff(out)
        node, out = known, np.r_[0, np.cumsum(n)]
    to = np.where(ends == W.NO_NODE, -1, np.searchsorted(node, ends)).astype(np.int32)
    del ends
    order = np.argsort(to, kind="stable").astype(np.int32)
    into = np.searchsorted(to[order], np.arange(len(node) + 1))
    loops = bool((np.repeat(np.arange(len(node)), np.diff(out)) == to).any())
    mean = float(got[f"cost_{next(iter(costs))}"].mean()) if len(to) else 1.0
    arrays = got | {"node": node, "out": out, "to": to, "order": order, "into": into, "loops": np.array([loops]), "mean": np.array([mean])}
    del got, to, order
    for v, (_, turn) in costs.items():
        if len(arrays["code"]) and arrays[f"cost_{v}"].min() + min(0.0, *(turn.values() or [0.0])) < 0:
            raise ValueError("a turn has a negative cost")
    return Links(W.share(spark, arrays), {v: turn for v, (_, turn) in costs.items()})


def link_reach(links: Links, origins: DataFrame, cutoff: float | None = None, whole: bool = False) -> DataFrame:
    """Links reached from each origin: origin, linkid, per variant the least cost of its directions (null: not reached), and `keep` if the graph has it. With `whole` a row per directed link, with reverse_link."""
    kind = origins.schema["origin"].dataType.simpleString()
    names = list(links.costs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = np.unique(np.concatenate([b["origin"].to_numpy(np.int64) for b in batches] or [np.zeros(0, np.int64)]))
        if not len(nodes):
            return
        arrays = links.graph.open()
        code = np.asarray(arrays["code"])
        by = None if whole else np.argsort(code, kind="stable")
        graphs = [links.make(arrays, i) for i in range(len(names))]
        for part in W.groups(len(nodes), len(code) * len(names)):
            some = nodes[part]
            every = [W.least(g, some, cutoff) for g in graphs]
            for r in range(len(some)):
                got = np.isfinite(every[0][r])
                for x in every[1:]:
                    got |= np.isfinite(x[r])
                k = np.flatnonzero(got) if whole else by[got[by]]
                if not len(k):
                    continue
                head = np.arange(len(k)) if whole else np.flatnonzero(np.r_[True, code[k][1:] >> 1 != code[k][:-1] >> 1])
                d = [np.minimum.reduceat(x[r][k], head) for x in every]
                at = k[head]
                for i in range(0, len(at), 500_000):
                    j = slice(i, i + 500_000)
                    cols = {"origin": np.full(len(at[j]), some[r]), "linkid": code[at[j]] >> 1}
                    if whole:
                        cols["reverse_link"] = (code[at[j]] & 1).astype(bool)
                    cols |= {f"d_{n}": pd.Series(x[j]).where(np.isfinite(x[j])) for n, x in zip(names, d)}
                    if "keep" in arrays:
                        cols["keep"] = arrays["keep"][at[j]]
                    yield pd.DataFrame(cols)

    keep = ", keep double" if "keep" in json.loads(links.graph.places) else ""
    schema = f"origin {kind}, linkid bigint" + ", reverse_link boolean" * whole + "".join(f", d_{n} double" for n in names) + keep
    return _spread(origins.select("origin")).mapInPandas(run, schema)


def _spread(df: DataFrame) -> DataFrame:
    """Distinct rows dealt evenly to a fixed number of tasks: they are few, each is much work."""
    df = cut(df.where(" and ".join(f"{c} is not null" for c in df.columns)).distinct())
    return df.repartition(W.tasks(df.sparkSession, df.count()))


def link_routes(links: Links, ods: DataFrame) -> DataFrame:
    """Least-cost routes of all pairs for every variant: variant, origin, dest, d, edges; see routes."""
    names = list(links.costs)
    pairs = cut(ods.select("origin", "dest").where("origin is not null and dest is not null").distinct())
    number = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("candidate") + 1)
    asked = pairs.crossJoin(ods.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("candidate")))
    return _routed(links.graph, links.make, asked, True).select(number.alias("variant"), "origin", "dest", "d", "edges")


def edges_of_routes(found: DataFrame) -> DataFrame:
    """A row per directed link of each route, with its place from 0."""
    keys = [c for c in ("candidate", "origin", "dest") if c in found.columns]
    return found.select(*keys, F.posexplode("edges").alias("pos", "e")).select(*keys, "pos", "e.linkid", "e.reverse_link")


def to_nodes(reached: DataFrame, edges: DataFrame, ods: DataFrame) -> DataFrame:
    """Least cost of each (origin, dest) and its last directed link; pairs that aren't connected are left out, one to itself costs 0 and has no link.

    Ties take the smallest link.
    """
    ends = edges.select("linkid", "reverse_link", F.col("B").alias("dest"))
    pairs = ods.select("origin", "dest").distinct()
    at = reached.join(ends, ["linkid", "reverse_link"]).join(pairs, ["origin", "dest"])
    best = at.groupBy("origin", "dest").agg(F.min(F.struct("d", "linkid", "reverse_link")).alias("b")).where("origin <> dest")
    found = best.select("origin", "dest", F.col("b.d").alias("d"), F.col("b.linkid").alias("linkid"), F.col("b.reverse_link").alias("reverse_link"))
    own = pairs.where("origin = dest").select("origin", "dest", F.lit(0.0).alias("d"), F.lit(None).cast("bigint").alias("linkid"), F.lit(None).cast("boolean").alias("reverse_link"))
    return found.unionByName(own)


def route_edges(reached: DataFrame, last: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The directed links of each route, from its last one back: origin, dest, back (0 for the last), linkid, reverse_link.

    All routes walk back one link a round (joins on the state); rounds double nothing and end when all have arrived.
    """
    keys = ["origin", "linkid", "reverse_link"]
    before = cut(reached.select(*keys, "p_linkid", "p_reverse_link"))
    now = cut(last.where("linkid is not null").select("origin", "dest", "linkid", "reverse_link").withColumn("back", F.lit(0)))
    parts = []
    for i in range(most_rounds):
        parts.append(now)
        now = cut(
            now.join(before, keys).where("p_linkid is not null")
            .select("origin", "dest", F.col("p_linkid").alias("linkid"), F.col("p_reverse_link").alias("reverse_link"), F.lit(i + 1).alias("back"))
        )
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"routes were not walked back in {most_rounds} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shed(reached: DataFrame, links: DataFrame) -> DataFrame:
    """Links reached from each origin (either direction), with their length: origin, linkid, length_ft."""
    return reached.select("origin", "linkid").distinct().join(links.select("linkid", "length_ft"), "linkid")
