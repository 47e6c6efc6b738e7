"""Least costs from many origins at once on a graph whose arrays all tasks of an executor map from one file."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from pathloom.common import _file_system, shared_folder

#: Costs nearer than this are the same when routes are walked back.
SAME = 1e-9
#: Origins x states that are worked on at once (21 bytes each); where turns are stored, which needs nothing else by state, more, as a step's cost hardly depends on how many origins take it.
AT_ONCE, AT_ONCE_TURNS = 600_000, 4_000_000
NO_NODE = np.iinfo(np.int64).min


# --- arrays in files -----------------------------------------------------------------------------------------


def columns(df: DataFrame, kinds: dict[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows' columns as arrays, a partition at a time and in their order; the driver holds one partition."""
    names = list(kinds)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({c: [b[c].to_numpy().astype(kinds[c]).tobytes()] for c in names})

    for row in df.select(*names).mapInPandas(packed, ", ".join(f"{c} binary" for c in names)).toLocalIterator():
        yield {c: np.frombuffer(row[c], kinds[c]) for c in names}


@dataclass(frozen=True)
class Shared:
    """Arrays by name in one file of the shared folder, which tasks map into memory: what many tasks read is there once."""

    path: str
    fetched: bool
    places: str

    def open(self) -> dict[str, np.ndarray]:
        path = SparkFiles.get(os.path.basename(self.path)) if self.fetched else self.path
        out = {}
        for name, (kind, at, n) in json.loads(self.places).items():
            out[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
        return out


def share(spark: SparkSession, arrays: dict[str, np.ndarray]) -> Shared:
    """Write arrays (emptied from the dictionary one by one) to the shared folder; where that is no local path, executors fetch the file. It is removed when the driver ends."""
    name = f"arrays-{uuid.uuid4().hex}.bin"
    path, fs = _file_system(spark, f"{shared_folder(spark).rstrip('/')}/{name}")
    whole = fs.makeQualified(path).toString()
    local = whole.startswith("file:")
    own = "/" + whole[5:].lstrip("/") if local else os.path.join(tempfile.mkdtemp(prefix="pathloom-"), name)
    os.makedirs(os.path.dirname(own), exist_ok=True)
    places = {}
    with open(own, "wb") as f:
        for key in list(arrays):
            a = arrays.pop(key)
            f.write(b"\0" * (-f.tell() % 64))
            places[key] = (a.dtype.str, f.tell(), len(a))
            for i in range(0, len(a), 1 << 20):
                f.write(np.ascontiguousarray(a[i : i + (1 << 20)]).tobytes())
    if not local:
        fs.copyFromLocalFile(True, True, _file_system(spark, f"file://{own}")[0], path)
        shutil.rmtree(os.path.dirname(own))
        spark.sparkContext.addFile(whole)
    fs.deleteOnExit(path)
    return Shared(own if local else whole, not local, json.dumps(places))


def share_parts(spark: SparkSession, parts: Iterator[dict[str, np.ndarray]], kinds: dict[str, str]) -> Shared:
    """share of columns that come a part after the other, of which the driver holds one."""
    own = tempfile.mkdtemp(prefix="pathloom-")
    path = {c: os.path.join(own, c) for c in kinds}
    files = {c: open(path[c], "wb") for c in kinds}
    for part in parts:
        for c, f in files.items():
            f.write(part[c].astype(kinds[c], copy=False).tobytes())
    for f in files.values():
        f.close()
    out = share(spark, {c: np.memmap(path[c], k, "r") if os.path.getsize(path[c]) else np.zeros(0, k) for c, k in kinds.items()})
    shutil.rmtree(own)
    return out


# --- graphs --------------------------------------------------------------------------------------------------


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges one after the other, and the range that each belongs to."""
    n = (last - first).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (first - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n)[of], of


def change_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """scalars.angle_change of arrays."""
    r = np.fmod(target - source, 360.0)
    return np.where(r < 0, np.fmod(r + 360.0, 360.0), r)


def class_costs(change: np.ndarray, by_class: dict[str, float]) -> np.ndarray:
    """Cost of turns by their class; classes as scalars.turn_class has them."""
    c = [by_class.get(k, 0.0) for k in ("straight", "right", "uturn", "left")]
    return np.where((change > 330) | (change < 30), c[0], np.where(change <= 150, c[1], np.where(change < 210, c[2], c[3])))


class TurnGraph:
    """States (directed links) by their code, and per candidate the turns between them (by source; also by target, for walking back), first states by origin, last ones by destination."""

    def __init__(self, a: dict[str, np.ndarray], candidate: int, by_class: None = None) -> None:
        self.code = a["code"]
        self.n = len(self.code)
        t0, t1 = np.searchsorted(a["candidate"], [candidate, candidate + 1])
        self.src, self.dst, self.cost = (np.asarray(a[k][t0:t1]) for k in ("src", "dst", "cost"))
        self.out = np.searchsorted(self.src, np.arange(self.n + 1))
        self.order = np.argsort(self.dst, kind="stable")
        self.into = np.searchsorted(self.dst[self.order], np.arange(self.n + 1))
        s0, s1 = np.searchsorted(a["start_candidate"], [candidate, candidate + 1])
        self.start_node, self.start_state, self.start_cost = (np.asarray(a[k][s0:s1]) for k in ("start_node", "start_state", "start_cost"))
        self.end_node, self.end_state = a["end_node"], a["end_state"]
        self.step = float(self.cost[self.cost < 1e6].mean()) * 4 if (self.cost < 1e6).any() else 1.0

    def starts(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, of = spans(np.searchsorted(self.start_node, nodes), np.searchsorted(self.start_node, nodes, "right"))
        return of, self.start_state[at].astype(np.int64), self.start_cost[at]

    def ends(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, of = spans(np.searchsorted(self.end_node, nodes), np.searchsorted(self.end_node, nodes, "right"))
        return of, self.end_state[at].astype(np.int64)

    def expander(self, sources: int) -> Callable:
        def expand(row: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            e, of = spans(self.out[k], self.out[k + 1])
            return of, self.dst[e], d[of] + self.cost[e]

        return expand

    def before(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, of = spans(self.into[k], self.into[k + 1])
        e = self.order[e]
        return of, self.src[e].astype(np.int64), self.cost[e]


class LinkGraph:
    """Directed links by the node they begin at. Turns aren't stored: a link is followed by those of other ids that begin where it ends, at their own cost and
    that of the turn's class.

    At a node, a link that ends there later than two others by more than turns differ in cost is on no least way further: of the
    links that may follow, each has another id than one of the two. So few of a node's turns are looked at, whatever its degree.
    """

    def __init__(self, a: dict[str, np.ndarray], variant: str, by_class: dict[str, float]) -> None:
        self.a, self.code, self.node, self.out, self.to, self.azimuth, self.order, self.into = a, *(a[k] for k in ("code", "node", "out", "to", "azimuth", "order", "into"))
        self.cost, self.by_class = a[f"cost_{variant}"], by_class
        self.n, self.nodes = len(self.code), len(self.node)
        each = [by_class.get(k, 0.0) for k in ("straight", "right", "uturn", "left")]
        self.slack = max(each) - min(each) + 1e-6
        self.turned = any(each)
        self.step = max(float(a["mean"][0]) / 5, 1e-9)
        self.loops = bool(a["loops"][0])

    def starts(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.minimum(np.searchsorted(self.node, nodes), self.nodes - 1)
        there = self.node[v] == nodes
        at, of = spans(self.out[v], np.where(there, self.out[v + 1], self.out[v]))
        return of, at, self.cost[at]

    def ends(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.minimum(np.searchsorted(self.node, nodes), self.nodes - 1)
        there = self.node[v] == nodes
        at, of = spans(self.into[v], np.where(there, self.into[v + 1], self.into[v]))
        return of, self.order[at].astype(np.int64)

    def _turns(self, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the turns from k to j cost, target included."""
        cost = self.cost[j]
        return cost + class_costs(change_of(self.azimuth[k], self.azimuth[j]), self.by_class) if self.turned else cost

    def expander(self, sources: int) -> Callable:
        seen = np.zeros(sources * self.n, bool)
        first, second = np.full(sources * self.nodes, np.inf), np.full(sources * self.nodes, np.inf)

        def expand(row: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v = self.to[k].astype(np.int64)
            new = ~seen[row * self.n + k] & (v >= 0)
            if self.loops:
                new &= np.searchsorted(self.out, k, "right") - 1 != v
            seen[row * self.n + k] = True
            at = row * self.nodes + v
            p, q = at[new], d[new]
            by = np.lexsort((q, p))
            p, q = p[by], q[by]
            head = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
            u, least = p[head], q[head]
            after = np.minimum(head + 1, max(len(p) - 1, 0))
            runner = np.where((after > head) & (p[after] == u), q[after], np.inf)
            second[u] = np.minimum(np.minimum(np.maximum(first[u], least), second[u]), runner)
            first[u] = np.minimum(first[u], least)
            keep = np.flatnonzero((v >= 0) & (d <= second[at] + self.slack))
            v, k = v[keep], k[keep]
            j, of = spans(self.out[v], self.out[v + 1])
            k = k[of]
            other = self.code[k] >> 1 != self.code[j] >> 1
            j, k, of = j[other], k[other], keep[of[other]]
            return of, j, d[of] + self._turns(k, j)

        return expand

    def before(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.searchsorted(self.out, k, "right") - 1
        at, of = spans(self.into[v], self.into[v + 1])
        i = self.order[at].astype(np.int64)
        other = self.code[i] >> 1 != self.code[k[of]] >> 1
        i, of = i[other], of[other]
        return of, i, self._turns(i, k[of])


# --- the search ----------------------------------------------------------------------------------------------


def _once(keys: np.ndarray, slot: np.ndarray) -> np.ndarray:
    i = np.arange(len(keys), dtype=slot.dtype)
    slot[keys] = i
    return keys[slot[keys] == i]


def least(graph, nodes: np.ndarray, cutoff: float | None = None, ends: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Least cost of every state from each of the nodes (len(nodes) x states; inf: not reached).

    States whose cost is about the same are gone on from together, over all nodes (delta stepping): costs are exact, as each improvement is gone on from again. With
    `ends` (place among the nodes, number of the destination in order, last state) it goes no farther than the farthest destination of a node.
    """
    n, s = graph.n, len(nodes)
    dist, slot = np.full(s * n, np.inf), np.zeros(s * n, np.int32)
    row, k, d = graph.starts(nodes)
    bound = np.full(s, np.inf if cutoff is None else cutoff)
    ok = d <= bound[row]
    key = row[ok] * n + k[ok]
    np.minimum.at(dist, key, d[ok])
    expand = graph.expander(s)
    if ends is not None:
        e_key, e_first = ends[0] * n + ends[2], np.flatnonzero(np.r_[True, ends[1][1:] != ends[1][:-1]]) if len(ends[1]) else np.zeros(0, np.int64)
        e_row = ends[0][e_first]
        r_first = np.flatnonzero(np.r_[True, e_row[1:] != e_row[:-1]]) if len(e_row) else np.zeros(0, np.int64)
        bound[np.setdiff1d(np.arange(s), e_row)] = -1.0  # nothing is asked from there
    far, level = [key], -np.inf
    while True:
        f = np.concatenate(far)
        f = f[dist[f] > level]
        if ends is not None:
            if len(e_key):
                farthest = np.maximum.reduceat(np.minimum.reduceat(dist[e_key], e_first), r_first)
                bound[e_row[r_first]] = farthest if cutoff is None else np.minimum(farthest, cutoff)
            f = f[dist[f] <= bound[f // n]]
        f = _once(f, slot)
        if not len(f):
            return dist.reshape(s, n)
        df = dist[f]
        level = df.min() + graph.step
        near, far = f[df <= level], [f[df > level]]
        while len(near):
            row = near // n
            of, j, c = expand(row, near - row * n, dist[near])
            row = row[of]
            key = row * n + j
            better = (c < dist[key]) & (c <= bound[row])
            key = key[better]
            np.minimum.at(dist, key, c[better])
            now = dist[key] <= level
            far.append(key[~now])
            near = _once(key[now], slot)


def walk_back(graph, dist: np.ndarray, row: np.ndarray, state: np.ndarray, started: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of each way from its last one back to the first: the way's number and the state, ways in order and each from its first state on.

    All ways go back a step at a time. Of the states that cost the same to come from, the one with the smallest code, and always one
    that was reached at less, so that links without cost can't make a circle; only where there is none, among states of the same cost by search.
    `started` has what states cost as first ones (inf: none), like `dist`.
    """
    way = np.arange(len(row))
    parts, k = [(way, state, np.zeros(len(row), np.int64))], state
    back = 0
    while len(way):
        on = dist[row, k] < started[row, k] - SAME
        way, row, k = way[on], row[on], k[on]
        of, i, w = graph.before(k)
        here = dist[row, k][of]
        come = dist[row[of], i]
        fits = np.abs(come + w - here) < SAME
        good = np.flatnonzero(fits & (come < here))
        by = np.lexsort((graph.code[i[good]], of[good]))
        good = good[by]
        head = good[np.r_[True, of[good][1:] != of[good][:-1]]] if len(good) else good
        nxt = np.full(len(way), -1, np.int64)
        nxt[of[head]] = i[head]
        for x in np.flatnonzero(nxt < 0):
            nxt[x] = _around(graph, dist[row[x]], started[row[x]], int(k[x]))
        back += 1
        k = nxt
        if len(way):
            parts.append((way, k, np.full(len(way), back)))
    way, state, back = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((-back, way))
    return way[by], state[by]


def _around(graph, dist: np.ndarray, started: np.ndarray, k: int) -> int:
    """The next state back on a shortest way through states of the same cost to one that is a first one or was reached at less."""
    first, queue = {k: -1}, [k]
    for j in queue:
        _, i, w = graph.before(np.array([j]))
        fits = np.abs(dist[i] + w - dist[j]) < SAME
        for p in sorted(i[fits].tolist(), key=lambda x: graph.code[x]):
            if p in first:
                continue
            first[p] = p if j == k else first[j]
            if dist[p] < dist[k] or dist[p] >= started[p] - SAME:
                return first[p]
            queue.append(p)
    raise RuntimeError("a way can't be walked back")


def groups(n: int, states: int, turns: bool = False) -> Iterator[slice]:
    size = max(1, (AT_ONCE_TURNS if turns else AT_ONCE) // max(states, 1))
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def tasks(spark: SparkSession, rows: int, least_each: int = 1) -> int:
    """Rows are few, each is much work: a fixed number of tasks, which isn't coalesced for their small size."""
    return max(1, min(max(spark.sparkContext.defaultParallelism * 4, 24, rows // 500_000), -(-rows // least_each)))

