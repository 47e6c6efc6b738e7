"""Traces matched to the links they were made on: candidates by grid cells, the most likely path by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.common import written
from pathloom.operators.pieces import group_starts, whole_groups
from pathloom.operators.spatial import near_segments
from pathloom.operators.sweeps import spans

#: Pairs of candidates whose ways are compared at once (about 100 bytes each).
PAIRS = 400_000


@dataclass(frozen=True)
class MatchRules:
    """Search radius, noise of fixes, and what it costs to go on: scale of the difference of the ways, penalty for a link that isn't next to the one before."""

    radius: float = 100.0
    noise: float = 30.0
    way: float = 60.0
    unlinked: float = 8.0


def _viterbi(r: MatchRules):
    """All trips of a frame are decoded together: a step goes on along every trip that is as long, over the pairs of candidates of its last two points."""

    def decoded(t: pd.DataFrame) -> pd.DataFrame:
        x, y, px, py, along, d = (t[c].to_numpy() for c in ("x", "y", "px", "py", "along", "distance"))
        a, b, link, back = (t[c].to_numpy() for c in ("A", "B", "linkid", "reverse_link"))
        starts = group_starts(t, ["tripid", "sequence"])
        stops = np.r_[starts[1:], len(t)]
        heads = np.flatnonzero(np.isin(starts, group_starts(t, ["tripid"])))
        lengths = np.diff(np.r_[heads, len(starts)])
        step = np.arange(len(starts)) - np.repeat(heads, lengths)
        emit = -0.5 * (d / r.noise) ** 2
        score, prev = emit.copy(), np.full(len(t), -1)
        # points after the first of their trip, by step; a part has so many pairs with the candidates of the point before
        order = np.argsort(step, kind="stable")[len(heads) :]
        pairs = np.cumsum((stops - starts)[order] * (stops - starts)[order - 1])
        first = 0
        while first < len(order):
            done = pairs[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(pairs, done + PAIRS, "right")))
            p = order[first:last]
            j, of = spans(starts[p], stops[p])
            i, to = spans(starts[p[of] - 1], stops[p[of] - 1])
            k = j[to]
            gone = np.hypot(x[i] - x[k], y[i] - y[k])
            made = np.hypot(px[i] - px[k], py[i] - py[k])
            same = (link[i] == link[k]) & (back[i] == back[k])
            forward = same & (along[k] >= along[i] - r.noise)
            next_ = ~same & (b[i] == a[k]) & (link[i] != link[k])
            move = -np.abs(made - gone) / r.way - np.where(forward, 0.0, np.where(next_, 0.5, r.unlinked))
            begin = np.searchsorted(to, np.arange(len(j)))
            rounds = np.flatnonzero(np.r_[True, step[p][1:] != step[p][:-1]])
            rows = np.r_[np.searchsorted(of, rounds), len(j)]
            for f, l in zip(rows[:-1], rows[1:]):
                u, v = begin[f], begin[l] if l < len(j) else len(to)
                best, at = _most(score[i[u:v]] + move[u:v], begin[f:l] - u)
                score[j[f:l]], prev[j[f:l]] = best + emit[j[f:l]], i[u:v][at]
            first = last
        chosen = np.zeros(len(starts), np.int64)
        ends = heads + lengths - 1
        j, of = spans(starts[ends], stops[ends])
        chosen[ends] = j[_most(score[j], np.searchsorted(of, np.arange(len(ends))))[1]]
        for k in range(int(lengths.max(initial=1)) - 1, 0, -1):
            p = heads[lengths > k] + k
            chosen[p - 1] = prev[chosen[p]]
        out = t.iloc[chosen][["tripid", "sequence", "linkid", "reverse_link", "distance"]]
        return out.assign(last_matched=np.repeat(lengths - 1, lengths), points=np.repeat(t["points"].to_numpy()[starts[heads]], lengths))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["tripid"], 100_000):
            yield decoded(frame)

    return run


def _most(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of each group, which begin at `begin`, and the first place that has it."""
    most = np.maximum.reduceat(values, begin)
    of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(values)]))
    at = np.flatnonzero(values == most[of])
    return most, at[np.r_[True, of[at][1:] != of[at][:-1]]]


def match_traces(points: DataFrame, edges: DataFrame, rules: MatchRules = MatchRules(), counts: DataFrame | None = None) -> DataFrame:
    """The directed link of every matched point: tripid, sequence, linkid, reverse_link, distance, last_matched, points (of the trip).

    `points` has tripid, sequence, x, y; `edges` are directed with A, B and straight ends (ax, ay, bx, by). Each point's candidates are all directed links
    within the radius (found through grid cells). Points without any are left out. A trip's candidates are
    decoded together, many trips side by side: traces are bounded by what one ride records. Links between two points that no point lies on are not filled in.
    `counts`: tripid and points, where they are known already.
    """
    ends = edges.select("linkid", "reverse_link", "A", "B", "ax", "ay", "bx", "by")
    n = points_of_trips(points) if counts is None else counts
    near = near_segments(points.select("tripid", "sequence", "x", "y"), ends, rules.radius, rules.radius * 2)
    at = lambda p, q: F.col(p) + F.col("share") * (F.col(q) - F.col(p))
    cand = near.withColumn("px", at("ax", "bx")).withColumn("py", at("ay", "by")).withColumn("along", F.col("share") * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    rows = cand.join(n, "tripid").select("tripid", "sequence", "x", "y", "linkid", "reverse_link", "distance", "A", "B", "px", "py", "along", "points")
    schema = "tripid bigint, sequence int, linkid bigint, reverse_link boolean, distance double, last_matched int, points bigint"
    return rows.repartition("tripid").sortWithinPartitions("tripid", "sequence", "distance", "linkid", "reverse_link").mapInPandas(_viterbi(rules), schema)


def points_of_trips(points: DataFrame) -> DataFrame:
    return points.groupBy("tripid").agg(F.count(F.lit(1)).alias("points"))


def match_again(points: DataFrame, edges: DataFrame, rules: MatchRules = MatchRules(), wider: MatchRules | None = None) -> DataFrame:
    """As match_traces, and trips that fail (no match, or fewer than two links) once more with wider rules (by default all distances doubled); what they find then counts, if anything."""
    wider = wider or replace(rules, radius=rules.radius * 2, noise=rules.noise * 2, way=rules.way * 2)
    counts = written(points_of_trips(points))
    first = written(match_traces(points, edges, rules, counts))
    fine = match_summary(first).where(F.size("edges") >= 2).select("tripid")
    # as a rule few trips fail: as a table of known size they can go to the points, of which only theirs are shuffled to cells again
    failed = written(counts.join(fine, "tripid", "left_anti").select("tripid", "points"))
    second = written(match_traces(points.join(failed.select("tripid"), "tripid", "left_semi"), edges, wider, failed))
    return first.join(second.select("tripid").distinct(), "tripid", "left_anti").unionByName(second)


def match_summary(matched: DataFrame) -> DataFrame:
    """Per trip: match_ratio (matched points over all), mean_distance and its links as a list without repeats in a row."""
    order = F.sort_array(F.collect_list(F.struct("sequence", "linkid", "reverse_link")))
    out = matched.groupBy("tripid").agg((F.count(F.lit(1)) / F.max("points")).alias("match_ratio"), F.avg("distance").alias("mean_distance"), order.alias("e"))
    e = F.transform("e", lambda v: F.struct(v["linkid"].alias("linkid"), v["reverse_link"].alias("reverse_link")))
    # each beside the one before: inside a lambda the list would be made anew for each of its elements
    beside = F.zip_with("e", F.concat(F.slice("e", 1, 1), "e"), lambda v, b: F.struct(v.alias("v"), b.alias("b")))
    kept = F.filter(beside, lambda p, i: p["v"].isNotNull() & ((i == 0) | (p["v"] != p["b"])))
    return out.withColumn("e", e).withColumn("edges", F.transform(kept, lambda p: p["v"])).drop("e")


def triage(summary: DataFrame, trips: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Trips by outcome: above the cutoff, below it, failed (fewer than two matched links or none), with their percentage."""
    out = trips.select("tripid").distinct().join(summary, "tripid", "left")
    status = F.when(F.col("match_ratio").isNull() | (F.size("edges") < 2), "failed").when(F.col("match_ratio") > cutoff, "matched").otherwise("partial")
    counts = out.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", (F.col("n") / F.col("_t") * 100).alias("percent"))
