"""Implausible readings: spikes, stuck values and physical limits, judged against each source's own readings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.common import US, micros
from pathloom.operators.pieces import group_starts, whole_groups, with_pieces

#: A source is scored in pieces of so many counter steps; the context must cover the longest rule.
PIECE, CONTEXT = 8192, 32
#: Readings of whole sources that a task scores at once, about.
BATCH = 60_000


@dataclass(frozen=True)
class SpikeRules:
    """What is implausible; speeds in the unit of the readings."""

    #: The value that says there is no reading, and the physical limits.
    no_reading: float = -1.0
    least: float = 0.0
    most: float = 70.0
    #: So many equal readings above zero in a row are stuck.
    stuck: int = 12
    #: A spike: at most so many readings in a row, above every reading that is no case by this factor and this much.
    spike_run: int = 3
    spike_factor: float = 4 / 3
    spike_more: float = 7.0
    #: The forest: trees, readings a tree is grown on, its height. A candidate is what scores above this share of its source's own readings; of so few
    #: readings all are candidates.
    trees: int = 16
    sample: int = 64
    height: int = 6
    usual: float = 0.5
    few: int = 16
    #: Parts of an hour for the seasonal feature.
    phases: int = 12


def _noise(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on two whole numbers only, so a task that runs again scores alike."""
    x = np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _usual_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n values, by which an isolation forest's depths are scaled."""
    n = np.asarray(n, float)
    big = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


def forest_scores(features: np.ndarray, group: np.ndarray, seed: np.ndarray, r: SpikeRules) -> np.ndarray:
    """Isolation forest scores (2 ** -depth / usual depth) of all rows, a forest for each group, all groups side by side.

    `group` numbers the groups of the rows, which are in order; `seed` has a number per group.
    """
    n, k = features.shape
    groups = len(seed)
    size = np.bincount(group, minlength=groups)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    nodes = 1 << r.height
    depth = np.zeros(n)
    drawn = np.minimum(size, r.sample)
    for tree in range(r.trees):
        # rows the tree is grown on: with repetition, but no more than there are
        sg = np.repeat(np.arange(groups), drawn)
        pick = _noise(seed[sg] + np.arange(len(sg)).astype(np.uint64) - np.repeat(np.cumsum(drawn) - drawn, drawn).astype(np.uint64), 7919 + tree)
        sample = features[first[sg] + (pick * size[sg]).astype(np.int64)]
        at_s, at = np.ones(len(sg), np.int64), np.ones(n, np.int64)
        grown = np.ones(n, bool)
        live_s = np.ones(len(sg), bool)
        path = np.zeros(n)
        for level in range(r.height + 1):
            key = sg * (2 * nodes) + at_s
            order = np.argsort(key[live_s], kind="stable")
            rows = np.flatnonzero(live_s)[order]
            keys = key[rows]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[starts, len(keys)])
            node = keys[starts]
            # the node's feature and cut
            f = (_noise(seed[node // (2 * nodes)] + (node % (2 * nodes)).astype(np.uint64), 104729 + tree) * k).astype(np.int64)
            value = sample[rows, np.repeat(f, counts)]
            low, high = (np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)) if len(starts) else (value, value)
            cutting = low + (high - low) * _noise(seed[node // (2 * nodes)] + (node % (2 * nodes)).astype(np.uint64), 15485863 + tree)
            split = (high > low) & (level < r.height)
            # every row's node among them; nodes no sampled row is in end the path
            where = group[grown] * (2 * nodes) + at[grown]
            j = np.minimum(np.searchsorted(node, where), max(len(node) - 1, 0))
            there = node[j] == where if len(node) else np.zeros(len(where), bool)
            goes = there & split[j] if len(node) else there
            g = np.flatnonzero(grown)
            ended = g[~goes]
            path[ended] = level + np.where(there[~goes], _usual_path(counts[j[~goes]]), 0.0) if len(node) else level
            grown[ended] = False
            g, j = g[goes], j[goes]
            if not len(g):
                break
            at[g] = 2 * at[g] + (features[g, f[j]] > cutting[j])
            s = np.repeat(split, counts)
            live_s[rows[~s]] = False
            rows, value, c = rows[s], value[s], np.repeat(cutting, counts)[s]
            at_s[rows] = 2 * at_s[rows] + (value > c)
        depth += path
    usual = np.maximum(_usual_path(drawn), 1.0)[group]
    return 2.0 ** (-depth / r.trees / usual)


def _features(v: np.ndarray, us: np.ndarray, group: np.ndarray, run: np.ndarray, r: SpikeRules) -> np.ndarray:
    """Level, difference from the neighbours, difference from the mean of the same part of the hour, and run length, of readings in order."""
    inner = group[1:] == group[:-1]
    up = np.where(inner, v[1:] - v[:-1], 0.0)
    before, after = np.r_[0.0, up], np.r_[-up, 0.0]
    has_before, has_after = np.r_[False, inner], np.r_[inner, False]
    jump = np.where(has_before & has_after, np.where(np.abs(before) < np.abs(after), before, after), np.where(has_before, before, after))
    phase = np.where(us >= 0, (us // (3600 * US // r.phases)) % r.phases, 0).astype(np.int64)
    key = group * r.phases + phase
    n = np.bincount(key)
    season = v - (np.bincount(key, v) / np.maximum(n, 1))[key]
    return np.stack([v, jump, season, np.minimum(run, 64).astype(float)], axis=1)


_ROWS = "rec bigint, seq bigint, v double, score double, rule string, low double, high double, n bigint, total double"


def _scored(r: SpikeRules, every: bool):
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    limit_of = r.spike_run + 1

    def piece_rows(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["rec", "piece", "seq"]).reset_index(drop=True)
        starts = group_starts(frame, ["rec", "piece"])
        group = np.zeros(len(frame), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        v = frame["v"].to_numpy(float)
        own = frame["own"].to_numpy(bool)
        there = ~np.isnan(v) & (v != r.no_reading)
        limit = there & ((v < r.least) | (v > r.most))
        # runs of equal readings in a row
        same = np.zeros(len(v), bool)
        same[1:] = (v[1:] == v[:-1]) & there[1:] & (v[1:] > 0) & (group[1:] == group[:-1])
        begin = np.flatnonzero(~same)
        length = np.diff(np.r_[begin, len(v)])
        run = np.repeat(length, length)
        stuck = (run >= r.stuck) & there & (v > 0)
        rest = there & ~limit & ~stuck
        # the least of each row of spike_run + 1 readings: what reaches it is no spike
        lows = np.where(rest, v, -np.inf)
        held = np.full(len(v), -np.inf)
        if len(v) >= limit_of:
            view = np.lib.stride_tricks.sliding_window_view(lows, limit_of).min(axis=1)
            one = group[limit_of - 1 :] == group[: len(v) - limit_of + 1]
            held[: len(view)] = np.where(one, view, -np.inf)
        score, isolated = np.zeros(len(v)), np.zeros(len(v), bool)
        k = np.flatnonzero(rest)
        if len(k):
            us = frame["us"].fillna(-1).to_numpy(np.int64)
            _, g = np.unique(group[k], return_inverse=True)
            firsts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            rec, piece = frame["rec"].to_numpy()[k[firsts]], frame["piece"].to_numpy()[k[firsts]]
            seed = rec.astype(np.uint64) * np.uint64(1_000_003) + piece.astype(np.uint64)
            score[k] = forest_scores(_features(v[k], us[k], g, run[k], r), g, seed << np.uint64(16), r)
            # the source's own distribution of scores says what is isolated there
            size = np.bincount(g)
            ranked = score[k][np.lexsort((score[k], g))]
            usual = ranked[firsts + ((size - 1) * r.usual).astype(np.int64)]
            isolated[k] = (score[k] > usual[g]) | (size[g] <= r.few)
        high_run = np.maximum.reduceat(held, starts)
        candidate = rest & isolated & (v > high_run[group])
        rule = np.where(limit, "limit", np.where(stuck, "stuck", np.where(candidate, "candidate", None)))
        keep = own & (every | (rule != None))  # noqa: E711
        k = np.flatnonzero(keep)
        rec, seq = frame["rec"].to_numpy(), frame["seq"].to_numpy()
        rows = pd.DataFrame({"rec": rec[k], "seq": seq[k], "v": v[k], "score": np.where(rest, score, np.nan)[k], "rule": rule[k]})
        # what the piece says about its source: the level held in a row, the highest reading that is no candidate, and the readings as stored
        plain = np.where(rest & ~candidate & own, v, -np.inf)
        stored = there & own
        sums = pd.DataFrame({
            "rec": rec[starts], "rule": "source", "low": high_run, "high": np.maximum.reduceat(plain, starts), "n": np.add.reduceat(stored.astype(np.int64), starts),
            "total": np.add.reduceat(np.where(stored, v, 0.0), starts), "v": np.maximum.reduceat(np.where(stored, v, -np.inf), starts),
        })
        return pd.concat([rows, sums], ignore_index=True).reindex(columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["rec", "piece"], BATCH):
            yield piece_rows(frame)

    return run


def _judged(r: SpikeRules):
    def spikes(levels: np.ndarray, held: float, plain: float) -> float:
        """The lowest candidate level from which all are spikes; infinite if none is."""
        above = np.unique(levels[levels > held])
        floor = max(plain, levels[levels <= held].max(initial=-np.inf))
        under = np.r_[floor, above[:-1]]
        # the level below must be no case itself: nothing but candidates may lie above it
        ok = (above > r.spike_factor * under) & (above > under + r.spike_more) & (above > floor) & np.isfinite(under)
        return float(above[np.argmax(ok)]) if ok.any() else np.inf

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        source = (frame["rule"] == "source").to_numpy()
        sums, rows = frame[source], frame[~source]
        # sums of each source: the frame is in the order of sources
        at = group_starts(sums, ["rec"])
        rec = sums["rec"].to_numpy()[at]
        low, high, most = (np.maximum.reduceat(sums[c].to_numpy(float), at) for c in ("low", "high", "v"))
        n, total = np.add.reduceat(sums["n"].to_numpy(float), at), np.add.reduceat(sums["total"].to_numpy(float), at)
        v, rule = rows["v"].to_numpy(float), rows["rule"].to_numpy(object)
        candidate = rule == "candidate"
        k = np.flatnonzero(candidate)
        of = np.searchsorted(rec, rows["rec"].to_numpy())
        bar = np.full(len(rec), np.inf)
        for part in np.split(k, np.flatnonzero(np.diff(of[k])) + 1):
            if len(part):
                bar[of[part[0]]] = spikes(v[part], low[of[part[0]]], high[of[part[0]]])
        keep = ~candidate | (v >= bar[of])
        rule[candidate] = "spike"
        out = pd.DataFrame({"rec": rows["rec"].to_numpy()[keep], "seq": rows["seq"].to_numpy()[keep], "v": v[keep], "score": rows["score"].to_numpy(float)[keep], "rule": rule[keep]})
        mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
        whole = pd.DataFrame({"rec": rec, "seq": np.nan, "v": np.where(n > 0, most, np.nan), "score": mean, "rule": "source"})
        return pd.concat([x.astype({"seq": "Int64", "rule": object}) for x in (out, whole) if len(x)], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["rec"], BATCH):
            if len(frame):
                yield judged(frame)

    return run


def _pieces(readings: DataFrame, source: str, counter: str, at: str, value: str) -> DataFrame:
    rows = readings.where(F.col(source).isNotNull() & F.col(counter).isNotNull()).select(
        F.col(source).cast("bigint").alias("rec"), F.col(counter).cast("bigint").alias("seq"), micros(at).alias("us"), F.col(value).cast("double").alias("v")
    )
    rows = with_pieces(rows, "seq", PIECE, CONTEXT)
    return rows.repartition("rec", "piece").sortWithinPartitions("rec", "piece", "seq", "us", "v")


def score_readings(readings: DataFrame, source: str, counter: str, at: str, value: str, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Every reading with its isolation score (null where there is no reading, or it breaks a rule) and the rule it breaks: source, counter, value, score, rule."""
    rows = _pieces(readings, source, counter, at, value).mapInPandas(_scored(rules, True), _ROWS).where("rule is null or rule <> 'source'")
    none = F.isnan("v") | F.col("v").isNull()
    return rows.select(
        F.col("rec").alias(source), F.col("seq").alias(counter), F.when(~none, F.col("v")).alias(value),
        F.when(~F.isnan("score"), F.col("score")).alias("score"), "rule",
    )


def implausible_readings(readings: DataFrame, source: str, counter: str, at: str, value: str, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Implausible readings in the order of the counter, and a summary per source: source, counter, value, score, rule.

    rule is 'limit' (outside the physical limits), 'stuck' (in a row of equal readings above zero), 'spike' (a few readings in a row well above every
    reading of the source that is no case), or 'source': the source's summary, with the mean of its readings as stored in `score`
    and their maximum in `value`, and a null counter.

    Defined cases: rows with a null source or counter are not used; repeated rows, and rows of one counter value, count once (the earliest);
    null, NaN and no_reading values are no readings, and end a row; a source without readings only has a summary of nulls; a
    null time only leaves the seasonal feature without its part of the hour; an empty table gives an empty result; other columns are
    ignored.

    Method: for each source (piece by piece where it is long) an isolation forest on level, difference, seasonal and run-length features scores
    every reading. Readings more isolated than most of their source's, by its own distribution of scores, and not held by too many in a row, are candidates; only
    they can be spikes, and they are checked exactly against the source's other readings.
    Limits and stuck values are explicit rules.

    Scale: one shuffle of the readings by (source, piece); what leaves a piece are its flagged readings, its candidates and one summary.
    """
    rows = _pieces(readings, source, counter, at, value).mapInPandas(_scored(rules, False), _ROWS)
    out = rows.repartition("rec").sortWithinPartitions("rec", "rule", "seq").mapInPandas(_judged(rules), "rec bigint, seq bigint, v double, score double, rule string")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.select(F.col("rec").alias(source), F.col("seq").alias(counter), known("v").alias(value), known("score").alias("score"), "rule")


def wrong_summaries(found: DataFrame, summaries: DataFrame, source: str, mean: str, most: str, value: str, factor: float = 2.0) -> DataFrame:
    """Sources whose stored mean or maximum is not within 1/factor to factor of that of their readings, or whose mean exceeds their maximum.

    `found` comes from implausible_readings. A null summary says nothing; one of a source without readings is only held against the other; repeated
    rows count once. Nothing is within half to double of a negative mean, which no speed can have.
    """
    measured = found.where("rule = 'source'").select(F.col(source), F.col("score").alias("_mean"), F.col(value).alias("_most"))
    said = summaries.where(F.col(source).isNotNull()).select(source, F.col(mean).alias("_a"), F.col(most).alias("_b")).distinct()
    off = lambda a, b: F.coalesce(~a.between(b / factor, b * factor), F.lit(False))
    both = said.join(measured, source, "left")
    wrong = off(F.col("_a"), F.col("_mean")) | off(F.col("_b"), F.col("_most")) | F.coalesce(F.col("_a") > F.col("_b"), F.lit(False))
    return both.where(wrong).select(source).distinct()
