"""Impedance coefficients fitted to observed routes: a particle swarm whose whole population is priced and routed in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.impedance import Term


@dataclass(frozen=True)
class Swarm:
    """Settings of the swarm."""

    size: int = 10
    rounds: int = 10
    inertia: float = 0.73
    own: float = 1.5
    best: float = 1.5
    seed: int = 0
    tolerance: float = 1e-6


#: Loss functions by name: (intersection, union of lengths per candidate and trip) -> loss per candidate.
LOSSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "jaccard_mean": lambda p: p.groupBy("candidate").agg(F.round(-F.avg(F.col("intersection_len") / F.col("union_len")), 4).alias("loss")),
    "jaccard_total": lambda p: p.groupBy("candidate").agg(F.round(-F.sum("intersection_len") / F.sum("union_len"), 4).alias("loss")),
}


def with_betas(terms: Sequence[Term], betas: Sequence[float]) -> list[Term]:
    return [replace(t, beta=float(b)) for t, b in zip(terms, betas)]


def fit(terms: Sequence[Term], evaluate: Callable[[list[list[Term]]], list[float]], swarm: Swarm = Swarm()) -> tuple[list[float], float, list[tuple[int, float]]]:
    """Best coefficients within the terms' ranges, their loss, and the best loss after each round.

    `evaluate` scores a whole population at once (None or NaN: infeasible). Deterministic for a seed.
    """
    rnd = np.random.default_rng(swarm.seed)
    lo, hi = np.array([t.range for t in terms], float).T
    x = rnd.uniform(lo, hi, (swarm.size, len(terms)))
    v = rnd.uniform(-(hi - lo) / 4, (hi - lo) / 4, x.shape)
    own, own_loss = x.copy(), np.full(swarm.size, np.inf)
    trace: list[tuple[int, float]] = []
    for k in range(swarm.rounds):
        loss = np.array([np.inf if s is None or np.isnan(s) else s for s in evaluate([with_betas(terms, b) for b in x])], float)
        better = loss < own_loss
        own[better], own_loss[better] = x[better], loss[better]
        lead = own[own_loss.argmin()]
        trace.append((k, float(own_loss.min())))
        if k > 2 and abs(trace[-3][1] - trace[-1][1]) < swarm.tolerance and np.ptp(x, axis=0).max() < 1e-3:
            break
        v = swarm.inertia * v + swarm.own * rnd.random(x.shape) * (own - x) + swarm.best * rnd.random(x.shape) * (lead - x)
        x = np.clip(x + v, lo, hi)
    i = int(own_loss.argmin())
    return own[i].tolist(), float(own_loss[i]), trace


def convergence(trace: DataFrame, order: str, loss: str) -> DataFrame:
    """Best loss so far after each evaluation."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trace.withColumn("best", F.min(loss).over(w))


def improved_split(trips: DataFrame, modeled: str, shortest: str) -> DataFrame:
    """Trips better, worse or as good with the model as by the shortest route: outcome, n."""
    sign = F.signum(F.col(modeled) - F.col(shortest))
    return trips.groupBy(F.when(sign > 0, "improved").when(sign < 0, "worse").otherwise("same").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
