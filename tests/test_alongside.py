"""Segments along others, found from a few samples each, are those that looking at every sample gives."""

import math
import random

import pytest

import __spark_entry__ as entry
from pathloom.operators import alongside as A
from pathloom.operators import spatial as X


def _lines(spark, seed, key):
    rnd, out = random.Random(seed), [(900, None, 0.0, 1.0, 1.0), (901, float("nan"), 0.0, 1.0, 1.0)]
    for i in range(250):
        x, y, length, way = rnd.uniform(-400, 900), rnd.uniform(-400, 900), rnd.choice([0, 3, 40, 60, 200, 900]), math.radians(rnd.choice([0, 90, 45, rnd.uniform(0, 360)]))
        ends = (x, y, x + length * math.cos(way), y + length * math.sin(way))
        out.append((i, *(float(round(v, -1)) if seed % 2 else v for v in ends)))  # on a lattice distances are just the buffer
    return spark.createDataFrame(out, f"{key} bigint, ax double, ay double, bx double, by double")


@pytest.mark.parametrize(("buffer", "every", "share", "angle"), [(50.0, 50.0, 0.2, 30.0), (20.0, 7.0, 0.95, 30.0), (50.0, 10.0, 0.5, 90.1), (5.0, 3.0, 0.01, 89.95)])
def test_as_every_sample_has_it(spark, monkeypatch, buffer, every, share, angle):
    read = lambda df: sorted((r[0], r[1], r[2], round(r[3], 8)) for r in df.collect())
    for seed in (1, 2):
        a, b = _lines(spark, seed, "k"), _lines(spark, seed + 10, "o")
        want = read(X.covered_share(a, "k", b, "o", buffer, every).where(f"share >= {share} and angle < {angle}"))
        assert read(A.share_along(a, "k", b, "o", buffer, every, share, angle)) == want and want


def test_side_paths_look_up_few_samples(spark, data, monkeypatch):
    def refuse(*_):
        raise AssertionError("every sample meets every path of its cell")

    monkeypatch.setattr(X, "near_segments", refuse)
    assert entry.queries()["side_paths"](spark, data).count() > 0


def _sent(spark):
    """Rows that stages have written for others so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_long_segments_are_sent_few_times(spark):
    lines = [(i, 100.0 * i, 0.0, 100.0 * i + 3000.0, 6000.0) for i in range(50)]
    a, b = (spark.createDataFrame(lines, f"{k} bigint, ax double, ay double, bx double, by double") for k in ("k", "o"))
    before = _sent(spark)
    assert A.share_along(a, "k", b, "o", 50.0, 50.0, 0.2, 30.0).count() >= 50
    # each crosses over 20 cells of 400 and has 5 samples
    assert _sent(spark) - before < 50 * 14
