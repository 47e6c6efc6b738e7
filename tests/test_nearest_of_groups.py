"""The nearest target of each group: right, and without looking at all within the radius."""

import math
import random

from pathloom.operators import spatial as X


def test_against_all_pairs(spark):
    rnd = random.Random(4)
    points = [(i, float(rnd.randrange(60)), float(rnd.randrange(60))) for i in range(80)]
    targets = [(i, rnd.randrange(4) if i else 9, float(rnd.randrange(60)), float(rnd.randrange(60))) for i in range(120)] + [(200, 1, None, 3.0)]
    got = X.nearest_of_groups(
        spark.createDataFrame(points, "p int, x double, y double"), "p", spark.createDataFrame(targets, "t int, g int, qx double, qy double"), "g", "t", 20.0
    ).collect()
    want = {}
    for p, x, y in points:
        for t, g, qx, qy in targets:
            if qx is not None and (d := math.hypot(x - qx, y - qy)) <= 20:
                want[p, g] = min(want.get((p, g), (math.inf, 0)), (d, t))
    assert {(r["p"], r["g"]): (r["distance"], r["t"]) for r in got} == want and len(got) == len(want)
