import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import isotonic as IS
from tests.conftest import close


def by_definition(points):
    """(x, y) pairs: the largest over starts of the smallest over ends of the means of distinct x."""
    xs = sorted({x for x, _ in points})
    at = {x: [y for p, y in points if p == x] for x in xs}
    mean = lambda a, b: sum(sum(at[x]) for x in xs[a : b + 1]) / sum(len(at[x]) for x in xs[a : b + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


def on_the_line(fit, x):
    xs = sorted(fit)
    if x <= xs[0] or x >= xs[-1]:
        return fit[xs[0] if x <= xs[0] else xs[-1]]
    a, b = max(v for v in xs if v <= x), min(v for v in xs if v >= x)
    return fit[a] if a == b else fit[a] + (x - a) / (b - a) * (fit[b] - fit[a])


def points(n, seed, distinct=40):
    rng = random.Random(seed)
    return [(x / distinct, int(rng.random() < 0.2 + 0.5 * x / distinct)) for x in (rng.randrange(-5, distinct) for _ in range(n))]


@pytest.mark.parametrize("size", [1, 3, 7, IS.POINTS])
def test_pools_of_small_blocks_are_those_of_one(spark, size):
    given = {("A", 1): points(300, 1), ("A", 2): points(40, 2), (None, 1): points(200, 3), ("B", 1): [(0.5, 1), (0.2, 1), (0.9, 0)]}
    rows = [(*k, x, y) for k, v in given.items() for x, y in v]
    df = spark.createDataFrame(rows, "site string, n int, score double, label int").repartition(4)
    pools = IS.fit_pools(df, keys=["site", "n"], points=size)
    asked = [(*k, x) for k in given for x in (-1.0, 0.0, 0.013, 0.5, 0.511, 0.7777, 2.0, None)] + [("none", 1, 0.5)]
    q = spark.createDataFrame(asked, "site string, n int, score double").withColumn("x", F.col("score"))
    got = {(r["site"], r["n"], r["x"]): r["score"] for r in IS.calibrate(pools, q, ["site", "n"]).collect()}
    assert len(got) == len(asked)
    for site, n, x in asked:
        want = on_the_line(by_definition(given[(site, n)]), x) if x is not None and (site, n) in given else None
        assert close(got[(site, n, x)], want), (site, n, x)
    for r in pools.collect():
        assert r["low"] <= r["high"]


def test_ties_and_clipping(spark):
    fit = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.4, 0), (0.6, 1), (None, 1), (0.9, None)], "score double, label int")
    pools = IS.fit_pools(fit)
    asked = spark.createDataFrame([(0.0,), (0.2,), (0.5,), (0.9,)], "score double").withColumn("x", F.col("score"))
    got = {r["x"]: r["score"] for r in IS.calibrate(pools, asked).collect()}
    assert close(got[0.0], 1 / 3) and close(got[0.2], 1 / 3) and close(got[0.9], 1.0)
    assert close(got[0.5], 2 / 3)


def test_rising_and_falling(spark):
    up = spark.createDataFrame([(i / 50, int(i >= 25)) for i in range(50)], "score double, label int")
    assert IS.fit_pools(up, points=4).count() == 2
    down = spark.createDataFrame([(i / 50, int(i < 25)) for i in range(50)], "score double, label int")
    got = IS.fit_pools(down, points=4).collect()
    assert len(got) == 1 and got[0]["value"] == 0.5 and (got[0]["low"], got[0]["high"]) == (0.0, 0.98)


def test_empty(spark):
    none = spark.createDataFrame([], "score double, label int")
    assert IS.fit_pools(none).count() == 0
    got = IS.calibrate(IS.fit_pools(none), spark.createDataFrame([(0.5, 1)], "score double, k int")).collect()
    assert [(r["k"], r["score"]) for r in got] == [(1, None)]
