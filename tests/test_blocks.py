import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.expr import threshold_bucket, value_block
from stayline.operators import blocks as BL


def test_value_block_keeps_order(spark):
    rng = random.Random(5)
    xs = [0.0, -0.5, 0.5, 1.0, 2.0, 1e-300, -1e-300, 1e300, 3.0000001, 3.0] + [
        rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-12, 12) for _ in range(500)
    ]
    for bits in (12, 24):
        rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", value_block(F.col("x"), bits).alias("b"))
        got = sorted((r["x"], r["b"]) for r in rows.collect())
        assert all(p[1] <= q[1] for p, q in zip(got, got[1:]))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_plain_scan(spark, descending):
    rng = random.Random(7)
    rows = {}
    for i in range(3000):  # one key holds most rows
        key = "hot" if i % 3 else rng.choice("ab")
        rows[(key, round(rng.gauss(0, 5), 3))] = rng.randint(0, 9)
    data = [(k, x, v) for (k, x), v in rows.items()]
    df = spark.createDataFrame(data, "k string, x double, v long")
    out = BL.running_totals(df, ["k"], "x", ["v"], value_block(F.col("x")), descending, with_next=True)
    got = {(r["k"], r["x"]): (r["cum_v"], r["next_x"]) for r in out.collect()}
    for key in ("hot", "a", "b"):
        xs = sorted((x for k, x, _ in data if k == key), reverse=descending)
        total = 0
        for i, x in enumerate(xs):
            total += rows[(key, x)]
            assert got[(key, x)] == (total, xs[i + 1] if i + 1 < len(xs) else None)


def test_row_numbers(spark):
    data = [(i % 2, (i * 7919) % 1009) for i in range(1000)]
    df = spark.createDataFrame(data, "k int, x long")
    out = BL.row_numbers(df, ["k"], ["x"], F.floor(F.col("x") / 50), "rn").collect()
    for k in (0, 1):
        xs = sorted(x for kk, x in data if kk == k)
        assert {r["x"]: r["rn"] for r in out if r["k"] == k} == {x: i + 1 for i, x in enumerate(xs)}


def test_halo_windows_equal_whole_windows(spark):
    df = spark.range(300).select(F.lit("e").alias("e"), F.col("id").cast("int").alias("hour"), ((F.col("id") * 37) % 101).alias("x"))
    cut = BL.with_halo(df, "hour", 9, size=16)
    w = W.partitionBy("e", BL.BLOCK).orderBy("hour").rowsBetween(-9, 0)
    got = cut.withColumn("m", F.max("x").over(w)).filter(~F.col(BL.HALO)).select("hour", "m")
    whole = df.select("hour", F.max("x").over(W.partitionBy("e").orderBy("hour").rowsBetween(-9, 0)).alias("m"))
    assert sorted(got.collect()) == sorted(whole.collect())
    # a lookback longer than the block makes the block longer
    assert BL.block_hours(600) > 600
    cut = BL.with_halo(df, "hour", 40, size=16)
    w = W.partitionBy("e", BL.BLOCK).orderBy("hour").rowsBetween(-40, 0)
    got = cut.withColumn("m", F.max("x").over(w)).filter(~F.col(BL.HALO)).select("hour", "m")
    whole = df.select("hour", F.max("x").over(W.partitionBy("e").orderBy("hour").rowsBetween(-40, 0)).alias("m"))
    assert sorted(got.collect()) == sorted(whole.collect())


def test_prior_summary_folds_earlier_blocks_only(spark):
    df = spark.createDataFrame([("a", h, float(h) if h in (1, 40) else None) for h in range(96)], "k string, hour int, x double")
    at = F.when(F.col("x").isNotNull(), F.col("hour"))
    out = BL.prior_summary(df, ["k"], BL.hour_block(F.col("hour"), 32), {"n": (F.count("x"), "sum"), "h": (F.max(at), "last")})
    assert sorted((r[BL.BLOCK], r["n"], r["h"]) for r in out.collect()) == [(0, None, None), (1, 1, 1), (2, 2, 40)]


@pytest.mark.parametrize("method,want", [("linear", 2.5), ("nearest", 3.0), ("lower", 2.0)])
def test_quantile_methods(spark, method, want):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)] + [(2, 9.0)], "k int, x double")
    got = BL.exact_quantiles(df, ["k"], "x", {"m": 0.5}, value_block(F.col("x")), method)
    assert {r["k"]: (r["n"], r["m"]) for r in got.collect()} == {1: (4, want), 2: (1, 9.0)}


def test_threshold_bucket_has_no_off_by_one(spark):
    scores = [k / 100 for k in range(101)] + [k / 100 - 1e-12 for k in range(1, 101)]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select("s", threshold_bucket(F.col("s")).alias("k"))
    for r in rows.collect():
        assert r["k"] == sum(r["s"] >= k / 100 for k in range(1, 101))


def test_prior_summary_across_coarse_blocks(spark):
    """Blocks far apart fall into different groups of blocks."""
    rows = [("a", b, i, None if i == 2 else i) for i, b in enumerate([0, 5, 4096, 4100, 9000])]
    df = spark.createDataFrame(rows, "k string, b long, v long, x long")
    out = BL.prior_summary(df, ["k"], F.col("b"), {"s": (F.sum("v"), "sum"), "l": (F.max("x"), "last")})
    got = {r[BL.BLOCK]: (r["s"], r["l"]) for r in out.collect()}
    assert got == {0: (None, None), 5: (0, 0), 4096: (1, 1), 4100: (3, 1), 9000: (6, 3)}


def test_null_groups_are_groups(spark):
    rows = [(k, float(i), 1) for k in (None, "a", "") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, v int")
    totals = BL.running_totals(df, ["k"], "x", ["v"], value_block(F.col("x")))
    assert sorted(((r["k"] is None, r["k"] or "", r["x"], r["cum_v"]) for r in totals.collect())) == sorted(
        (k is None, k or "", x, int(x) + 1) for k, x, _ in rows
    )
    numbered = BL.row_numbers(df, ["k"], ["x"], value_block(F.col("x")), "rn")
    assert sorted((r["k"] is None, r["k"] or "", r["rn"]) for r in numbered.collect()) == sorted((k is None, k or "", int(x) + 1) for k, x, _ in rows)
    middle = BL.exact_quantiles(df, ["k"], "x", {"m": 0.5}, value_block(F.col("x")))
    assert {r["k"]: r["m"] for r in middle.collect()} == {None: 2.0, "a": 2.0, "": 2.0}


def test_infinite_values_have_cells(spark):
    xs = [float("-inf"), -1e308, -1.0, 0.0, 1.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(x, 1) for x in xs], "x double, v int")
    cells = [r["b"] for r in df.select(value_block(F.col("x")).alias("b")).collect()]
    assert cells == sorted(cells) and len(set(cells)) == len(cells)
    got = BL.running_totals(df, [], "x", ["v"], value_block(F.col("x"))).orderBy("x").collect()
    assert [r["cum_v"] for r in got] == list(range(1, 9))
