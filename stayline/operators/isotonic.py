"""Isotonic calibration by pooling adjacent violators on Spark.

Rows collapse to distinct scores, these are cut into blocks of bounded size, and
each block is pooled in a task of its own. Two neighbouring blocks are right as
they are if the last pool of the one lies below the first pool of the other;
where they do not, they are joined and pooled again, until nothing moves. Pooling
pools gives the same as pooling their points, so the result is that of one pass
over everything. Pools stay on the executors; a calibrated score is found by
carrying the nearest knots along the order of the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.expr import value_block
from stayline.operators.blocks import BLOCK, join_groups, plain_keys, prior_summary, running_totals
from stayline.session import cut_lineage, drop_table

#: Distinct scores pooled in one task at first.
POINTS = 10_000


def pool(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[list, list, list, list]:
    """Pool points or pools in order of their scores: a mean that is not above the one before is merged with it."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    lows, highs, totals, weights = out
    for a, b, t, w in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist()):
        while totals and totals[-1] * w >= t * weights[-1]:
            a, t, w = lows.pop(), t + totals.pop(), w + weights.pop()
            highs.pop()
        lows.append(a)
        highs.append(b)
        totals.append(t)
        weights.append(w)
    return out


def _pooled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each block pooled; `rows` has keys, block, low, high, total, weight."""
    held = [*keys, "block"]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("low")
        got = pool(*(block[c].to_numpy() for c in ("low", "high", "total", "weight")))
        out = pd.DataFrame(dict(zip(("low", "high", "total", "weight"), got)))
        for i, c in enumerate(held):
            out.insert(i, c, [block[c].iloc[0]] * len(out))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*held, "low", "high", "total", "weight").schema)
    return rows.select(*held, "low", "high", "total", "weight").groupBy(*held).applyInPandas(run, schema)


def _merged(pools: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, block, joined): blocks whose border is violated get the number of the first of their run."""
    mean = F.col("total") / F.col("weight")
    edges = pools.groupBy(*keys, "block").agg(F.min_by(mean, "low").alias("_first"), F.max_by(mean, "low").alias("_last"))
    in_order = W.partitionBy(*keys).orderBy("block")
    apart = F.coalesce(F.col("_first") > F.lag("_last").over(in_order), F.lit(True))
    first = F.last(F.when(F.col("_apart"), F.col("block")), ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    return edges.withColumn("_apart", apart).select(*keys, "block", first.alias("joined"))


def fit_pools(scored: DataFrame, label: str = "label", keys: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """(keys, low, high, value): the pools of every group of `scored` (keys, score, label), rising in both.

    Rows without a score or label are left out; null keys are a group. Empty
    input gives no pools.
    """
    used = scored.where(F.col("score").isNotNull() & F.col(label).isNotNull())
    marked, on = plain_keys(used.select(*keys, "score", F.col(label).cast("bigint").alias("_y")), keys)
    counted = marked.groupBy(*on, "score").agg(
        F.sum("_y").alias("total"), F.count(F.lit(1)).alias("weight"), F.lit(1).alias("_one"), *[F.first(k).alias(k) for k in keys if k not in on]
    )
    ranked = running_totals(counted, on, "score", ["_one"], value_block(F.col("score")))
    given = list(dict.fromkeys([*keys, *on]))
    rows = ranked.select(
        *given, F.floor((F.col("cum__one") - 1) / F.lit(points)).cast("bigint").alias("block"),
        F.col("score").cast("double").alias("low"), F.col("score").cast("double").alias("high"), "total", "weight",
    )
    pools = cut_lineage(_pooled(rows, given))
    while True:
        moves = cut_lineage(_merged(pools, given if on == list(keys) else on))
        if not moves.where("block <> joined").limit(1).count():
            drop_table(moves)
            break
        joined = pools.join(moves, [*on, "block"]).drop("block").withColumnRenamed("joined", "block")
        after = cut_lineage(_pooled(joined, given))
        drop_table(pools)
        drop_table(moves)
        pools = after
    return pools.select(*keys, "low", "high", (F.col("total") / F.col("weight")).alias("value"))


def calibrate(pools: DataFrame, scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`scored` with the calibrated score in place of `score`.

    Inside a pool a score has the pool's value, between two pools it lies on the
    line between them, outside all of them it has the value of the nearest. A
    group without pools, and a null score, give null.
    """
    names = list(keys)
    ends = F.explode(F.array("low", "high"))
    knots = pools.select(*names, ends.alias("_x"), F.col("value").alias("_y")).withColumn("_asked", F.lit(0))
    asked = scored.where("score IS NOT NULL").select(*names, F.col("score").cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_asked"))
    marked, on = plain_keys(knots.unionByName(asked), names)
    both = marked.groupBy(*on, "_x").agg(F.max("_y").alias("_y"), F.max("_asked").alias("_asked"), *[F.first(k).alias(k) for k in names if k not in on])
    knot = F.when(F.col("_y").isNotNull(), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    cell = value_block(F.col("_x"), 12)
    both = both.withColumn("_knot", knot).withColumn("_cell", cell)
    at = F.when(F.col("_y").isNotNull(), F.col("_x"))
    below = prior_summary(both, on, F.col("_cell"), {"_under": (F.max_by("_knot", at), "last")}).withColumnRenamed(BLOCK, "_cell")
    above = prior_summary(both, on, -F.col("_cell"), {"_over": (F.min_by("_knot", at), "last")}).withColumn("_cell", -F.col(BLOCK)).drop(BLOCK)
    rows = both.join(below, [*on, "_cell"]).join(above, [*on, "_cell"])
    cells = W.partitionBy(*on, "_cell").orderBy("_x")
    low = F.coalesce(F.last("_knot", ignorenulls=True).over(cells.rowsBetween(W.unboundedPreceding, 0)), F.col("_under"))
    high = F.coalesce(F.first("_knot", ignorenulls=True).over(cells.rowsBetween(0, W.unboundedFollowing)), F.col("_over"))
    placed = rows.select(*names, "_x", "_asked", low.alias("_low"), high.alias("_high")).where("_asked = 1")
    share = (F.col("_x") - F.col("_low.x")) / F.when(F.col("_high.x") > F.col("_low.x"), F.col("_high.x") - F.col("_low.x"))
    line = F.col("_low.y") + F.coalesce(share, F.lit(0.0)) * (F.col("_high.y") - F.col("_low.y"))
    value = F.coalesce(line, F.col("_low.y"), F.col("_high.y"))
    table = placed.select(*names, F.col("_x").alias("_score"), value.alias("_calibrated"))
    kept = [c for c in scored.columns if c != "score"]
    return join_groups(scored.withColumn("_score", F.col("score").cast("double")), table, [*names, "_score"], "left").select(*kept, F.col("_calibrated").alias("score"))
