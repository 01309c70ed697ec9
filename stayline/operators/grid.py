"""Dense hourly grid: every hour from an entity's first to its last reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.operators.blocks import BLOCK, HALO, block_hours, deal, hour_block

FIRST, LAST = "_t0", "_t1"


def reading_blocks(hourly: DataFrame, keys: Sequence[str], time: str, lookback: int = 0) -> DataFrame:
    """The readings by blocks of `time`, each block opened by a row without values.

    Such a row stands at the first hour of the block or of its halo and holds
    the entity's first hour and the last one of the block. Readings of the last
    `lookback` hours of a block are repeated in the next one. Only these rows are
    shuffled; `fill_blocks` makes the hours from them.
    """
    size = block_hours(lookback)
    bounds = hourly.groupBy(*keys).agg(F.min(time).alias(FIRST), F.max(time).alias(LAST))
    blocks = F.sequence(hour_block(F.col(FIRST), size), hour_block(F.col(LAST), size))
    start = F.col(BLOCK) * F.lit(size)
    opened = bounds.select(*keys, FIRST, LAST, F.explode(blocks).alias(BLOCK)).select(
        *keys, BLOCK, F.greatest(start - F.lit(lookback), FIRST).alias(time),
        FIRST, F.least(start + F.lit(size - 1), LAST).alias(LAST),
    )
    own = hour_block(F.col(time), size)
    late = F.pmod(F.col(time), F.lit(size)) >= F.lit(size - lookback)
    among = F.when(late, F.array(own, own + F.lit(1))).otherwise(F.array(own))
    read = hourly.withColumn(BLOCK, F.explode(among))
    return deal(opened.unionByName(read, allowMissingColumns=True), *keys, BLOCK).withColumn(HALO, F.col(time) < start)


def fill_blocks(blocks: DataFrame, keys: Sequence[str], time: str, lookback: int = 0) -> DataFrame:
    """Every hour of every block and halo, with its position `hour` from the entity's first one.

    A row stands for the hours up to the next one, its values for the first of
    them. So no hour is shuffled, and no row makes more than a block of them.
    """
    w = W.partitionBy(*keys, BLOCK).orderBy(time, F.col(FIRST).isNull())
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    values = [c for c in blocks.columns if c not in (*keys, time, BLOCK, HALO, FIRST, LAST)]
    spans = blocks.select(
        *keys, BLOCK, F.col(time).alias("_from"), *values,
        F.first(FIRST).over(upto).alias(FIRST),
        F.coalesce(F.lead(time).over(w), F.first(LAST).over(upto) + F.lit(1)).alias("_next"),
    ).filter(F.col(FIRST).isNotNull() & (F.col("_next") > F.col("_from")))
    hours = spans.withColumn(time, F.explode(F.sequence("_from", F.col("_next") - F.lit(1))))
    read = F.col(time) == F.col("_from")
    return hours.select(
        *keys, time, (F.col(time) - F.col(FIRST)).cast("int").alias("hour"), *[F.when(read, F.col(c)).alias(c) for c in values],
        BLOCK, (F.col(time) < F.col(BLOCK) * F.lit(block_hours(lookback))).alias(HALO),
    )


def dense_grid(hourly: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The readings on the dense hours; `time` is a bigint hour, keys are not null."""
    return fill_blocks(reading_blocks(hourly, keys, time), keys, time).drop(BLOCK, HALO)
