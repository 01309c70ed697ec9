"""Ordered work on groups of any size.

A window over a whole group sends the group to one task. Here a group is cut
into ordered blocks first: every block is a window partition of bounded size,
and what a row needs from earlier blocks arrives as a small per-block summary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.expr import COARSE_SHIFT

BLOCK = "_block"
COARSE = "_coarse"
HALO = "_halo"
BLOCK_HOURS = 512


def hour_block(hour: Column, size: int = BLOCK_HOURS) -> Column:
    return F.floor(hour / F.lit(size)).cast("bigint")


def block_hours(lookback: int) -> int:
    """Hours in a block for this lookback: a halo never takes more than half of a block's rows."""
    return max(BLOCK_HOURS, lookback + 1)


def with_halo(df: DataFrame, hour: str, lookback: int, size: int | None = None) -> DataFrame:
    """Add the hour block, and repeat the last `lookback` hours in the next block.

    `hour` is a dense 0-based position, so a trailing frame of up to
    `lookback + 1` rows is complete inside each block. Blocks are as long as
    `block_hours` says, or longer than the lookback if `size` is given.
    """
    size = block_hours(lookback) if size is None else max(size, lookback + 1)
    own = hour_block(F.col(hour), size)
    late = F.pmod(F.col(hour), F.lit(size)) >= F.lit(size - lookback)
    blocks = F.when(late, F.array(own, own + F.lit(1))).otherwise(F.array(own))
    return df.select("*", F.explode(blocks).alias(BLOCK)).withColumn(HALO, F.col(BLOCK) != own)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """One shuffle by `keys` into `spark.sql.shuffle.partitions` tasks, a number that Spark keeps.

    Without a number partitions are merged by their bytes in the shuffle, before
    a generator or a window makes them grow: hours of a mostly empty panel take
    many times that in memory, and a few spans or blocks hold all hours.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_blocks(rows: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of rows with a small summary of their blocks, both dealt out by `on`.

    Spark takes generated rows (hours, cells) for as few as the rows they are
    made from, and would send all of them to the driver to broadcast them.
    """
    return rows.join(summary.hint("shuffle_hash"), list(on))


def join_summary(rows: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join rows with a summary of the same rows by `on`; rows with a null key are left out.

    Every row has its summary, so nothing but the plan tells this from an inner
    join: as a left one it leaves Spark the choice to broadcast the summary, by
    its true size, but never the rows (see `join_blocks`).
    """
    known = rows
    for k in on:
        known = known.filter(F.col(k).isNotNull())
    return known.join(summary, list(on), "left")


def _cell(block: Column) -> Column:
    """A block number that cannot be null.

    Otherwise the joins below would push null filters into one branch only, and
    the branches could not share the exchange under them.
    """
    return F.coalesce(block.cast("bigint"), F.lit(0).cast("bigint"))


def plain_keys(df: DataFrame, keys: Sequence[str], nullable: set[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Add columns that stand for `keys` and are never null, and their names.

    A null key is a group like any other, but an equi-join would lose it, and a
    null-safe join could not share its partitioning with windows. Keys that
    cannot be null (by the schema, or not in `nullable`) stand for themselves.
    """
    names: list[str] = []
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        if k not in nullable if nullable is not None else not df.schema[k].nullable:
            names.append(k)
            continue
        numeric = isinstance(kind, T.NumericType)
        key = F.col(k) if numeric or isinstance(kind, T.StringType) else F.col(k).cast("string")
        zero = F.lit(0).cast(kind) if numeric else F.lit("")
        df = df.withColumn(f"_key{i}", F.coalesce(key, zero)).withColumn(f"_null{i}", F.col(k).isNull())
        names += [f"_key{i}", f"_null{i}"]
    return df, names


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where null equals null; columns of `left`, then the others of `right`."""
    rest = [c for c in right.columns if c not in keys]
    nullable = {k for k in keys if left.schema[k].nullable or right.schema[k].nullable}
    a, on = plain_keys(left, keys, nullable)
    b, _ = plain_keys(right, keys, nullable)
    return a.join(b.select(*on, *rest), on, how).select(*left.columns, *rest)


def prior_summary(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    summary: Mapping[str, tuple[Column, str]],
) -> DataFrame:
    """Per (keys, block): each summary folded over all earlier blocks.

    Keys must not be null (see `plain_keys`), as callers join on them.
    `summary` maps an output name to (aggregate, fold) with fold `sum` or
    `last` (latest non-null). Only block summaries reach a window, and those
    are folded in two levels (blocks, then groups of 4096 blocks).
    """
    folds = {n: fold for n, (_, fold) in summary.items()}
    per_block = (
        df.withColumn(BLOCK, _cell(block))
        .groupBy(*keys, BLOCK)
        .agg(*[agg.alias(n) for n, (agg, _) in summary.items()])
        .withColumn(COARSE, F.shiftright(F.col(BLOCK), COARSE_SHIFT))
        # Both levels read this exchange, so what lies under it runs once.
        .repartition(*keys, COARSE)
    )

    def folded(frame: DataFrame, partition: Sequence[str], by: str, prefix: str) -> DataFrame:
        w = W.partitionBy(*partition).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        over = {"sum": lambda n: F.sum(n).over(w), "last": lambda n: F.last(n, ignorenulls=True).over(w)}
        cols = [over[fold](n).alias(prefix + n) for n, fold in folds.items()]
        return frame.select(*dict.fromkeys([*partition, by]), *cols)

    totals = {
        "sum": lambda n: F.sum(n),
        "last": lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col(BLOCK))),
    }
    per_coarse = per_block.groupBy(*keys, COARSE).agg(*[totals[f](n).alias(n) for n, f in folds.items()])
    near = folded(per_block, [*keys, COARSE], BLOCK, "_f_")
    far = folded(per_coarse, keys, COARSE, "_c_")

    def joined(n: str, fold: str) -> Column:
        f, c = F.col("_f_" + n), F.col("_c_" + n)
        return F.coalesce(f + c, f, c) if fold == "sum" else F.coalesce(f, c)

    return near.join(far, [*keys, COARSE]).select(
        *keys, BLOCK, *[joined(n, fold).alias(n) for n, fold in folds.items()]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    block: Column,
    descending: bool = False,
    with_next: bool = False,
) -> DataFrame:
    """Exact inclusive running sums of `values` by `order` within `keys`.

    `df` holds one row per (keys, order): group equal order values before the
    call. `block` must not decrease with `order`. Sums run inside fine blocks;
    the offset of a fine block comes from its coarse block, and that of a
    coarse block from the group, so no window sees a whole group.
    Adds `cum_<value>`, and with `with_next` the following order value.
    """
    sort = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    fine, coarse = BLOCK, COARSE
    columns = df.columns
    df, keys = plain_keys(df, keys)
    cells = df.withColumn(fine, _cell(block)).withColumn(coarse, F.shiftright(F.col(fine), COARSE_SHIFT))
    edge = (F.max if descending else F.min)(order)

    def before(*partition, by):
        w = W.partitionBy(*partition).orderBy(sort(by))
        return w, w.rowsBetween(W.unboundedPreceding, -1)

    per_fine = cells.groupBy(*keys, coarse, fine).agg(
        *[F.sum(v).alias(v) for v in values], edge.alias("_edge")
    ).repartition(*keys, coarse)
    w_fine, fine_before = before(*keys, coarse, by=fine)
    in_coarse = per_fine.select(
        *keys, coarse, fine,
        *[F.coalesce(F.sum(v).over(fine_before), F.lit(0)).alias(f"_f_{v}") for v in values],
        F.lead("_edge").over(w_fine).alias("_next_f"),
    )
    per_coarse = per_fine.groupBy(*keys, coarse).agg(
        *[F.sum(v).alias(v) for v in values],
        (F.max if descending else F.min)("_edge").alias("_edge"),
    )
    w_coarse, coarse_before = before(*keys, by=coarse)
    in_group = per_coarse.select(
        *keys, coarse,
        *[F.coalesce(F.sum(v).over(coarse_before), F.lit(0)).alias(f"_c_{v}") for v in values],
        F.lead("_edge").over(w_coarse).alias("_next_c"),
    )
    offsets = in_coarse.join(in_group, [*keys, coarse]).select(
        *keys, fine,
        *[(F.col(f"_f_{v}") + F.col(f"_c_{v}")).alias(f"_off_{v}") for v in values],
        F.coalesce("_next_f", "_next_c").alias("_next_block"),
    )
    w = W.partitionBy(*keys, fine).orderBy(sort(order))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    out = cells.join(offsets, [*keys, fine])
    extra = (
        [F.coalesce(F.lead(order).over(w), F.col("_next_block")).alias(f"next_{order}")]
        if with_next
        else []
    )
    return out.select(
        *columns,
        *[(F.sum(v).over(upto) + F.col(f"_off_{v}")).alias(f"cum_{v}") for v in values],
        *extra,
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str
) -> DataFrame:
    """1-based row number by `order` within `keys`, block by block.

    `block` must not decrease with the first order column.
    """
    columns = df.columns
    df, keys = plain_keys(df, keys)
    cells = df.withColumn(BLOCK, _cell(block))
    offsets = prior_summary(df, keys, block, {"_off": (F.count(F.lit(1)), "sum")})
    w = W.partitionBy(*keys, BLOCK).orderBy(*order)
    return cells.join(offsets, [*keys, BLOCK]).select(
        *columns,
        (F.row_number().over(w) + F.coalesce("_off", F.lit(0))).cast("bigint").alias(name),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    block: Column,
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per group from value counts and running totals.

    `linear` interpolates between neighbours, `nearest` takes the closest rank
    (half up), `lower` the rank below.
    """
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    ranked = running_totals(counts, keys, value, ["n"], block)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - F.lit(1)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank <= last), F.col(value).cast("double")))

    aggs, outs = [F.sum("n").alias("n")], []
    for name, p in probs.items():
        target = F.lit(float(p)) * (F.col("_total") - F.lit(1))
        low, high = F.floor(target), F.ceil(target)
        if method == "nearest":
            low = high = F.floor(target + F.lit(0.5))
        elif method == "lower":
            high = low
        aggs += [
            at(low).alias(f"_lo_{name}"),
            at(high).alias(f"_hi_{name}"),
            F.max(target - F.floor(target)).alias(f"_w_{name}"),
        ]
        lo, hi, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        outs.append((lo + (hi - lo) * weight if method == "linear" else lo).alias(name))
    return join_groups(ranked, totals, keys).groupBy(*keys).agg(*aggs).select(*keys, "n", *outs)
