"""Additive attributions: weight times scaled value of a linear model, path contributions of a tree model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.operators.boosting import Ensemble, row_contributions
from stayline.operators.models import Standardizer

TOP_GLOBAL = 15
TOP_LOCAL = 10


def contributions(scaler: Standardizer, weights: Mapping[str, float]) -> Column:
    """Array of (feature, contribution) of a row."""
    return F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (scaler.z(c) * F.lit(float(w))).alias("contribution"))
            for c, w in weights.items()
        ]
    )


def global_attribution(
    design: DataFrame,
    scaler: Standardizer,
    weights: Mapping[str, float],
    by: Sequence[str],
    top: int = TOP_GLOBAL,
) -> DataFrame:
    """Mean absolute contribution per feature and group, largest first.

    Aggregated as columns in one pass; only (group, feature) rows are ranked.
    """
    aggs = [
        F.struct(
            F.lit(c).alias("feature"), F.avg(F.abs(scaler.z(c) * F.lit(float(w)))).alias("mean_abs")
        ).alias(f"_{i}")
        for i, (c, w) in enumerate(weights.items())
    ]
    long = design.groupBy(*by).agg(*aggs).select(
        *by, F.inline(F.array(*[f"_{i}" for i in range(len(aggs))]))
    )
    w = W.partitionBy(*by).orderBy(F.col("mean_abs").desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def local_attribution(
    design: DataFrame,
    scaler: Standardizer,
    weights: Mapping[str, float],
    keep: Sequence[str],
    top: int = TOP_LOCAL,
) -> DataFrame:
    """The `top` largest contributions of every row, by size then name.

    Sorted inside the row, so nothing is shuffled.
    """
    sized = F.transform(
        contributions(scaler, weights),
        lambda f: F.struct(
            (-F.abs(f["contribution"])).alias("o"), f["feature"].alias("feature"),
            f["contribution"].alias("contribution"),
        ),
    )
    best = F.slice(F.array_sort(sized), 1, top)
    return design.select(*keep, F.posexplode(best)).select(
        *keep, (F.col("pos") + 1).alias("rank"),
        F.col("col.feature").alias("feature"), F.col("col.contribution").alias("contribution"),
    )


def first_cases(scored: DataFrame, order: Sequence[str], threshold: float) -> DataFrame:
    """First true and first false positive at the threshold, in row order."""
    hit = F.col("score") >= F.lit(threshold)
    kind = F.when(hit & (F.col("label") == 1), "true_positive").when(hit, "false_positive")
    row = F.struct(*order)
    found = scored.withColumn("case", kind).filter(F.col("case").isNotNull())
    return found.groupBy("case").agg(F.min_by(F.struct(*order, "score"), row).alias("_r")).select("case", "_r.*")


def tree_attribution(design: DataFrame, model: Ensemble, keep: Sequence[str], top: int = TOP_LOCAL) -> DataFrame:
    """The `top` largest contributions of every row along the paths of a tree model, by size then name.

    What a column adds is the change of the node values at its splits; all of them
    and the model's bias add up to the margin. Sorted inside the row.
    """
    names = F.array(*[F.lit(c) for c in model.columns])
    sized = F.zip_with(
        names, F.col("_parts"), lambda f, v: F.struct((-F.abs(v)).alias("o"), f.alias("feature"), v.alias("contribution"))
    )
    best = F.slice(F.array_sort(sized), 1, top)
    return row_contributions(design, model, keep).select(*keep, F.posexplode(best)).select(
        *keep, (F.col("pos") + 1).alias("rank"),
        F.col("col.feature").alias("feature"), F.col("col.contribution").alias("contribution"),
    )
