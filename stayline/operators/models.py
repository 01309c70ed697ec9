"""Preprocessing, fits and scoring: linear models by `pyspark.ml`, boosted trees by `boosting`.

Fits read a frame whose lineage was cut (see `session.cut_lineage`) or a stored
design, so iterations never replay feature jobs. Statistics that enter a fit
are one row per frame, bounded by the number of columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.expr import hash_block, seeded_hash
from stayline.operators import boosting as BO
from stayline.operators.blocks import row_numbers
from stayline.operators.boosting import BoostParams, Ensemble
from stayline.operators.metrics import rank_metrics
from stayline.spec import CONFIG

VECTOR = "vector"


# -- preprocessing -----------------------------------------------------------------


def scaling_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, sd): measured values only, population SD after mean filling.

    Filling with the mean leaves the mean and shrinks the SD by the measured
    share, so both come from one aggregation.
    """
    stats = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(c).alias("mean"),
            (F.stddev_pop(c) * F.sqrt(F.count(c) / F.count(F.lit(1)))).alias("sd"),
        ).alias(f"_{i}")
        for i, c in enumerate(columns)
    ]
    row = train.agg(*stats)
    return row.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))


@dataclass(frozen=True)
class Standardizer:
    """Mean filling and scaling with train statistics."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> "Standardizer":
        """Columns never observed in train are left out."""
        rows = {r["feature"]: r for r in scaling_stats(train, columns).collect()}
        kept = [c for c in columns if rows[c]["mean"] is not None]
        return Standardizer(
            tuple(kept), tuple(rows[c]["mean"] for c in kept), tuple(rows[c]["sd"] for c in kept)
        )

    def z(self, column: str) -> Column:
        """Scaled value; a constant column is only centred."""
        i = self.columns.index(column)
        scale = self.sds[i] if self.sds[i] > 0 else 1.0
        return (F.coalesce(F.col(column), F.lit(self.means[i])) - F.lit(self.means[i])) / F.lit(scale)

    def apply(self, design: DataFrame) -> DataFrame:
        others = [c for c in design.columns if c not in self.columns]
        return design.select(*others, *[self.z(c).alias(c) for c in self.columns])

    def vectors(self, design: DataFrame) -> DataFrame:
        return design.withColumn(VECTOR, array_to_vector(F.array(*[self.z(c) for c in self.columns])))


def linear_score(
    design: DataFrame, scaler: Standardizer, weights: Mapping[str, float], intercept: float, keep: Sequence[str]
) -> DataFrame:
    """`keep` columns plus `score` of a logistic model with known weights.

    Scores are rounded to six places, so that the order of the sum does not
    decide a tie or a threshold.
    """
    margin = F.lit(float(intercept))
    for c in scaler.columns:
        margin = margin + scaler.z(c) * F.lit(float(weights.get(c, 0.0)))
    return design.select(*keep, F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), 6).alias("score"))


# -- fits --------------------------------------------------------------------------


@dataclass
class Fitted:
    """A model with the preprocessing and the column order it was fitted with."""

    prepare: Standardizer
    model: Model

    @property
    def columns(self) -> tuple[str, ...]:
        return self.prepare.columns

    def score(self, design: DataFrame, keep: Sequence[str]) -> DataFrame:
        """`keep` columns plus `score`, the probability of class 1."""
        ready = self.prepare.vectors(design.select(*keep, *[c for c in self.columns if c not in keep]))
        scored = self.model.transform(ready)
        return scored.select(*keep, vector_to_array("probability")[1].alias("score"))


def fit_logistic(train: DataFrame, columns: Sequence[str], label: str, max_iter: int = 2000) -> Fitted:
    """L2 logistic regression; strength 1 on the summed loss is 1/n on the mean loss."""
    prepare = Standardizer.fit(train, columns)
    n = train.count()
    learner = LogisticRegression(
        featuresCol=VECTOR, labelCol=label, maxIter=max_iter, regParam=1.0 / n,
        elasticNetParam=0.0, standardization=False,
    )
    return Fitted(prepare, learner.fit(prepare.vectors(train).select(VECTOR, label)))


def fit_boosted(train: DataFrame, columns: Sequence[str], label: str, params: BoostParams) -> Ensemble:
    """Boosted trees on the columns observed in train."""
    return BO.fit(train, BO.Binning.fit(train, columns), [params], label)[0]


def search(
    train: DataFrame,
    validation: DataFrame,
    columns: Sequence[str],
    label: str,
    candidates: Iterable[BoostParams],
) -> tuple[BoostParams, list[dict], dict[BoostParams, Ensemble]]:
    """Fit all candidates on train in the same passes over one binned design, rank on the fixed validation split.

    All are ranked in one grouped job. The best average precision wins, the
    first one on a tie.
    """
    tried = list(candidates)
    fitted = BO.fit(train, BO.Binning.fit(train, columns), tried, label)
    scored = BO.score(validation, {str(i): m for i, m in enumerate(fitted)}, [label])
    got = {r["model"]: r for r in rank_metrics(scored, ["model"], label).collect()}
    rows = [
        {
            "learning_rate": p.learning_rate, "leaves": p.leaves, "min_leaf_rows": p.min_leaf_rows,
            "auroc": got[str(i)]["auroc"], "auprc": got[str(i)]["auprc"],
        }
        for i, p in enumerate(tried)
    ]
    ranked = [(-r["auprc"], i) for i, r in enumerate(rows) if r["auprc"] is not None]
    if not ranked:
        raise ValueError("no candidate could be ranked: validation has one class")
    return tried[min(ranked)[1]], rows, dict(zip(tried, fitted))


def training_sets(design: DataFrame) -> dict[str, DataFrame]:
    """The three training sets are filters on `split`; A+B needs no copy."""
    return {
        "A": design.filter(F.col("split") == "a_train"),
        "B": design.filter(F.col("split") == "b_train"),
        "A+B": design.filter(F.col("split").isin("a_train", "b_train")),
    }


# -- artefacts -----------------------------------------------------------------------


def save(fitted: Fitted, path: str) -> None:
    """Model and its column order side by side, on any file system Spark writes."""
    fitted.model.write().overwrite().save(f"{path}/model")
    prepare = fitted.prepare
    doc = {"kind": type(prepare).__name__, **{k: list(v) for k, v in vars(prepare).items()}}
    _active().createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/columns")


def load(path: str) -> Fitted:
    spark = _active()
    doc = json.loads(spark.read.text(f"{path}/columns").first()["value"])
    doc.pop("kind")
    model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return Fitted(Standardizer(**{k: tuple(v) for k, v in doc.items()}), model)


def _active() -> SparkSession:
    return SparkSession.getActiveSession()


# -- importance -----------------------------------------------------------------------


def paired(design: DataFrame, columns: Sequence[str], keys: Sequence[str], seed: int = CONFIG.seed) -> DataFrame:
    """Each row with `_other`, the `columns` of the next row in a seeded order (the last row gets those of the first).

    The order is built over even hash cells, and the whole struct travels by one
    join on the rank, so neither a task nor a join more is needed for more columns.
    """
    h = seeded_hash(seed, *[F.col(k) for k in keys])
    ranked = row_numbers(design.withColumn("_h", h), [], ["_h", *keys], hash_block(F.col("_h")), "_r")
    n = design.count()
    other = ranked.select((F.pmod(F.col("_r"), F.lit(n)) + 1).alias("_r"), F.struct(*columns).alias("_other"))
    return ranked.join(other, "_r").drop("_r", "_h")


def permutation_importance(
    model: Ensemble, design: DataFrame, keys: Sequence[str], label: str, seed: int = CONFIG.seed
) -> DataFrame:
    """(feature, importance): drop in average precision when a column comes from another row; one grouped metric job."""
    frames = BO.permuted_scores(paired(design, model.columns, keys, seed), model, [label], "_other")
    got = rank_metrics(frames, ["feature"], label).select("feature", "auprc")
    # One row per column reaches this window.
    whole = F.max(F.when(F.col("feature") == "(none)", F.col("auprc"))).over(W.partitionBy())
    return (
        got.select("feature", (whole - F.col("auprc")).alias("importance"))
        .filter(F.col("feature") != "(none)")
    )


def linear_weights(fitted: Fitted) -> Mapping[str, float]:
    return dict(zip(fitted.columns, [float(w) for w in fitted.model.coefficients]))
