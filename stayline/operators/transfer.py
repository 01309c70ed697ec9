"""Transfer curve: adapt a base score with n entities of the other site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import hash_block, seeded_hash
from stayline.operators import boosting as BO
from stayline.operators.blocks import join_groups, row_numbers
from stayline.operators.cohort import assert_adaptation_disjoint, draw_seed
from stayline.operators.isotonic import calibrate, fit_pools
from stayline.operators.metrics import evaluate, with_onset
from stayline.session import cut_lineage
from stayline.spec import CONFIG, PanelSpec

#: Scores are kept this far from 0 and 1 before their log odds are taken.
EDGE = 1e-9
ONSET = "_onset"


def calibration_arms(arms: dict[str, DataFrame], entity: Sequence[str]) -> DataFrame:
    """Stack scored frames under an `arm` column, ready for grouped metrics."""
    frames = [
        f.select(*entity, "hour", "label", "score").withColumn("arm", F.lit(name))
        for name, f in arms.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def margin(score: Column) -> Column:
    """Log odds of a score, from which boosting can go on."""
    p = F.least(F.greatest(score, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (F.lit(1.0) - p))


def curve_draws(adapt: DataFrame, spec: PanelSpec, sizes: Sequence[int], draws: int, seed: int = CONFIG.seed) -> DataFrame:
    """(n, draw, entity): whole entities without replacement for every size and draw, ranked in one plan.

    The same entities as `cohort.draw_entities` takes with the seed of the draw; a
    size beyond all entities gets as many as there are.
    """
    grid = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("draw"), F.lit(draw_seed(n, d, seed)).alias("_seed")) for n in sizes for d in range(draws)])
    ids = adapt.select(*spec.key).distinct().select(*spec.key, F.inline(grid))
    ids = ids.withColumn("_h", seeded_hash(F.col("_seed"), F.col(spec.entity)))
    ranked = row_numbers(ids, ["n", "draw"], ["_h", *spec.key], hash_block(F.col("_h")), "_rank")
    return ranked.where(F.col("_rank") <= F.col("n")).select("n", "draw", *spec.key)


def of_draws(adapt: DataFrame, drawn: DataFrame, spec: PanelSpec) -> DataFrame:
    """The rows of the drawn entities, once for each row of `drawn` with their key.

    The draws are broadcast: they have at most sizes x draws x the largest size rows,
    while a stored frame of many rows may be a file small enough for Spark to broadcast that.
    """
    return adapt.join(F.broadcast(drawn), spec.key)


def recalibrated(adapt: DataFrame, evaluation: DataFrame, drawn: DataFrame, spec: PanelSpec, cells: Sequence[tuple[int, int]]) -> DataFrame:
    """(n, draw, key, hour, label, _onset, score) of `evaluation`, calibrated on the rows of each draw; all draws in the same jobs.

    Distinct scores are calibrated for all draws first and stored, so that what reads
    the rows has no plan of the calibration in it; a row becomes one for each draw
    after it has found those of its score.
    """
    by = ["n", "draw"]
    pools = fit_pools(of_draws(adapt.select(*spec.key, "score", "label"), drawn, spec), keys=by)
    every = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("draw")) for n, d in cells])
    asked = evaluation.select("score").distinct().select("score", F.col("score").alias("_base"), F.inline(every))
    each = cut_lineage(calibrate(pools, asked, by).groupBy("_base").agg(F.collect_list(F.struct(*by, "score")).alias("_draws")))
    rows = evaluation.select(*spec.key, "hour", "label", ONSET, F.col("score").alias("_base"))
    return join_groups(rows, each, ["_base"], "left").select(*spec.key, "hour", "label", ONSET, F.inline("_draws"))


def fine_tuned(
    adapt: DataFrame, evaluation: DataFrame, drawn: DataFrame, spec: PanelSpec, cells: Sequence[tuple[int, int]],
    columns: Sequence[str], params: BO.BoostParams,
) -> DataFrame:
    """The same by boosting on from the base margin, a model for each draw, all of them in the same passes."""
    of_cell = F.create_map(*[x for i, (n, d) in enumerate(cells) for x in (F.struct(F.lit(n).alias("n"), F.lit(d).alias("draw")), F.lit(i))])
    number = F.element_at(of_cell, F.struct("n", "draw"))
    members = drawn.groupBy(*spec.key).agg(F.collect_list(number).alias("_models"))
    rows = adapt.withColumn("_margin", margin(F.col("score")))
    models = BO.fit(
        of_draws(rows, members, spec), BO.Binning.fit(adapt, columns), [params] * len(cells), base="_margin", members="_models"
    )
    named = {f"{n}:{d}": m for (n, d), m in zip(cells, models)}
    scored = BO.score(evaluation.withColumn("_margin", margin(F.col("score"))), named, [*spec.key, "hour", "label", ONSET], base="_margin")
    part = F.split("model", ":")
    return scored.select(part[0].cast("int").alias("n"), part[1].cast("int").alias("draw"), *spec.key, "hour", "label", ONSET, "score")


def transfer_curve(
    adapt: DataFrame,
    evaluation: DataFrame,
    spec: PanelSpec,
    columns: Sequence[str],
    threshold: float,
    n_values: Sequence[int] = CONFIG.transfer_n,
    draws: int = CONFIG.transfer_draws,
    params: BO.BoostParams = BO.BoostParams(rounds=CONFIG.fine_tune_rounds),
    seed: int = CONFIG.seed,
    modes: Sequence[str] = ("recalib", "finetune"),
) -> DataFrame:
    """Average precision and utility by (n, draw, mode) at the frozen threshold, and how many entities were drawn.

    `adapt` and `evaluation` carry features, label, hour and the base `score`;
    both should be stored frames, and no entity may be in both. All sizes and
    draws are fitted together and evaluated in one job; the unadapted score (n = 0)
    is evaluated once for all its draws. A size that `adapt` cannot fill is a row
    with the number of entities at hand and without metrics.
    """
    entity = spec.key
    assert_adaptation_disjoint(adapt, evaluation, spec)
    available = adapt.select(*entity).distinct().count()
    sizes = [n for n in n_values if 0 < n <= available]
    cells = [(n, d) for n in sizes for d in range(draws)]
    head = ["n", "draw", "mode", *entity, "hour", "label", ONSET, "score"]
    evaluation = with_onset(evaluation, entity, name=ONSET)  # the labels of all draws are the same
    frames = evaluation.select(F.lit(0).alias("n"), F.lit(0).alias("draw"), F.lit("base").alias("mode"), *head[3:])
    if cells:
        drawn = cut_lineage(curve_draws(adapt, spec, sizes, draws, seed))
        for mode in modes:
            adapted = (
                recalibrated(adapt, evaluation, drawn, spec, cells)
                if mode == "recalib"
                else fine_tuned(adapt, evaluation, drawn, spec, cells, columns, params)
            )
            frames = frames.unionByName(adapted.withColumn("mode", F.lit(mode)).select(*head))
    record = evaluate(frames, ["n", "draw", "mode"], F.lit(float(threshold)), entity, ONSET)
    every = F.array(*[F.struct(F.lit(d).alias("draw"), F.lit(m).alias("mode")) for d in range(draws) for m in modes])
    own = F.array(F.struct("draw", "mode"))
    each = record.withColumn("_e", F.explode(F.when(F.col("mode") == "base", every).otherwise(own)))
    found = each.select("n", "_e.draw", "_e.mode", F.col("n").cast("bigint").alias("n_drawn"), "auprc", "utility").where(
        F.lit(0 in n_values) | (F.col("n") > 0)
    )
    unfilled = [n for n in n_values if n > available]
    if not unfilled:
        return found
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("draw"), F.lit(m).alias("mode")) for n in unfilled for d in range(draws) for m in modes])
    none = F.lit(None).cast("double")
    missing = adapt.sparkSession.range(0, 1, 1, 1).select(F.inline(rows))
    return found.unionByName(missing.select("n", "draw", "mode", F.lit(available).cast("bigint").alias("n_drawn"), none.alias("auprc"), none.alias("utility")))
