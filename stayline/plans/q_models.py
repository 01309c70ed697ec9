"""Preprocessing, fits, scoring and attribution."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators import attribution as AT
from stayline.operators import boosting as BO
from stayline.operators import cohort as CO
from stayline.operators import compare as CP
from stayline.operators import features as FT
from stayline.operators import isotonic as IS
from stayline.operators import metrics as M
from stayline.operators import models as MD
from stayline.operators import study as ST
from stayline.operators import transfer as TR
from stayline.plans import bindings as B
from stayline.plans.q_features import COLUMNS, MINIMAL
from stayline.plans.registry import register
from stayline.plans.sql import PANEL, SCORED, calibrated_sql, isotonic_sql, num, ranks, splits, utility
from stayline.session import cut_lineage, driver_folder, shared_folder
from stayline.sources import ledger as LG
from stayline.sources.stages import stage

KEYS = ["site", "user_id", "hour"]
DESIGN = PANEL + splits() + f""",
design AS (SELECT m.*, split FROM (SELECT site, user_id, hour, label, {MINIMAL} FROM panel) m JOIN splits USING (site, user_id)),
train AS (SELECT * FROM design WHERE split = 'a_train')"""
_FILLED = ", ".join(f"coalesce(d.{c}, m.{c}) AS {c}" for c in COLUMNS)
_MEANS = ", ".join(f"avg({c}) AS {c}" for c in COLUMNS)
_STATS = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in COLUMNS)
STATS = DESIGN.replace("design AS (", "design AS MATERIALIZED (") + f""", means AS MATERIALIZED (SELECT {_MEANS} FROM train),
filled AS (SELECT {_FILLED} FROM train d, means m), stats AS MATERIALIZED (SELECT {_STATS} FROM filled)"""
_Z = {c: f"(coalesce({c}, {c}_m) - {c}_m) / CASE WHEN {c}_s > 0 THEN {c}_s ELSE 1 END" for c in COLUMNS}

SPLIT_SCORED = SCORED + splits() + ", sp AS (SELECT scored.*, split FROM scored JOIN splits USING (site, user_id))"

# A fixed, readable set of weights, so that attributions have exact counterparts.
WEIGHTS = {c: ((i % 7) - 3) / 10 + 0.05 for i, c in enumerate(COLUMNS)}


def design(spark, sf) -> DataFrame:
    return FT.minimal_features(B.cohort_blocks(spark, sf, 0, split=True), B.EVENTS, ["split"])


def stored_design(spark, sf) -> DataFrame:
    """The design of a driver, one for all queries on the same rows and columns."""
    columns = [*dict.fromkeys([*B.EVENTS.side, *COLUMNS, "split"])]
    rows = {"events": B.table(spark, sf, "events").select("user_id", "ts", "event_type", "value")}
    return stage(spark, driver_folder(spark, "stages"), "design", rows, columns, lambda: design(spark, sf).select(*columns))


#: With it about a tenth of the hours lie above the frozen thresholds.
INTERCEPT = -0.5
_MARGIN = " + ".join(f"({_Z[c]}) * {num(w)}" for c, w in WEIGHTS.items())
MODEL = STATS + f""", scored AS (SELECT site, user_id, hour, CAST(clock AS BIGINT) AS clock, label, split,
  round(1 / (1 + exp(-({num(INTERCEPT)} + {_MARGIN}))), 6) AS score FROM design, stats)"""


def model_scored(spark, sf) -> DataFrame:
    """All hours scored by the fixed weights, the same that the attributions use."""
    rows = stored_design(spark, sf)
    scaler = MD.Standardizer.fit(part(rows, "a_train"), COLUMNS)
    keep = [*KEYS, F.col("clock").cast("bigint").alias("clock"), "label", "split"]
    return MD.linear_score(rows, scaler, WEIGHTS, INTERCEPT, keep)


def part(rows: DataFrame, split: str) -> DataFrame:
    return rows.filter(F.col("split") == split)


@register(
    "e1_scaling_stats",
    STATS + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({c}_m, 6) AS mean, round({c}_s, 6) AS sd FROM stats" for c in COLUMNS),
)
def e1_stats(spark, sf):
    return MD.scaling_stats(part(design(spark, sf), "a_train"), COLUMNS)


@register(
    "e1_standardised",
    STATS + " SELECT site, user_id, hour, label, split, " + ", ".join(f"round({z}, 6) AS {c}" for c, z in _Z.items()) + " FROM design, stats",
)
def e1(spark, sf):
    rows = stored_design(spark, sf)  # read by the fit and by the scaling
    return MD.Standardizer.fit(part(rows, "a_train"), COLUMNS).apply(rows)


@register("e2_logistic_baseline")
def e2(spark, sf):
    rows = stored_design(spark, sf)
    fitted = MD.fit_logistic(part(rows, "a_train"), COLUMNS, "label")
    scored = fitted.score(part(rows, "a_val"), [*KEYS, "label"])
    return M.evaluate(scored, ["site"], F.lit(0.5), B.ENTITY)


# -- boosted trees -----------------------------------------------------------------

BIN_EDGES = DESIGN + ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM train WHERE {c} IS NOT NULL" for c in COLUMNS) + f"""),
seen AS (SELECT feature, x, count(*) AS n FROM long GROUP BY feature, x),
summed AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY x) AS upto, sum(n) OVER (PARTITION BY feature) AS total FROM seen),
edges AS (SELECT feature, x AS edge FROM summed
  WHERE upto * {BO.BINS} // total > (upto - n) * {BO.BINS} // total AND upto < total)"""


@register("e3_bin_edges", BIN_EDGES + " SELECT feature, round(edge, 6) AS edge FROM edges")
def e3_edges(spark, sf):
    return BO.bin_edges(part(design(spark, sf), "a_train"), COLUMNS)


_COUNTED = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST(CASE WHEN {c} IS NULL THEN 0
    ELSE 1 + len(list_filter(coalesce((SELECT list(edge) FROM edges WHERE feature = '{c}'), []), lambda e: e < {c})) END AS INTEGER) AS bin, label FROM train"""
    for c in COLUMNS
)


@register(
    "e3_root_histogram",
    BIN_EDGES + f""", p AS (SELECT avg(label) AS p FROM train), cells AS ({_COUNTED})
SELECT feature, bin, count(*) AS n, CAST(sum(round((p - label) * {BO.STEPS})) AS BIGINT) AS g, CAST(sum(round(p * (1 - p) * {BO.STEPS})) AS BIGINT) AS h
FROM cells, p GROUP BY feature, bin""",
)
def e3_histogram(spark, sf):
    """The sums of the first round by column and bin, from which the root of the first tree is split."""
    rows = part(stored_design(spark, sf), "a_train")
    binning = BO.Binning.fit(rows, COLUMNS)
    got = BO.first_histogram(rows, binning, "label")
    names = F.array(*[F.lit(c) for c in binning.columns])
    at = F.floor(F.col("cell") / F.lit(binning.width)).cast("int")
    return got.select(names[at].alias("feature"), (F.col("cell") % F.lit(binning.width)).cast("int").alias("bin"), "n", "g", "h")


_FITTED: dict[tuple, BO.Ensemble] = {}


def study_trees(rows: DataFrame, sf: str) -> BO.Ensemble:
    """The study's boosted model of site A; queries of one session over the same tables share it."""
    key = (rows.sparkSession.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED[key] = MD.fit_boosted(part(rows, "a_train"), COLUMNS, "label", BO.BoostParams())
    return _FITTED[key]


@register("e3_boosted_trees")
def e3(spark, sf):
    """600 trees as in the study."""
    rows = stored_design(spark, sf)
    scored = cut_lineage(BO.score(part(rows, "a_val"), {"A": study_trees(rows, sf)}, [*KEYS, "label"]))  # read four times
    return M.evaluate(scored, ["site"], F.lit(0.5), B.ENTITY)


#: Trees of each setting of the registered search; the study grows 600 (see the README for the time they take).
GRID_ROUNDS = 200


@register("e4_grid_search")
def e4(spark, sf):
    """All 18 settings of the study over one binned design, grown in the same passes."""
    rows = stored_design(spark, sf)
    tried = BO.grid(rounds=GRID_ROUNDS)
    best, table, _ = MD.search(part(rows, "a_train"), part(rows, "a_val"), COLUMNS, "label", tried)
    marked = [
        {**t, "chosen": int((t["learning_rate"], t["leaves"], t["min_leaf_rows"]) == (best.learning_rate, best.leaves, best.min_leaf_rows))}
        for t in table
    ]
    return spark.createDataFrame(
        marked, "learning_rate double, leaves int, min_leaf_rows int, auroc double, auprc double, chosen int"
    )


@register("e5_training_sets")
def e5(spark, sf):
    """One model per training set, each scored on site A validation."""
    rows = stored_design(spark, sf)
    frames = None
    for name, train in MD.training_sets(rows).items():
        fitted = MD.fit_logistic(train, COLUMNS, "label")
        one = fitted.score(part(rows, "a_val"), [*KEYS, "label"]).withColumn("model", F.lit(name))
        frames = one if frames is None else frames.unionByName(one)
    return M.evaluate(frames, ["model"], F.lit(0.5), B.ENTITY)


@register("e6_batch_scores")
def e6(spark, sf):
    rows = stored_design(spark, sf)
    fitted = MD.fit_logistic(part(rows, "a_train"), COLUMNS, "label")
    return fitted.score(part(rows, "b_eval"), [*KEYS, "label"])


@register(
    "e6_fixed_weight_scores",
    MODEL + " SELECT site, user_id, hour, label, round(score, 6) AS score FROM scored WHERE split = 'b_eval'",
)
def e6_fixed(spark, sf):
    return part(model_scored(spark, sf), "b_eval").select(*KEYS, "label", "score")


@register(
    "e7_isotonic",
    SPLIT_SCORED + isotonic_sql("fit", "SELECT score AS x, label AS y FROM sp WHERE split = 'a_train'")
    + calibrated_sql("out", "SELECT site, user_id, hour, label, split, score FROM sp WHERE split = 'a_val'", "fit")
    + " SELECT site, user_id, hour, label, split, round(score, 6) AS score FROM out",
)
def e7(spark, sf):
    rows = cut_lineage(B.scored_splits(spark, sf).select(*B.ENTITY, "hour", "label", "score", "split"))
    return IS.calibrate(IS.fit_pools(part(rows, "a_train")), part(rows, "a_val"))


@register("e8_second_stage")
def e8(spark, sf):
    """200 more rounds of boosting from the base margin, on the smallest draw of the study from site B that it fills, next to the base."""
    columns = ["n_events", "n72", "ecum"]
    rows = cut_lineage(B.event_panel(spark, sf, scores=True, split=True).select(*KEYS, "label", "score", *columns, "split"))
    adapt, evaluation = part(rows, "b_train").drop("split"), part(rows, "b_eval").drop("split")
    return TR.transfer_curve(adapt, evaluation, B.EVENTS, columns, B.FROZEN["A"], n_values=(0, 50), draws=1, modes=("finetune",))


# -- the study's matrix ---------------------------------------------------------------

SETS = {"A": ("a_train",), "B": ("b_train",), "A+B": ("a_train", "b_train")}
#: Fixed weights of the three models: those above, the same in reverse order, and their mean.
SET_WEIGHTS = {
    "A": WEIGHTS,
    "B": dict(zip(COLUMNS, reversed(WEIGHTS.values()))),
    "A+B": {c: (w + v) / 2 for c, w, v in zip(COLUMNS, WEIGHTS.values(), reversed(WEIGHTS.values()))},
}


def _set_sql(i: int, name: str) -> str:
    splits_of = ", ".join(f"'{s}'" for s in SETS[name])
    margin = " + ".join(f"({_Z[c]}) * {num(w)}" for c, w in SET_WEIGHTS[name].items())
    return f""",
train{i} AS MATERIALIZED (SELECT * FROM design WHERE split IN ({splits_of})),
filled{i} AS (SELECT {_FILLED} FROM train{i} d, (SELECT {_MEANS} FROM train{i}) m),
stats{i} AS MATERIALIZED (SELECT {_STATS} FROM filled{i}),
scored{i} AS (SELECT '{name}' AS model, split, site, user_id, hour, label, round(1 / (1 + exp(-({num(INTERCEPT)} + {margin}))), 6) AS score
  FROM design, stats{i} WHERE split IN ('a_val', 'b_eval'))"""


_CELL = "CASE " + " ".join(f"WHEN model = '{m}' AND split = '{s}' THEN '{c}'" for c, m, s in CP.CELLS) + " END"
STUDY = DESIGN.replace("design AS (", "design AS MATERIALIZED (") + "".join(_set_sql(i, n) for i, n in enumerate(SETS)) + f""",
sm AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM scored{i}" for i in range(len(SETS)))}),
val AS (SELECT model, site, user_id, hour, label, score, k / 100e0 AS t0 FROM sm, range(1, 100) r(k) WHERE split = 'a_val')""" + utility(
    "val", "t0", "model, t0, site, user_id", "v_"
) + f""", tried AS (SELECT model, t0, (sum(u) - sum(u0)) / nullif(sum(ubest) - sum(u0), 0) AS gain FROM v_util GROUP BY model, t0),
frozen AS (SELECT model, t0 AS threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(gain, 9) DESC, t0) AS r FROM tried WHERE gain IS NOT NULL) WHERE r = 1),
cells AS (SELECT {_CELL} AS cell, threshold, site, user_id, hour, label, score FROM sm JOIN frozen USING (model) WHERE {_CELL} IS NOT NULL)"""


@register(
    "g1_model_matrix",
    STUDY + ranks("cells", "cell") + utility("cells", "threshold", "cell, site, user_id") + """,
m AS (SELECT cell, max(threshold) AS threshold, count(DISTINCT user_id) AS n_patients, count(*) AS n_hours, sum(label) AS p,
  (sum(u) - sum(u0)) / nullif(sum(ubest) - sum(u0), 0) AS utility FROM util GROUP BY cell)
SELECT cell, threshold, n_patients, n_hours, round(m.p / CAST(n_hours AS DOUBLE), 6) AS prevalence, round(utility, 6) AS utility,
  round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM m JOIN (SELECT cell, auroc, auprc FROM ranked) USING (cell)""",
)
def g1_models(spark, sf):
    """Three fixed-weight models scored once, their thresholds frozen on A validation, the five cells in one plan."""
    rows = stored_design(spark, sf)
    held = rows.filter(F.col("split").isin("a_val", "b_eval"))
    scored = None
    for name, splits_of in SETS.items():
        scaler = MD.Standardizer.fit(rows.filter(F.col("split").isin(*splits_of)), COLUMNS)
        one = MD.linear_score(held, scaler, SET_WEIGHTS[name], INTERCEPT, [*KEYS, "label", "split"]).withColumn("model", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    return ST.study_matrix(cut_lineage(scored), B.EVENTS).select(*MATRIX)


MATRIX = ("cell", "threshold", "n_patients", "n_hours", "prevalence", "utility", "auroc", "auprc")


@register("g1_fitted_matrix")
def g1_fitted(spark, sf):
    """The same with boosted models fitted on the three training sets in the same passes, scored once through the ledger."""
    rows = stored_design(spark, sf)
    CO.assert_disjoint(rows.select(*B.EVENTS.key, "split"), B.EVENTS)
    own = F.filter(F.array(*[F.when(F.col("split").isin(*s), F.lit(i)) for i, s in enumerate(SETS.values())]), lambda m: m.isNotNull())
    train = rows.filter(F.col("split").isin("a_train", "b_train")).withColumn("_models", own)
    fitted = dict(zip(SETS, BO.fit(train, BO.Binning.fit(train, COLUMNS), [BO.BoostParams()] * len(SETS), members="_models")))
    keep = [*KEYS, "label", "split"]
    validation = cut_lineage(BO.score(part(rows, "a_val"), fitted, keep))  # read four times
    thresholds = {r["model"]: r["threshold"] for r in ST.frozen_thresholds(validation, B.ENTITY).collect()}
    evaluation = CO.held_out(part(rows, "b_eval"), B.EVENTS)
    current = LG.fingerprint({
        "model": {n: m.to_json() for n, m in fitted.items()}, "threshold": thresholds, "columns": COLUMNS,
        "rows": LG.data_fingerprint(evaluation, [*KEYS, "label", *COLUMNS]),
    })

    def score() -> dict:
        frozen = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(t).alias("threshold")) for n, t in thresholds.items()]))
        both = cut_lineage(validation.unionByName(BO.score(evaluation, fitted, keep)))
        record = ST.study_matrix(both, B.EVENTS, spark.range(0, 1, 1, 1).select(frozen))
        return {"cells": [r.asDict() for r in record.select(*MATRIX).collect()]}  # five rows

    path = f"{shared_folder(spark)}/study-{spark.sparkContext.applicationId}"
    got = LG.score_once(spark, path, sf, current, score)["results"]["cells"]
    kinds = "cell string, threshold double, n_patients bigint, n_hours bigint, prevalence double, utility double, auroc double, auprc double"
    return spark.createDataFrame([tuple(r[c] for c in MATRIX) for r in got], kinds)


# -- attribution ---------------------------------------------------------------------


@register(
    "e10_global_attribution",
    STATS + ", contribution AS (" + " UNION ALL ".join(
        f"SELECT site, '{c}' AS feature, avg(abs(({_Z[c]}) * {num(w)})) AS mean_abs FROM design, stats GROUP BY site"
        for c, w in WEIGHTS.items()
    ) + """), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM contribution)
SELECT site, feature, round(mean_abs, 6) AS mean_abs, rank FROM r WHERE rank <= 15""",
)
def e10(spark, sf):
    rows = stored_design(spark, sf)
    scaler = MD.Standardizer.fit(part(rows, "a_train"), COLUMNS)
    return AT.global_attribution(rows, scaler, WEIGHTS, ["site"])


@register("e10_tree_importance")
def e10_trees(spark, sf):
    """Share of the split gain, and the loss of average precision when a column is permuted, of the study's model."""
    rows = stored_design(spark, sf)
    model = study_trees(rows, sf)
    gain = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(g).alias("split_gain")) for c, g in model.split_gain().items()]))
    return spark.range(0, 1, 1, 1).select(gain).join(MD.permutation_importance(model, part(rows, "a_val"), KEYS, "label"), "feature")


def last_rows(rows: DataFrame, entity) -> DataFrame:
    """Row of the last hour per entity (no two rows share an hour), by a combinable aggregate.

    Each column has a maximum of its own: Spark sorts all rows for one of a
    struct, and could not leave out the columns that nobody reads.
    """
    columns = [c for c in rows.columns if c not in entity]
    return rows.groupBy(*entity).agg(*[F.max_by(c, "hour").alias(c) for c in columns])


def local_factors(spark, sf) -> DataFrame:
    """Top contributions at the latest hour of every user."""
    rows = stored_design(spark, sf)
    scaler = MD.Standardizer.fit(part(rows, "a_train"), COLUMNS)
    return AT.local_attribution(last_rows(rows, B.ENTITY), scaler, WEIGHTS, [*B.ENTITY, "hour"])


@register("e11_tree_attribution")
def e11_trees(spark, sf):
    """Top contributions of the study's trees at the latest hour of every user."""
    rows = stored_design(spark, sf)
    return AT.tree_attribution(last_rows(rows, B.ENTITY), study_trees(rows, sf), [*B.ENTITY, "hour"])


LOCAL = STATS + ", latest AS (SELECT site, user_id, max(hour) AS hour FROM design GROUP BY site, user_id), contribution AS (" + " UNION ALL ".join(
    f"SELECT site, user_id, hour, '{c}' AS feature, ({_Z[c]}) * {num(w)} AS contribution FROM design JOIN latest USING (site, user_id, hour), stats"
    for c, w in WEIGHTS.items()
) + "), local AS (SELECT *, CAST(row_number() OVER (PARTITION BY site, user_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM contribution)"


@register(
    "e11_local_attribution",
    LOCAL + " SELECT site, user_id, hour, rank, feature, round(contribution, 6) AS contribution FROM local WHERE rank <= 10",
)
def e11(spark, sf):
    return local_factors(spark, sf)


@register(
    "e11_first_cases",
    SCORED + f""", hit AS (SELECT CASE label WHEN 1 THEN 'true_positive' ELSE 'false_positive' END AS "case", site, user_id, hour, score
  FROM scored WHERE score >= {num(B.FROZEN['A'])}),
r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY site, user_id, hour) AS rn FROM hit)
SELECT "case", site, user_id, hour, round(score, 6) AS score FROM r WHERE rn = 1""",
)
def e11_first(spark, sf):
    return AT.first_cases(B.scored(spark, sf), KEYS, B.FROZEN["A"])
