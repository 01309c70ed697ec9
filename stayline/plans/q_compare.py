"""Cells, drift, calibration, subgroups and transfer."""

from pyspark.sql import functions as F

from stayline.operators import cohort as CO
from stayline.operators import compare as C
from stayline.operators import metrics as M
from stayline.operators import isotonic as IS
from stayline.operators.transfer import calibration_arms, transfer_curve
from stayline.plans import bindings as B
from stayline.plans.q_metrics import reliability_sql
from stayline.plans.registry import register
from stayline.plans.sql import PANEL, SCORED, SITE, calibrated_sql, isotonic_sql, num, ranks, splits, utility
from stayline.session import cut_lineage
from stayline.spec import CONFIG

_CELLS = " UNION ALL ".join(
    f"SELECT '{cell}' AS cell, {num(B.FROZEN[m])} AS threshold, site, user_id, hour, label, {B.SCORES[m]} AS score FROM sp WHERE split = '{split}'"
    for cell, m, split in C.CELLS
)
CELLS = SCORED + splits() + f", sp AS (SELECT scored.*, split FROM scored JOIN splits USING (site, user_id)), cells AS ({_CELLS})"


@register(
    "g1_site_matrix",
    CELLS + ranks("cells", "cell") + utility("cells", "threshold", "cell, site, user_id") + """,
m AS (SELECT cell, max(threshold) AS threshold, count(DISTINCT user_id) AS n_patients, count(*) AS n_hours,
  sum(label) AS p, count(*) FILTER (WHERE score >= t) AS a, count(*) FILTER (WHERE score >= t AND label = 1) AS tp,
  (sum(u) - sum(u0)) / nullif(sum(ubest) - sum(u0), 0) AS utility FROM util GROUP BY cell)
SELECT cell, threshold, n_patients, n_hours, round(m.p / CAST(n_hours AS DOUBLE), 6) AS prevalence,
  round((n_hours - (a - tp) - (m.p - tp)) / CAST(n_hours AS DOUBLE), 6) AS accuracy,
  round(2e0 * tp / nullif(a + m.p, 0), 6) AS f_measure, round(utility, 6) AS utility,
  round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM m JOIN (SELECT cell, auroc, auprc FROM ranked) USING (cell)""",
)
def g1(spark, sf):
    cells = C.cells_of(B.scored_splits(spark, sf), B.SCORES)
    record = C.site_matrix(cells, B.FROZEN, B.ENTITY)
    return record.select(
        "cell", "threshold", "n_patients", "n_hours", "prevalence", "accuracy", "f_measure",
        "utility", "auroc", "auprc",
    )


PRICED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def drift_sql(long: str) -> str:
    """`long`: (feature, side 1 or 2, x) rows."""
    return f"""WITH long AS ({long}),
seen AS (SELECT feature, x, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 2) AS b
  FROM long WHERE x IS NOT NULL GROUP BY feature, x),
tot AS (SELECT feature, sum(a) AS na, sum(b) AS nb FROM seen GROUP BY feature),
cdf AS (
  SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx,
    sum(a) OVER (PARTITION BY feature ORDER BY x) AS ca, sum(b) OVER (PARTITION BY feature ORDER BY x) AS cb FROM seen),
dist AS (
  SELECT feature, CAST(max(na) AS BIGINT) AS n_first, CAST(max(nb) AS BIGINT) AS n_second,
    CASE WHEN max(na) >= 2 AND max(nb) >= 2
      THEN coalesce(sum(abs(CAST(ca AS DOUBLE) / na - CAST(cb AS DOUBLE) / nb) * (nx - x)), 0) END AS distance
  FROM cdf JOIN tot USING (feature) GROUP BY feature)"""


LINES = drift_sql(" UNION ALL ".join(
    f"SELECT '{v}' AS feature, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS side, {v} AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')"
    for v in PRICED
))


@register("g2_drift", LINES + " SELECT feature, n_first, n_second, round(distance, 6) AS distance FROM dist")
def g2(spark, sf):
    return C.drift(B.table(spark, sf, "lineitem"), "l_returnflag", "A", "R", PRICED)


KINDS = drift_sql(" UNION ALL ".join(
    f"SELECT '{v}' AS feature, CASE WHEN {SITE} = 'A' THEN 1 ELSE 2 END AS side, CASE WHEN event_type = '{v}' THEN value END AS x FROM events"
    for v in B.EVENT_TYPES
))


@register(
    "g3_drift_ranking",
    KINDS + """ SELECT feature, n_first, n_second, round(distance, 6) AS distance,
  row_number() OVER (ORDER BY distance DESC NULLS LAST, feature) AS drift_rank FROM dist""",
)
def g3(spark, sf):
    kind = F.col("event_type")
    wide = B.events(spark, sf).select(
        "site", *[F.when(kind == v, F.col("value")).alias(v) for v in B.EVENT_TYPES]
    )
    return C.ranked_drift(C.drift(wide, "site", "A", "B", B.EVENT_TYPES))


def _two_cells(spark, sf):
    cells = C.cells_of(B.scored_splits(spark, sf), B.SCORES)
    return cells.filter(F.col("cell").isin("A->A", "A->B"))


TWO = CELLS + ", two AS (SELECT * FROM cells WHERE cell IN ('A->A', 'A->B'))"


@register("g5_reliability_cells", TWO + reliability_sql("two", "cell"))
def g5_reliability(spark, sf):
    return M.reliability(_two_cells(spark, sf), ["cell"])


@register(
    "g5_brier_cells",
    TWO + " SELECT cell, round(avg((score - label) * (score - label)), 6) AS brier FROM two GROUP BY cell",
)
def g5_brier(spark, sf):
    return M.evaluate(_two_cells(spark, sf), ["cell"], F.lit(B.FROZEN["A"]), B.ENTITY).select("cell", "brier")


def _drawn_sql(n: int, draw: int) -> str:
    """The entities of site B's training part that one draw of the study takes."""
    return f"""SELECT site, user_id FROM splits WHERE split = 'b_train'
  ORDER BY md5('{CO.draw_seed(n, draw)}:' || user_id), site, user_id LIMIT {n}"""


#: Users of site B whose rows calibrate in the last two arms.
SLICE = 20
_ARMS = (("A->A fit on A validation (in-sample)", "on_a", "a_val"), ("A->B fit on A validation", "on_a", "b_eval"),
         ("A->A fit on B slice", "on_b", "a_val"), ("A->B fit on B slice", "on_b", "b_eval"))
SP = SCORED + splits() + ", sp AS (SELECT scored.*, split FROM scored JOIN splits USING (site, user_id))"


@register(
    "g5_recalibrated_arms",
    SP + f", slice AS ({_drawn_sql(SLICE, 0)})"
    + isotonic_sql("on_a", "SELECT score AS x, label AS y FROM sp WHERE split = 'a_val'")
    + isotonic_sql("on_b", "SELECT score AS x, label AS y FROM sp JOIN slice USING (site, user_id) WHERE split = 'b_train'")
    + "".join(
        calibrated_sql(f"arm{i}", f"SELECT '{name}' AS arm, label, score FROM sp WHERE split = '{split}'", fit)
        for i, (name, fit, split) in enumerate(_ARMS)
    )
    + ", arms AS (" + " UNION ALL ".join(f"SELECT * FROM arm{i}" for i in range(4)) + ")" + ranks("arms", "arm")
    + """ SELECT arm, n_hours, round(brier, 6) AS brier, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
FROM (SELECT arm, count(*) AS n_hours, avg((score - label) * (score - label)) AS brier FROM arms GROUP BY arm) JOIN ranked USING (arm)""",
)
def g5_arms(spark, sf):
    """Four fit/apply arms. The slice of the other site is drawn by entity.

    The first arm is fitted and reported on the same rows, so it is in-sample.
    """
    rows = cut_lineage(B.scored_splits(spark, sf).select(*B.ENTITY, "hour", "label", "score", "split"))
    part = {s: rows.filter(F.col("split") == s).drop("split") for s in ("a_val", "b_train", "b_eval")}
    drawn = CO.draw_entities(part["b_train"], B.EVENTS, SLICE, CO.draw_seed(SLICE, 0), strict=False)
    fits = {"on_a": IS.fit_pools(part["a_val"]), "on_b": IS.fit_pools(part["b_train"].join(drawn, list(B.ENTITY), "left_semi"))}
    arms = calibration_arms({name: IS.calibrate(fits[fit], part[split]) for name, fit, split in _ARMS}, B.ENTITY)
    record = M.evaluate(arms, ["arm"], F.lit(B.FROZEN["A"]), B.ENTITY)
    return record.select("arm", "n_hours", "brier", "auroc", "auprc")


GROUPS = """ UNION ALL """.join(
    f"SELECT '{name}' AS \"group\", site, user_id, label, score FROM scored WHERE {cond}"
    for name, cond in (
        ("sex=0", "gender = 0"), ("sex=1", "gender = 1"), ("age <40", "age < 40"),
        ("age 40-65", "age >= 40 AND age < 65"), ("age 65-80", "age >= 65 AND age < 80"),
        ("age 80+", "age >= 80"), ("Unit1=1", "unit1 = 1"), ("Unit2=1", "unit2 = 1"),
    )
)


@register(
    "g6_subgroups",
    SCORED + f", members AS ({GROUPS})" + ranks("members", '"group"') + """,
s AS (SELECT "group", count(*) AS n_hours, count(DISTINCT user_id) AS n_patients, CAST(sum(label) AS BIGINT) AS n_positives FROM members GROUP BY "group"),
f AS (SELECT *, CAST(n_positives < 2000 OR n_positives = n_hours AS INTEGER) AS suppressed FROM s)
SELECT f.*, CASE WHEN suppressed = 0 THEN round(auroc, 6) END AS auroc, CASE WHEN suppressed = 0 THEN round(auprc, 6) END AS auprc
FROM f JOIN (SELECT "group", auroc, auprc FROM ranked) USING ("group")""",
)
def g6(spark, sf):
    labels = M.subgroup_labels(B.EVENTS)
    return M.subgroup_metrics(B.scored(spark, sf), labels, B.ENTITY, min_positives=2000)


def curve_rows(spark, sf):
    """The hours of site B with the base score and the split of their user."""
    rows = B.event_panel(spark, sf, scores=True, split=True).filter(F.col("split").isin("b_train", "b_eval"))
    return rows.select(*B.ENTITY, "hour", "label", "score", "n_events", "n72", "ecum", "split")


def _curve(spark, sf, modes):
    """Base score adapted with n users of site B, for the sizes and draws of the study; scored on the rest of site B."""
    rows = cut_lineage(curve_rows(spark, sf))
    adapt = rows.filter(F.col("split") == "b_train").drop("split")
    evaluation = rows.filter(F.col("split") == "b_eval").drop("split")
    return transfer_curve(adapt, evaluation, B.EVENTS, ["n_events", "n72", "ecum"], B.FROZEN["A"], modes=modes)


@register("g7_transfer_curve")
def g7(spark, sf):
    """Recalibration and 200 more rounds of boosting."""
    return _curve(spark, sf, ("recalib", "finetune"))


_SIZES = ", ".join(f"({n})" for n in CONFIG.transfer_n)


@register(
    "g7_recalibrated_curve",
    SP + f""", pool AS (SELECT site, user_id FROM splits WHERE split = 'b_train'),
sizes(n) AS (VALUES {_SIZES}), cells AS (SELECT n, draw FROM sizes, range({CONFIG.transfer_draws}) r(draw)),
drawn AS (SELECT n, draw, site, user_id FROM (SELECT *, row_number() OVER (PARTITION BY n, draw
    ORDER BY md5(({CONFIG.seed} + 17 * n + 101 * draw) || ':' || user_id), site, user_id) AS r FROM cells, pool)
  WHERE r <= n AND n <= (SELECT count(*) FROM pool))"""
    + isotonic_sql("fit", "SELECT n, draw, score AS x, label AS y FROM sp JOIN drawn USING (site, user_id)", "n, draw")
    + calibrated_sql("moved", """SELECT n, draw, site, user_id, hour, label, score FROM sp, cells
      WHERE split = 'b_eval' AND n > 0 AND n <= (SELECT count(*) FROM pool)""", "fit", "n, draw")
    + """, scored_draws AS (SELECT n AS size, draw, site, user_id, hour, label, score FROM moved
  UNION ALL SELECT 0, draw, site, user_id, hour, label, score FROM sp, cells WHERE split = 'b_eval' AND n = 0)"""
    + ranks("scored_draws", "size, draw") + utility("scored_draws", num(B.FROZEN["A"]), "size, draw, site, user_id") + """,
m AS (SELECT size, draw, (sum(u) - sum(u0)) / nullif(sum(ubest) - sum(u0), 0) AS utility FROM util GROUP BY size, draw)
SELECT CAST(n AS INTEGER) AS n, CAST(cells.draw AS INTEGER) AS draw, 'recalib' AS mode,
  CAST(least(n, (SELECT count(*) FROM pool)) AS BIGINT) AS n_drawn, round(auprc, 6) AS auprc, round(utility, 6) AS utility
FROM cells LEFT JOIN ranked ON ranked.size = n AND ranked.draw = cells.draw LEFT JOIN m ON m.size = n AND m.draw = cells.draw""",
)
def g7_recalibrated(spark, sf):
    """The arm of the curve that has an exact counterpart: isotonic recalibration and the base."""
    return _curve(spark, sf, ("recalib",))


DRAWN = [(n, d) for n in (5, 10) for d in range(3)]


@register(
    "g8_transfer_summary",
    PANEL + """, ids AS (SELECT DISTINCT site, user_id FROM panel), drawn AS (""" + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT CAST({n} AS INTEGER) AS n, CAST({d} AS INTEGER) AS draw, user_id FROM ids
ORDER BY md5('{CO.draw_seed(n, d)}:' || user_id), site, user_id LIMIT {n})""" for n, d in DRAWN
    ) + """), r AS (SELECT n, draw, avg(label) AS prevalence, CAST(count(*) AS DOUBLE) AS hours FROM panel JOIN drawn USING (user_id) GROUP BY n, draw)
SELECT n, count(*) AS n_draws, round(avg(prevalence), 6) AS prevalence_mean, round(stddev_pop(prevalence), 6) AS prevalence_sd,
  round(avg(hours), 6) AS hours_mean, round(stddev_pop(hours), 6) AS hours_sd FROM r GROUP BY n""",
)
def g8(spark, sf):
    source = B.events(spark, sf)
    drawn = None
    for n, d in DRAWN:
        one = CO.draw_entities(source, B.EVENTS, n, CO.draw_seed(n, d), strict=False).select(
            F.lit(n).alias("n"), F.lit(d).alias("draw"), *B.ENTITY
        )
        drawn = one if drawn is None else drawn.unionByName(one)
    rows = B.cohort(spark, sf).join(drawn, list(B.ENTITY)).groupBy("n", "draw").agg(
        F.avg(F.col("label").cast("double")).alias("prevalence"),
        F.count(F.lit(1)).cast("double").alias("hours"),
    )
    return C.transfer_summary(rows, ["n"], ["prevalence", "hours"])
