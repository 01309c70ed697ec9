"""Metrics of scored rows, sweeps and severity."""

from pyspark.sql import functions as F

from stayline.functions.expr import severity
from stayline.operators import metrics as M
from stayline.plans import bindings as B
from stayline.plans.registry import register
from stayline.plans.sql import SCORED, num, ranks, utility

T = B.FROZEN["A"]
LIT = num(T)
DOCS = """WITH scored AS (SELECT source AS site, lang, doc_id, toxic AS label,
  CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 1000) AS score FROM documents JOIN labels USING (doc_id))"""


@register("f1_auroc", SCORED + ranks("scored", "site") + " SELECT site, round(auroc, 6) AS auroc FROM ranked")
def f1(spark, sf):
    return M.rank_metrics(B.scored(spark, sf), ["site"]).select("site", "auroc")


@register("f1_auroc_documents", DOCS + ranks("scored", "lang") + " SELECT lang, round(auroc, 6) AS auroc FROM ranked")
def f1_documents(spark, sf):
    return M.rank_metrics(B.labelled_documents(spark, sf), ["lang"]).select("lang", "auroc")


@register("f2_average_precision", SCORED + ranks("scored", "site") + " SELECT site, round(auprc, 6) AS auprc FROM ranked")
def f2(spark, sf):
    return M.rank_metrics(B.scored(spark, sf), ["site"]).select("site", "auprc")


@register("f2_average_precision_documents", DOCS + ranks("scored", "site") + " SELECT site, round(auprc, 6) AS auprc FROM ranked")
def f2_documents(spark, sf):
    return M.rank_metrics(B.labelled_documents(spark, sf), ["site"]).select("site", "auprc")


CONFUSION = f""", c AS (SELECT site, count(*) AS n, sum(label) AS p, count(DISTINCT user_id) AS np,
  count(*) FILTER (WHERE score >= {LIT}) AS a, count(*) FILTER (WHERE score >= {LIT} AND label = 1) AS tp,
  avg((score - label) * (score - label)) AS brier FROM scored GROUP BY site)"""


def _record(spark, sf, *columns):
    record = M.evaluate(B.scored(spark, sf), ["site"], F.lit(T), B.ENTITY)
    return record.select("site", *columns)


@register(
    "f3_accuracy_f_measure",
    SCORED + CONFUSION + """ SELECT site, round((n - (a - tp) - (p - tp)) / CAST(n AS DOUBLE), 6) AS accuracy,
  round(2e0 * tp / nullif(2 * tp + (a - tp) + (p - tp), 0), 6) AS f_measure FROM c""",
)
def f3(spark, sf):
    return _record(spark, sf, "accuracy", "f_measure")


@register(
    "f4_prevalence_counts",
    SCORED + CONFUSION + " SELECT site, round(p / CAST(n AS DOUBLE), 6) AS prevalence, n AS n_hours, np AS n_patients FROM c",
)
def f4(spark, sf):
    return _record(spark, sf, "prevalence", "n_hours", "n_patients")


@register("f5_brier", SCORED + CONFUSION + " SELECT site, round(brier, 6) AS brier FROM c")
def f5(spark, sf):
    return _record(spark, sf, "brier")


_EDGES = " + ".join(f"CAST(score >= {num(e)} AS INTEGER)" for e in M.BIN_EDGES[1:-1])


def reliability_sql(source: str, group: str) -> str:
    names = [f"{a:.2f}-{b:.2f}" for a, b in zip(M.BIN_EDGES, M.BIN_EDGES[1:])]
    return f""", binned AS (SELECT {group}, {_EDGES} AS k, count(*) AS n, avg(score) AS m, avg(label) AS r FROM {source} GROUP BY 1, 2),
slots AS (SELECT DISTINCT {group}, k, {names}[k + 1] AS bin FROM {source}, range(10) AS t(k))
SELECT {group}, bin, coalesce(n, 0) AS n, round(m, 6) AS mean_prediction, round(r, 6) AS positive_rate
FROM slots LEFT JOIN binned USING ({group}, k)"""


@register("f6_reliability", SCORED + reliability_sql("scored", "site"))
def f6(spark, sf):
    return M.reliability(B.scored(spark, sf), ["site"])


@register("f7_alert_rate", SCORED + CONFUSION + " SELECT site, round(2400e0 * a / n, 6) AS alerts_per_100_days FROM c")
def f7(spark, sf):
    return _record(spark, sf, "alerts_per_100_days")


@register(
    "f8_row_utility",
    SCORED + utility("scored", LIT)
    + " SELECT site, user_id, hour, CAST(score >= t AS INTEGER) AS predicted, round(u, 6) AS utility FROM util",
)
def f8(spark, sf):
    rows = M.row_utility(B.scored(spark, sf), B.ENTITY, F.lit(T))
    return rows.select("site", "user_id", "hour", "predicted", "utility")


@register(
    "f9_normalised_utility",
    SCORED + utility("scored", LIT)
    + " SELECT site, round((sum(u) - sum(u0)) / nullif(sum(ubest) - sum(u0), 0), 6) AS utility FROM util GROUP BY site",
)
def f9(spark, sf):
    return _record(spark, sf, "utility")


@register(
    "f10_evaluation",
    SCORED + ranks("scored", "site") + utility("scored", LIT) + CONFUSION + f""",
w AS (SELECT site, (sum(u) - sum(u0)) / nullif(sum(ubest) - sum(u0), 0) AS utility FROM util GROUP BY site)
SELECT site, {LIT} AS threshold, np AS n_patients, n AS n_hours, CAST(p AS BIGINT) AS n_positives, a AS n_alerts,
  round(p / CAST(n AS DOUBLE), 6) AS prevalence, round((n - (a - tp) - (c.p - tp)) / CAST(n AS DOUBLE), 6) AS accuracy,
  round(2e0 * tp / nullif(2 * tp + (a - tp) + (c.p - tp), 0), 6) AS f_measure, round(brier, 6) AS brier,
  round(2400e0 * a / n, 6) AS alerts_per_100_days, round(utility, 6) AS utility, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
FROM c JOIN w USING (site) JOIN (SELECT site, auroc, auprc FROM ranked) USING (site)""",
)
def f10(spark, sf):
    return M.evaluate(B.scored(spark, sf), ["site"], F.lit(T), B.ENTITY)


# Every threshold is tried against every row: the slow, plain way.
SWEPT = SCORED + utility("scored", LIT) + """,
swept AS (
  SELECT site, k / 100e0 AS threshold,
    count(*) FILTER (WHERE score >= k / 100e0) AS a, count(*) FILTER (WHERE score >= k / 100e0 AND label = 1) AS tp,
    sum(label) AS p, count(*) AS n,
    round((sum(CASE WHEN score >= k / 100e0 THEN u1 ELSE u0 END) - sum(u0)) / nullif(sum(ubest) - sum(u0), 0), 9) AS utility
  FROM util, range(1, 100) AS t(k) GROUP BY site, k)"""


@register(
    "f11_best_threshold",
    SWEPT + """, b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY utility DESC, threshold) AS rn FROM swept WHERE utility IS NOT NULL)
SELECT site, threshold, round(utility, 6) AS utility_at_threshold FROM b WHERE rn = 1""",
)
def f11(spark, sf):
    return M.best_threshold(M.sweep(B.scored(spark, sf), ["site"], B.ENTITY), ["site"])


SWEEP_ROW = """site, threshold, round(tp / CAST(nullif(p, 0) AS DOUBLE), 6) AS sensitivity, round(tp / CAST(nullif(a, 0) AS DOUBLE), 6) AS ppv,
  round(2400e0 * a / n, 6) AS alerts_per_100_days, round(utility, 6) AS utility"""


@register("f12_alert_burden", SWEPT + f" SELECT {SWEEP_ROW} FROM swept")
def f12(spark, sf):
    return M.sweep(B.scored(spark, sf), ["site"], B.ENTITY)


@register(
    "f13_operating_row",
    SWEPT + f""", b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(abs(threshold - 0.5875e0), 12), threshold) AS rn FROM swept)
SELECT {SWEEP_ROW} FROM b WHERE rn = 1""",
)
def f13(spark, sf):
    return M.operating_row(M.sweep(B.scored(spark, sf), ["site"], B.ENTITY), ["site"], F.lit(0.5875))


@register(
    "f14_severity",
    SCORED + f""" SELECT site, CASE WHEN score >= {LIT} * 4 / 3 THEN 'critical' WHEN score >= {LIT} THEN 'warning' ELSE 'info' END AS severity,
  count(*) AS n FROM scored GROUP BY 1, 2""",
)
def f14(spark, sf):
    level = severity(F.col("score"), F.lit(T)).alias("severity")
    return B.scored(spark, sf).groupBy("site", level).agg(F.count(F.lit(1)).alias("n"))
