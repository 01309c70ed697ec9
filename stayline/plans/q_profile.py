"""Data profile."""

from stayline.operators import profile as P
from stayline.plans import bindings as B
from stayline.plans.registry import register
from stayline.plans.sql import PANEL
from stayline.spec import PanelSpec

V = B.EVENT_TYPES


@register(
    "d1_cohort_counts",
    PANEL + """ SELECT coalesce(site, 'all') AS site, count(DISTINCT user_id) AS n_patients, count(*) AS n_hours
FROM panel GROUP BY ROLLUP (site)""",
)
def d1(spark, sf):
    return P.cohort_counts(B.cohort(spark, sf), B.EVENTS)


@register(
    "d2_prevalence",
    PANEL + """, p AS (SELECT site, user_id, max(label) AS e, sum(label) AS y, count(*) AS h FROM panel GROUP BY site, user_id)
SELECT site, count(*) AS n_patients, CAST(sum(e) AS BIGINT) AS positive_patients,
  round(avg(e), 6) AS patient_prevalence, CAST(sum(h) AS BIGINT) AS n_hours, CAST(sum(y) AS BIGINT) AS positive_hours,
  round(CAST(sum(y) AS DOUBLE) / sum(h), 6) AS hour_prevalence FROM p GROUP BY site""",
)
def d2(spark, sf):
    return P.prevalence(B.cohort(spark, sf), B.EVENTS)


@register(
    "d3_length_of_stay",
    PANEL + """, n AS (SELECT site, user_id, count(*) AS h FROM panel GROUP BY site, user_id)
SELECT site, round(quantile_cont(h, 0.25), 6) AS q1_hours, round(quantile_cont(h, 0.5), 6) AS median_hours,
  round(quantile_cont(h, 0.75), 6) AS q3_hours, count(*) AS n_patients, min(h) AS min_hours, max(h) AS max_hours
FROM n GROUP BY site""",
)
def d3(spark, sf):
    return P.length_of_stay(B.cohort(spark, sf), B.EVENTS)


@register(
    "d3_value_quantiles",
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
FROM lineitem GROUP BY l_returnflag""",
)
def d3_values(spark, sf):
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return P.value_quantiles(B.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", probs)


@register(
    "d4_label_semantics",
    PANEL + """, p AS (
  SELECT site, user_id, sum(label) AS y, min(hour) FILTER (WHERE label = 1) AS f, max(hour) FILTER (WHERE label = 0) AS z
  FROM panel GROUP BY site, user_id HAVING sum(label) > 0)
SELECT site, count(*) AS positive_patients, count(*) FILTER (WHERE z > f) AS non_monotone,
  count(*) FILTER (WHERE f = 0) AS onset_at_zero, round(CAST(median(y) AS DOUBLE), 6) AS median_positive_hours,
  round(CAST(median(f) AS DOUBLE), 6) AS median_first_positive_hour FROM p GROUP BY site""",
)
def d4(spark, sf):
    return P.label_semantics(B.cohort(spark, sf), B.EVENTS)


@register(
    "d5_record_structure",
    """WITH p AS (SELECT source AS site, lang, min(doc_id) AS f, max(doc_id) AS l, count(*) AS n FROM documents GROUP BY source, lang)
SELECT site, count(*) AS n_patients, count(*) FILTER (WHERE l - f + 1 <> n) AS with_gaps,
  count(*) FILTER (WHERE f <> 1) AS late_starts, round(100e0 * count(*) FILTER (WHERE f <> 1) / count(*), 6) AS late_starts_pct,
  max(f) AS latest_start FROM p GROUP BY site""",
)
def d5(spark, sf):
    docs = B.table(spark, sf, "documents").withColumnRenamed("source", "site")
    return P.record_structure(docs, PanelSpec(entity="lang", clock="doc_id"))


def _each(template: str) -> str:
    return " UNION ALL ".join(template.format(v=v) for v in V)


@register(
    "d6_missingness",
    PANEL + ", m AS (" + _each("""SELECT site, count(*) AS n_hours, '{v}' AS variable, count("{v}") AS n_measured
FROM panel GROUP BY site""") + ") SELECT *, round(100e0 * (n_hours - n_measured) / n_hours, 6) AS missing_pct FROM m",
)
def d6(spark, sf):
    return P.missingness(B.cohort(spark, sf), B.EVENTS)


@register(
    "d6_unlabelled_documents",
    """WITH j AS (SELECT source AS site, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT site, count(*) AS n_hours, 'quality' AS variable, count(quality) AS n_measured FROM j GROUP BY site
  UNION ALL SELECT site, count(*), 'toxic', count(toxic) FROM j GROUP BY site)
SELECT *, round(100e0 * (n_hours - n_measured) / n_hours, 6) AS missing_pct FROM m""",
)
def d6_documents(spark, sf):
    docs = B.table(spark, sf, "documents").withColumnRenamed("source", "site").select("site", "doc_id")
    joined = docs.join(B.table(spark, sf, "labels"), "doc_id", "left")
    return P.missingness(joined, PanelSpec(entity="doc_id", variables=("quality", "toxic")))


@register(
    "d7_measurement_frequency",
    PANEL + ", m AS (" + _each("""SELECT site, '{v}' AS variable, count("{v}") AS n_measured, count(*) AS h,
  count(DISTINCT CASE WHEN "{v}" IS NOT NULL THEN user_id END) AS k, count(DISTINCT user_id) AS p FROM panel GROUP BY site""")
    + """) SELECT site, variable, n_measured, round(100e0 * n_measured / h, 6) AS per_100_hours,
  round(100e0 * k / p, 6) AS patients_with_any_pct FROM m""",
)
def d7(spark, sf):
    return P.measurement_frequency(B.cohort(spark, sf), B.EVENTS)


BOUNDS = {"l_quantity": (2.0, 49.0), "l_extendedprice": (1500.0, 90000.0), "l_discount": (0.0, 0.09), "l_tax": (0.01, 0.08)}


@register(
    "d8_plausible_range",
    "WITH m AS (" + " UNION ALL ".join(
        f"""SELECT l_returnflag, '{v}' AS variable, {low!r}e0 AS low, {high!r}e0 AS high, count({v}) AS n,
  min({v}) AS observed_min, max({v}) AS observed_max, count(*) FILTER (WHERE {v} < {low!r}e0 OR {v} > {high!r}e0) AS n_out
FROM lineitem GROUP BY l_returnflag"""
        for v, (low, high) in BOUNDS.items()
    ) + ") SELECT * REPLACE (round(observed_min, 6) AS observed_min, round(observed_max, 6) AS observed_max), round(100e0 * n_out / n, 6) AS out_pct FROM m",
)
def d8(spark, sf):
    return P.plausible_range(B.table(spark, sf, "lineitem"), "l_returnflag", list(BOUNDS), BOUNDS)
