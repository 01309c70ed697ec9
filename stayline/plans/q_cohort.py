"""Reading checks, cohort assembly, splits and draws."""

from pyspark.sql import functions as F

from stayline.operators import cohort as C
from stayline.plans import bindings as B
from stayline.plans.registry import register
from stayline.plans.sql import PANEL, SITE, VARS, splits
from stayline.sources import manifest, store
from stayline.spec import CONFIG

EV = f"WITH ev AS (SELECT *, {SITE} AS site, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS eh FROM events)"
SEED = CONFIG.seed


@register(
    "a3_read_violations",
    EV + """, raw AS (
  SELECT site, user_id, CASE WHEN value <= 100 THEN eh END AS clock,
    CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 2 END AS label
  FROM ev),
per AS (
  SELECT site, user_id, count(*) FILTER (WHERE label IS NULL) AS label_null,
    count(*) FILTER (WHERE label NOT IN (0, 1)) AS label_not_binary,
    count(*) FILTER (WHERE clock IS NULL) AS clock_null,
    count(clock) - count(DISTINCT clock) AS clock_duplicate
  FROM raw GROUP BY site, user_id),
long AS (
  SELECT site, user_id, 'label_null' AS rule, label_null AS n_rows FROM per
  UNION ALL SELECT site, user_id, 'label_not_binary', label_not_binary FROM per
  UNION ALL SELECT site, user_id, 'clock_null', clock_null FROM per
  UNION ALL SELECT site, user_id, 'clock_duplicate', clock_duplicate FROM per)
SELECT site, user_id, rule, n_rows FROM long WHERE n_rows > 0""",
)
def a3(spark, sf):
    kind = F.col("event_type")
    raw = B.events(spark, sf).select(
        "site", "user_id",
        F.when(F.col("value") <= 100, F.col("eh")).alias("clock"),
        F.when(kind == "error", 1).when(kind.isin("view", "purchase"), 0).when(kind == "signup", 2).alias("label"),
    )
    return C.read_violations(raw, B.EVENTS)


@register(
    "a4_hour_index",
    EV + """ SELECT site, user_id, event_id AS clock,
  CAST(row_number() OVER (PARTITION BY site, user_id ORDER BY event_id) - 1 AS INTEGER) AS hour FROM ev""",
)
def a4(spark, sf):
    raw = B.events(spark, sf).select("site", "user_id", F.col("event_id").alias("clock"))
    return C.index_hours(raw, B.EVENTS)


@register("a6_build_cohort", PANEL + f" SELECT site, user_id, hour, clock, {VARS}, label FROM panel")
def a6(spark, sf):
    panel = B.cohort(spark, sf).select("site", "user_id", "hour", "clock", *B.EVENT_TYPES, "label")
    return C.build_cohort(panel, spec=B.EVENTS)


def _row_text(*columns: str) -> str:
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


_LANES = " || ':' || ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4)
)


@register(
    "a9_row_digest",
    f"""WITH hashed AS (
  SELECT l_returnflag, sha256({_row_text(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(round(l_extendedprice * 100) AS BIGINT)", "l_linestatus")}) AS h FROM lineitem)
SELECT l_returnflag, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' || {_LANES}) AS digest
FROM hashed GROUP BY l_returnflag""",
)
def a9(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    columns = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return manifest.row_digest(
        B.table(spark, sf, "lineitem"), ["l_returnflag"], [*columns, cents, F.col("l_linestatus")]
    )


_ROUNDED = ", ".join(f'round("{v}", 3) AS "{v}"' for v in B.EVENT_TYPES)


@register(
    "a10_flat_export",
    PANEL + f""" SELECT user_id, site, hour, clock, CAST(age AS DOUBLE) AS age, CAST(gender AS DOUBLE) AS gender,
  CAST(unit1 AS DOUBLE) AS unit1, CAST(unit2 AS DOUBLE) AS unit2, label, {_ROUNDED} FROM panel""",
)
def a10(spark, sf):
    return store.flat_export(B.cohort(spark, sf), B.EVENTS)


# -- inclusion and splits -----------------------------------------------------------


@register("b1_patient_hours", PANEL + " SELECT site, user_id, count(*) AS n_hours FROM panel GROUP BY site, user_id")
def b1(spark, sf):
    return C.entity_hours(B.cohort(spark, sf), B.EVENTS)


MIN_HOURS = 700


@register(
    "b2_inclusion",
    PANEL + f""" SELECT site, user_id, hour, label FROM panel
WHERE user_id IN (SELECT user_id FROM panel GROUP BY user_id HAVING count(*) >= {MIN_HOURS})""",
)
def b2(spark, sf):
    kept = C.apply_inclusion(B.cohort(spark, sf), B.EVENTS, MIN_HOURS)
    return kept.select("site", "user_id", "hour", "label")


@register(
    "b3_inclusion_report",
    PANEL + f""", n AS (SELECT site, user_id, count(*) AS h, count(*) >= {MIN_HOURS} AS ok FROM panel GROUP BY site, user_id),
r AS (SELECT site, count(*) AS patients_before, count(*) FILTER (WHERE ok) AS patients_after,
  CAST(sum(h) AS BIGINT) AS hours_before, CAST(coalesce(sum(h) FILTER (WHERE ok), 0) AS BIGINT) AS hours_after FROM n GROUP BY site)
SELECT *, patients_before - patients_after AS patients_dropped, hours_before - hours_after AS hours_dropped,
  round(100e0 * (patients_before - patients_after) / patients_before, 6) AS patients_dropped_pct,
  round(100e0 * (hours_before - hours_after) / hours_before, 6) AS hours_dropped_pct,
  CAST(100e0 * (patients_before - patients_after) / patients_before > 3 AS INTEGER) AS flagged FROM r""",
)
def b3(spark, sf):
    return C.inclusion_report(B.cohort(spark, sf), B.EVENTS, MIN_HOURS)


@register(
    "b4_seeded_order",
    f"""WITH ids AS (SELECT DISTINCT 'all' AS site, o_custkey AS user_id FROM orders)
SELECT site, user_id, row_number() OVER (PARTITION BY site ORDER BY md5('{SEED}:' || user_id), user_id) AS seed_rank FROM ids""",
)
def b4(spark, sf):
    ids = B.table(spark, sf, "orders").select(F.lit("all").alias("site"), F.col("o_custkey").alias("user_id"))
    return C.ranked_entities(ids, B.EVENTS, SEED)


@register("b5_split_sites", EV + splits() + " SELECT site, user_id, split FROM splits")
def b5(spark, sf):
    return C.split_sites(B.events(spark, sf), B.EVENTS)


@register(
    "b7_split_overlap",
    EV + splits() + """, planted AS (SELECT site, user_id, split FROM splits
  UNION ALL SELECT site, user_id, 'planted' FROM splits WHERE user_id % 10 = 7)
SELECT site, user_id, count(DISTINCT split) AS n_splits FROM planted GROUP BY site, user_id HAVING count(DISTINCT split) > 1""",
)
def b7(spark, sf):
    """The real splits, with every tenth entity put into one more so that there is something to find."""
    real = C.split_sites(B.events(spark, sf), B.EVENTS).select("site", "user_id", "split")
    planted = real.filter(F.col("user_id") % 10 == 7).withColumn("split", F.lit("planted"))
    return C.split_overlap(real.unionByName(planted), B.EVENTS)


DRAWS = ((10, 0), (10, 1), (50, 0), (50, 1))


def _draw_sql(n: int, draw: int) -> str:
    return f"""SELECT * FROM (SELECT CAST({n} AS INTEGER) AS n, CAST({draw} AS INTEGER) AS draw, site, user_id FROM ids
ORDER BY md5('{C.draw_seed(n, draw)}:' || user_id), site, user_id LIMIT {n})"""


@register(
    "b8_draws",
    EV + ", ids AS (SELECT DISTINCT site, user_id FROM ev) " + " UNION ALL ".join(_draw_sql(*d) for d in DRAWS),
)
def b8(spark, sf):
    source = B.events(spark, sf)
    out = None
    for n, draw in DRAWS:
        drawn = C.draw_entities(source, B.EVENTS, n, C.draw_seed(n, draw), strict=False).select(
            F.lit(n).alias("n"), F.lit(draw).alias("draw"), "site", "user_id"
        )
        out = drawn if out is None else out.unionByName(drawn)
    return out


@register(
    "b9_draw_overlap",
    EV + f""", ids AS (SELECT DISTINCT site, user_id FROM ev), a AS ({_draw_sql(50, 0)}), b AS ({_draw_sql(50, 1)})
SELECT site, user_id FROM a INTERSECT SELECT site, user_id FROM b""",
)
def b9(spark, sf):
    source = B.events(spark, sf)
    one, two = (C.draw_entities(source, B.EVENTS, 50, C.draw_seed(50, d), strict=False) for d in (0, 1))
    return C.draw_overlap(one, two, B.EVENTS)


@register(
    "b10_row_sample",
    f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT 4000""",
)
def b10(spark, sf):
    rows = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.sample_rows(rows, ["o_orderkey"], 4000)
