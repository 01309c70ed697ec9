"""Backward-looking features."""

from pyspark.sql import functions as F

from stayline.operators import features as FT
from stayline.plans import bindings as B
from stayline.plans.registry import register
from stayline.plans.sql import PANEL, splits
from stayline.spec import STATISTICS, WINDOWS

V = B.EVENT_TYPES
UPTO = "OVER (PARTITION BY site, user_id ORDER BY hour)"
KEYS = ["site", "user_id", "hour"]


def _cols(template: str) -> str:
    return ", ".join(template.format(v=v) for v in V)


@register("c1_missing_flags", PANEL + " SELECT site, user_id, hour, " + _cols('CAST("{v}" IS NULL AS INTEGER) AS {v}_missing') + " FROM panel")
def c1(spark, sf):
    panel = B.cohort(spark, sf)
    return panel.select(*KEYS, *[FT.missing_flag(F.col(v)).alias(f"{v}_missing") for v in V])


SINCE = 'CAST(hour - max(CASE WHEN "{v}" IS NOT NULL THEN hour END) ' + UPTO + " AS INTEGER) AS {v}_hours_since_measured"
LAST = 'last_value("{v}" IGNORE NULLS) ' + UPTO + " AS {v}_last"


@register("c2_hours_since_measured", PANEL + " SELECT site, user_id, hour, " + _cols(SINCE) + " FROM panel")
def c2(spark, sf):
    return FT.recency(B.cohort_blocks(spark, sf, 0), B.EVENTS).select(*KEYS, *[f"{v}_hours_since_measured" for v in V])


@register("c3_carry_forward", PANEL + " SELECT site, user_id, hour, " + _cols(LAST) + " FROM panel")
def c3(spark, sf):
    return FT.recency(B.cohort_blocks(spark, sf, 0), B.EVENTS).select(*KEYS, *[f"{v}_last" for v in V])


# One long table of cells; the frames are per variable.
LONG = PANEL + ", long AS (" + " UNION ALL ".join(
    f"SELECT site, user_id, hour, '{v}' AS variable, \"{v}\" AS x FROM panel" for v in V
) + ")"
STAT_SQL = {
    "min": "min(x) {o}",
    "max": "max(x) {o}",
    "mean": "round(avg(x) {o}, 6)",
    "last": "last_value(x IGNORE NULLS) {o}",
    "slope": "round(CASE WHEN count(x) {o} >= 2 THEN regr_slope(x, CAST(hour AS DOUBLE)) {o} END, 6)",
}


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY site, user_id, variable ORDER BY hour ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _trailing(name: str, stat: str):
    cols = ", ".join(STAT_SQL[stat].format(o=_frame(n)) + f" AS {stat}_{n}" for n in WINDOWS)

    @register(name, LONG + f" SELECT site, user_id, hour, variable, {cols} FROM long")
    def query(spark, sf):
        long = FT.window_features_long(
            B.cohort_blocks(spark, sf, max(WINDOWS) - 1), B.EVENTS, WINDOWS, (stat,), with_recency=False
        )
        return long.select(*KEYS, "variable", *[f"{stat}_{n}" for n in WINDOWS])


for _name, _stat in (
    ("c4_trailing_min", "min"),
    ("c5_trailing_max", "max"),
    ("c6_trailing_mean", "mean"),
    ("c7_trailing_last", "last"),
    ("c8_trailing_slope", "slope"),
):
    _trailing(_name, _stat)


def _window_sql() -> str:
    out = []
    for v in V:
        out += [f'CAST("{v}" IS NULL AS DOUBLE) AS {v}_missing', SINCE.format(v=v).replace("AS INTEGER", "AS DOUBLE")]
    for n in WINDOWS:
        o = f"OVER (PARTITION BY site, user_id ORDER BY hour ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out += [STAT_SQL[s].replace("(x", f'("{v}"').format(o=o) + f" AS {v}_{s}_{n}" for v in V for s in STATISTICS]
    return ", ".join(out)


@register(
    "c10_window_features",
    PANEL + f""" SELECT site, user_id, hour, label, {_window_sql()}, CAST(age AS DOUBLE) AS age,
  CAST(gender AS DOUBLE) AS gender, CAST(clock AS DOUBLE) AS clock FROM panel""",
)
def c10(spark, sf):
    wide = FT.window_features(B.cohort_blocks(spark, sf, max(WINDOWS) - 1), B.EVENTS)
    return wide.select(*KEYS, "label", *B.EVENTS.window_feature_columns(WINDOWS))


MINIMAL = (
    _cols('CAST("{v}" IS NULL AS DOUBLE) AS {v}_missing') + ", " + _cols(LAST)
    + ", CAST(age AS DOUBLE) AS age, CAST(gender AS DOUBLE) AS gender, CAST(clock AS DOUBLE) AS clock"
)


@register("c11_minimal_features", PANEL + f" SELECT site, user_id, hour, label, {MINIMAL} FROM panel")
def c11(spark, sf):
    return FT.design_matrix(B.cohort_blocks(spark, sf, 0), FT.minimal_features, B.EVENTS)


COLUMNS = B.EVENTS.minimal_feature_columns()
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_observed FROM train" for c in COLUMNS)


@register(
    "c12_observed_counts",
    PANEL + splits() + f""", design AS (SELECT site, user_id, hour, {MINIMAL} FROM panel),
train AS (SELECT design.* FROM design JOIN splits USING (site, user_id) WHERE split = 'a_train') {_COUNTS}""",
)
def c12(spark, sf):
    design = FT.minimal_features(B.cohort_blocks(spark, sf, 0, split=True), B.EVENTS, ["split"])
    return FT.observed_counts(design.filter(F.col("split") == "a_train"), COLUMNS)


@register("c14_dense_grid", PANEL + " SELECT site, user_id, hour, eh, n_events FROM panel")
def c14(spark, sf):
    return B.event_grid(spark, sf).select(*KEYS, "eh", "n_events")
