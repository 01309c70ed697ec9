"""Synthetic cohorts for tests and scale runs. Values are a pure function of the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.expr import seeded_hash
from stayline.spec import CLINICAL, CONFIG, VITALS

# Resting level and spread, hours between readings, change per hour once worsening.
BASE = {"HR": (82.0, 9.0, 1, 1.5), "Temp": (36.9, 0.4, 4, 0.08), "Resp": (18.0, 3.0, 1, 0.6),
        "SBP": (124.0, 12.0, 1, -1.8), "MAP": (84.0, 8.0, 1, -1.2), "O2Sat": (97.0, 1.5, 1, -0.2),
        "Lactate": (1.6, 0.5, 8, 0.15), "WBC": (10.0, 2.5, 12, 0.4)}
DEFAULT_VITAL, DEFAULT_LAB = (60.0, 6.0, 2, 0.0), (20.0, 4.0, 12, 0.0)
LEAD = 6


def unit_noise(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) from an md5 of the parts."""
    digits = F.conv(F.substring(seeded_hash(seed, *parts), 1, 8), 16, 10)
    return digits.cast("double") / F.lit(float(16**8))


def synthetic_cohort(
    spark: SparkSession,
    n_entities: int,
    hours: int = 48,
    seed: int = CONFIG.seed,
    positive_share: float = 0.1,
    fault_rate: float = 0.0,
    variables: tuple[str, ...] = CLINICAL,
) -> DataFrame:
    """Two sites of stays up to `hours` long; some turn positive and worsen before it.

    A reading wanders around its level (trailing mean of noise), appears at its
    own cadence, and with `fault_rate` is replaced by an impossible value.
    """
    i = F.col("id")
    stay = spark.range(n_entities).select(
        F.format_string("p%06d", i + 1).alias("patient_id"),
        F.when(i % 2 == 0, "A").otherwise("B").alias("site"),
        (F.lit(8) + F.floor(unit_noise(seed, F.lit("len"), i) * (hours - 7))).cast("int").alias("n"),
        F.when(
            unit_noise(seed, F.lit("pos"), i) < positive_share,
            F.lit(LEAD) + F.floor(unit_noise(seed, F.lit("onset"), i) * (hours - LEAD)),
        ).cast("int").alias("onset"),
        (F.lit(20) + F.floor(unit_noise(seed, F.lit("age"), i) * 75)).cast("double").alias("Age"),
        F.floor(unit_noise(seed, F.lit("sex"), i) * 2).cast("double").alias("Gender"),
        F.floor(unit_noise(seed, F.lit("unit"), i) * 2).cast("double").alias("Unit1"),
        (F.lit(-200.0) * unit_noise(seed, F.lit("adm"), i)).alias("HospAdmTime"),
    )
    rows = stay.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("hour"))
    recent = W.partitionBy("site", "patient_id").orderBy("hour").rowsBetween(-5, 0)
    cols = []
    for v in variables:
        level, spread, cadence, worse = BASE.get(v, DEFAULT_VITAL if v in VITALS else DEFAULT_LAB)
        who = (F.lit(v), F.col("patient_id"), F.col("hour"))
        wander = F.avg(unit_noise(seed, *who) - 0.5).over(recent) * F.lit(4.0 * spread)
        since = F.greatest(F.col("hour") - (F.col("onset") - LEAD), F.lit(0))
        value = F.lit(level) + wander + F.coalesce(since, F.lit(0)) * F.lit(worse)
        seen = unit_noise(seed + 1, *who) < F.lit(1.0 / cadence)
        broken = unit_noise(seed + 2, *who) < F.lit(fault_rate)
        cols.append(F.when(seen, F.when(broken, F.lit(-999.0)).otherwise(F.round(value, 2))).alias(v))
    return rows.select(
        "patient_id", "site", "hour", *cols, "Age", "Gender", "Unit1",
        (F.lit(1.0) - F.col("Unit1")).alias("Unit2"), "HospAdmTime",
        (F.col("hour") + 1).cast("double").alias("ICULOS"),
        F.coalesce((F.col("hour") >= F.col("onset")).cast("int"), F.lit(0)).alias("SepsisLabel"),
    )
