"""Data profile: each section is one aggregation over the cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import count_where, ratio, value_block
from stayline.operators.blocks import exact_quantiles
from stayline.operators.cohort import entity_hours
from stayline.spec import PLAUSIBLE_RANGE, PanelSpec


def cohort_counts(cohort: DataFrame, spec: PanelSpec) -> DataFrame:
    """Entities and hours per site, plus a row `all`."""
    return (
        entity_hours(cohort, spec)
        .rollup(spec.site)
        .agg(F.count(F.lit(1)).alias("n_patients"), F.sum("n_hours").alias("n_hours"))
        .withColumn(spec.site, F.coalesce(spec.site, F.lit("all")))
    )


def prevalence(cohort: DataFrame, spec: PanelSpec) -> DataFrame:
    per_entity = cohort.groupBy(*spec.key).agg(
        F.max(spec.label).cast("bigint").alias("ever"),
        F.sum(F.col(spec.label).cast("bigint")).alias("positive_hours"),
        F.count(F.lit(1)).alias("n_hours"),
    )
    return per_entity.groupBy(spec.site).agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.sum("ever").alias("positive_patients"),
        ratio(F.sum("ever").cast("double"), F.count(F.lit(1))).alias("patient_prevalence"),
        F.sum("n_hours").alias("n_hours"),
        F.sum("positive_hours").alias("positive_hours"),
        ratio(F.sum("positive_hours").cast("double"), F.sum("n_hours")).alias("hour_prevalence"),
    )


def length_of_stay(cohort: DataFrame, spec: PanelSpec, method: str = "linear") -> DataFrame:
    stays = entity_hours(cohort, spec)
    quantiles = exact_quantiles(
        stays,
        [spec.site],
        "n_hours",
        {"q1_hours": 0.25, "median_hours": 0.5, "q3_hours": 0.75},
        F.col("n_hours"),
        method,
    ).drop("n")
    ends = stays.groupBy(spec.site).agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.min("n_hours").alias("min_hours"),
        F.max("n_hours").alias("max_hours"),
    )
    return quantiles.join(ends, spec.site)


def value_quantiles(
    table: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], method="linear"
) -> DataFrame:
    """Quantiles of any numeric column per group, exact on any number of rows."""
    x = table.select(*by, F.col(value).cast("double").alias(value))
    return exact_quantiles(x, by, value, probs, value_block(F.col(value)), method)


def label_semantics(cohort: DataFrame, spec: PanelSpec) -> DataFrame:
    """Is the label one run of ones that ends with the record?"""
    label, hour = F.col(spec.label), F.col(spec.hour)
    per_entity = (
        cohort.groupBy(*spec.key)
        .agg(
            F.sum(label.cast("bigint")).alias("positive_hours"),
            F.min(F.when(label == 1, hour)).alias("first_positive_hour"),
            F.max(F.when(label == 0, hour)).alias("last_negative_hour"),
        )
        .filter("positive_hours > 0")
    )
    counts = per_entity.groupBy(spec.site).agg(
        F.count(F.lit(1)).alias("positive_patients"),
        count_where(F.col("last_negative_hour") > F.col("first_positive_hour")).alias("non_monotone"),
        count_where(F.col("first_positive_hour") == 0).alias("onset_at_zero"),
    )
    half = {"median": 0.5}
    for column in ("positive_hours", "first_positive_hour"):
        median = exact_quantiles(per_entity, [spec.site], column, half, F.col(column).cast("bigint"))
        counts = counts.join(
            median.select(spec.site, F.col("median").alias(f"median_{column}")), spec.site
        )
    return counts


def record_structure(cohort: DataFrame, spec: PanelSpec) -> DataFrame:
    """Clock gaps and late starts."""
    per_entity = cohort.groupBy(*spec.key).agg(
        F.min(spec.clock).cast("bigint").alias("first"),
        F.max(spec.clock).cast("bigint").alias("last"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    late = count_where(F.col("first") != 1)
    return per_entity.groupBy(spec.site).agg(
        F.count(F.lit(1)).alias("n_patients"),
        count_where(F.col("last") - F.col("first") + 1 != F.col("n_rows")).alias("with_gaps"),
        late.alias("late_starts"),
        (F.lit(100.0) * late / F.count(F.lit(1))).alias("late_starts_pct"),
        F.max("first").alias("latest_start"),
    )


def missingness(cohort: DataFrame, spec: PanelSpec) -> DataFrame:
    """Share of empty cells, one row per (site, variable); one aggregation."""
    counted = cohort.groupBy(spec.site).agg(
        F.count(F.lit(1)).alias("n_hours"), *[F.count(v).alias(v) for v in spec.variables]
    )
    long = counted.unpivot([spec.site, "n_hours"], list(spec.variables), "variable", "n_measured")
    empty = F.col("n_hours") - F.col("n_measured")
    return long.withColumn("missing_pct", ratio(F.lit(100.0) * empty, F.col("n_hours")))


def measurement_frequency(cohort: DataFrame, spec: PanelSpec) -> DataFrame:
    """Readings per 100 hours, and share of entities with any, per variable.

    Counted per entity first, so entities are told apart without a distinct.
    """
    per_entity = cohort.groupBy(*spec.key).agg(
        F.count(F.lit(1)).alias("_h"), *[F.count(v).alias(v) for v in spec.variables]
    )
    long = per_entity.unpivot([*spec.key, "_h"], list(spec.variables), "variable", "_m")
    any_reading = count_where(F.col("_m") > 0)
    return long.groupBy(spec.site, "variable").agg(
        F.sum("_m").alias("n_measured"),
        ratio(F.lit(100.0) * F.sum("_m"), F.sum("_h")).alias("per_100_hours"),
        ratio(F.lit(100.0) * any_reading, F.count(F.lit(1))).alias("patients_with_any_pct"),
    )


def plausible_range(
    table: DataFrame,
    by: str,
    variables: Sequence[str],
    bounds: Mapping[str, tuple[float, float]] = PLAUSIBLE_RANGE,
) -> DataFrame:
    """Observed range and out-of-range counts; evidence only, nothing is clipped.

    The bounds are a fixed small mapping and enter as literals, so the table is
    aggregated in one pass and never unpivoted row by row.
    """
    aggs = []
    for v in variables:
        x, (low, high) = F.col(v), bounds[v]
        aggs.append(
            F.struct(
                F.lit(v).alias("variable"),
                F.lit(float(low)).alias("low"),
                F.lit(float(high)).alias("high"),
                F.count(x).alias("n"),
                F.min(x).alias("observed_min"),
                F.max(x).alias("observed_max"),
                count_where((x < low) | (x > high)).alias("n_out"),
            ).alias(f"_s_{v}")
        )
    per_site = table.groupBy(by).agg(*aggs)
    long = per_site.select(by, F.inline(F.array(*[f"_s_{v}" for v in variables])))
    return long.withColumn("out_pct", ratio(F.lit(100.0) * F.col("n_out"), F.col("n")))
