"""Metrics of scored rows.

Input: any group columns plus (site, entity, hour, label, score). Groups (cells,
subgroups, draws, arms) are columns, so one job evaluates all of them.

The published time-dependent utility is kept in units of 1/180: all its values
are then whole numbers, so sums are exact and do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.functions.expr import count_where, ratio, threshold_bucket, value_block
from stayline.operators.blocks import join_groups, join_summary, plain_keys, running_totals
from stayline.spec import AGE_BANDS, MIN_POSITIVES, PanelSpec

# Published utility settings, hours relative to the event time,
# and weights 1, -2, -0.05, 0 in units of 1/180.
LEAD = 6
EARLY, OPTIMAL, LATE = -12, -6, 3
UNITS = 180
TRUE_ALERT, MISSED, FALSE_ALERT = 180, -360, -9

# Bin edges as multiples of 0.1 in floating point.
BIN_EDGES = tuple(i * 0.1 for i in range(10)) + (1.0,)


def _unusable(label: str, score: str) -> Column:
    return F.col(label).isNull() | F.col(score).isNull() | ~F.col(label).isin(0, 1)


def require_scored(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Refuse an empty frame, a null or a label other than 0/1."""
    bad = _unusable(label, score)
    row = scored.agg(F.count(F.lit(1)).alias("n"), count_where(bad).alias("bad")).first()
    if row["n"] == 0:
        raise ValueError(NO_ROWS)
    if row["bad"]:
        raise ValueError(f"{BAD_ROWS}{row['bad']}")
    return scored


NO_ROWS = "nothing to score: the frame has no rows"
BAD_ROWS = "rows without a 0/1 label or without a score: "
ALL = "_all"  # stand-in group when the caller names none


# -- ranking -------------------------------------------------------------------


def rank_metrics(scored: DataFrame, groups: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Tie-aware AUROC and average precision per group; null with one class.

    Rows collapse to distinct scores before any ordering (map-side too), then
    exact running totals give the true positives above each score.
    """
    y = F.col(label).cast("bigint")
    ties = scored.groupBy(*groups, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("all"))
    above = running_totals(
        ties, groups, score, ["pos", "all"], value_block(F.col(score)), descending=True
    )
    neg = (F.col("all") - F.col("pos")).cast("double")
    pairs = neg * (F.lit(2.0) * F.col("cum_pos") - F.col("pos"))
    precision = F.col("pos") * (F.col("cum_pos").cast("double") / F.col("cum_all"))
    sums = above.groupBy(*groups).agg(
        F.sum(pairs).alias("_pairs"),
        F.sum(precision).alias("_precision"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum(neg).alias("_n"),
    )
    two_classes = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *groups,
        ratio(F.col("_pairs"), F.lit(2.0) * F.col("_p") * F.col("_n")).alias("auroc"),
        F.when(two_classes, ratio(F.col("_precision"), F.col("_p"))).alias("auprc"),
    )


# -- utility -------------------------------------------------------------------


def onsets(scored: DataFrame, entity: Sequence[str], label: str = "label", hour: str = "hour") -> DataFrame:
    """First positive hour per entity, null for an entity that never turns positive."""
    return scored.groupBy(*entity).agg(
        F.min(F.when(F.col(label) == 1, F.col(hour))).cast("bigint").alias("onset")
    )


def utility_units(predicted: int, hour: Column, onset: Column) -> Column:
    """Units (1/180) earned by predicting 1 or 0 at a row position."""
    dt = hour.cast("bigint") - onset - F.lit(LEAD)
    up, down = TRUE_ALERT // (OPTIMAL - EARLY), TRUE_ALERT // (LATE - OPTIMAL)
    if predicted:
        never = F.lit(FALSE_ALERT)
        early = F.greatest((dt - EARLY) * F.lit(up), F.lit(FALSE_ALERT))
        late = (F.lit(LATE) - dt) * F.lit(down)
    else:
        never, early = F.lit(0), F.lit(0)
        late = (dt - OPTIMAL) * F.lit(MISSED // (LATE - OPTIMAL))
    value = F.when(onset.isNull(), never).when(dt <= OPTIMAL, early).when(dt <= LATE, late)
    return value.otherwise(F.lit(0)).cast("bigint")


def with_onset(scored: DataFrame, entity: Sequence[str], label: str = "label", hour: str = "hour", name: str = "onset") -> DataFrame:
    """Add the onset of its entity to every row.

    Onsets are aggregated map-side and joined back; only the row side can be
    skewed there, and AQE splits it.
    """
    # Aggregated by the same never-null stand-ins that are joined on, so the aggregate is shuffled once.
    marked, on = plain_keys(scored, entity)
    of_entity = onsets(marked, on, label, hour).withColumnRenamed("onset", name)
    return join_summary(marked, of_entity, on).select(*scored.columns, name)


def with_utility(
    scored: DataFrame, entity: Sequence[str], label: str = "label", hour: str = "hour", onset: str | None = None
) -> DataFrame:
    """Add `onset`, `u_alert`, `u_quiet` and `u_best` (units) to every row.

    `onset` names the column of an onset that the rows have already (see `with_onset`).
    """
    joined = with_onset(scored, entity, label, hour) if onset is None else scored.withColumnRenamed(onset, "onset")
    h, at = F.col(hour), F.col("onset")
    alert, quiet = utility_units(1, h, at), utility_units(0, h, at)
    dt = h - at - F.lit(LEAD)
    best = F.when((dt >= EARLY) & (dt <= LATE), alert).otherwise(quiet)
    return joined.select(
        "*", alert.alias("u_alert"), quiet.alias("u_quiet"), best.alias("u_best")
    )


def row_utility(scored: DataFrame, entity: Sequence[str], threshold: Column) -> DataFrame:
    """Per-row prediction and its utility at a threshold."""
    rows = with_utility(scored, entity)
    predicted = F.col("score") >= threshold
    return rows.select(
        *scored.columns,
        predicted.cast("int").alias("predicted"),
        (F.when(predicted, F.col("u_alert")).otherwise(F.col("u_quiet")) / F.lit(float(UNITS))).alias("utility"),
    )


def normalised(observed: Column, inaction: Column, best: Column) -> Column:
    return ratio((observed - inaction).cast("double"), (best - inaction).cast("double"))


# -- one record per group --------------------------------------------------------


def evaluate(
    scored: DataFrame,
    groups: Sequence[str],
    threshold: Column,
    entity: Sequence[str] = ("site", "entity"),
    onset: str | None = None,
) -> DataFrame:
    """The metric record: the only place a reported number comes from.

    `threshold` may be a literal or a column constant within each group. The
    query fails on an empty frame and on rows without a 0/1 label or a score;
    they are counted in the same aggregation. A null group is a group. Groups
    that hold the same labels can bring the onsets along in a column `onset`.
    """
    if not groups:
        whole = evaluate(scored.withColumn(ALL, F.lit(1)), [ALL], threshold, entity, onset)
        return whole.drop(ALL)
    groups = list(groups)
    rows = with_utility(scored, [*groups, *entity], onset=onset).withColumn("_t", threshold)
    y, hit = F.col("label") == 1, F.col("score") >= F.col("_t")
    # Entities are counted as the groups of a first, map-side combined level.
    per_entity = rows.groupBy(*groups, *entity).agg(
        F.count(F.lit(1)).alias("n_hours"),
        count_where(_unusable("label", "score")).alias("_bad"),
        count_where(y).alias("n_positives"),
        count_where(hit).alias("n_alerts"),
        count_where(hit & y).alias("tp"),
        F.sum(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("_se"),
        F.sum(F.when(hit, F.col("u_alert")).otherwise(F.col("u_quiet"))).alias("_observed"),
        F.sum("u_quiet").alias("_inaction"),
        F.sum("u_best").alias("_best"),
        F.max("_t").alias("threshold"),
    )
    sums = per_entity.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_patients"),
        *[F.sum(c).alias(c) for c in
          ("n_hours", "_bad", "n_positives", "n_alerts", "tp", "_se", "_observed", "_inaction", "_best")],
        F.max("threshold").alias("threshold"),
    )
    sums = _refuse_unusable(sums)
    n, tp = F.col("n_hours"), F.col("tp")
    fp, fn = F.col("n_alerts") - tp, F.col("n_positives") - tp
    record = sums.select(
        *groups, "threshold", "n_patients", "n_hours", "n_positives", "n_alerts",
        ratio(F.col("n_positives").cast("double"), n).alias("prevalence"),
        ratio((n - fp - fn).cast("double"), n).alias("accuracy"),
        ratio(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn).alias("f_measure"),
        ratio(F.col("_se"), n).alias("brier"),
        ratio(F.lit(2400.0) * F.col("n_alerts"), n).alias("alerts_per_100_days"),
        normalised(F.col("_observed"), F.col("_inaction"), F.col("_best")).alias("utility"),
    )
    return _refuse_empty(join_groups(record, rank_metrics(scored, groups), groups), sums)


def _refuse_unusable(sums: DataFrame) -> DataFrame:
    """Fail the query if any group has bad rows."""
    message = F.concat(F.lit(BAD_ROWS), F.col("_bad").cast("string"))
    return sums.withColumn("n_hours", F.when(F.col("_bad") > 0, F.raise_error(message).cast("bigint")).otherwise(F.col("n_hours")))


def _refuse_empty(record: DataFrame, sums: DataFrame) -> DataFrame:
    """Fail the query if there is no group at all.

    The check is united with the finished record: inside a join Spark may skip
    it once it sees that the other side is empty.
    """
    none = sums.agg(F.count(F.lit(1)).alias("n_hours"))
    none = none.where(F.when(F.col("n_hours") == 0, F.raise_error(F.lit(NO_ROWS)).cast("boolean")).otherwise(F.lit(False)))
    return record.unionByName(none, allowMissingColumns=True)


def reliability(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Ten left-closed bins (the last closes at 1), empty ones kept with nulls."""
    edges = F.array(*[F.lit(e) for e in BIN_EDGES[1:-1]])
    bin_of = F.size(F.filter(edges, lambda e: F.col("score") >= e))
    filled = scored.groupBy(*groups, bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_prediction"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
    )
    present = filled.select(*groups).distinct()
    all_bins = present.select(*groups, F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    names = F.array(*[F.lit(f"{a:.2f}-{b:.2f}") for a, b in zip(BIN_EDGES, BIN_EDGES[1:])])
    return join_groups(all_bins, filled, [*groups, "bin"], "left").select(
        *groups, names[F.col("bin")].alias("bin"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_prediction", "positive_rate",
    )


# -- threshold sweeps -------------------------------------------------------------


def sweep(
    scored: DataFrame,
    groups: Sequence[str],
    entity: Sequence[str] = ("site", "entity"),
    steps: int = 100,
) -> DataFrame:
    """Every threshold k/steps (k = 1..steps-1) in one pass over the rows.

    Utility is additive per row, so rows collapse to at most steps + 1 buckets
    and the rest runs on those.
    """
    if not groups:
        return sweep(scored.withColumn(ALL, F.lit(1)), [ALL], entity, steps).drop(ALL)
    groups = list(groups)
    rows = with_utility(scored, [*groups, *entity])
    y = F.col("label").cast("bigint")
    per_bucket = rows.groupBy(*groups, threshold_bucket(F.col("score"), steps).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"),
        F.sum("u_alert").alias("ua"), F.sum("u_quiet").alias("uq"), F.sum("u_best").alias("ub"),
    )
    ks = per_bucket.select(*groups).distinct().select(*groups, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    filled = join_groups(ks, per_bucket, [*groups, "k"], "left").fillna(0, ["n", "pos", "ua", "uq", "ub"])
    up = W.partitionBy(*groups).orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    below = W.partitionBy(*groups).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*groups)
    out = filled.select(
        *groups, "k",
        F.sum("n").over(up).alias("n_alerts"),
        F.sum("pos").over(up).alias("tp"),
        (F.sum("ua").over(up) + F.coalesce(F.sum("uq").over(below), F.lit(0))).alias("_u"),
        F.sum("uq").over(every).alias("_inaction"),
        F.sum("ub").over(every).alias("_best"),
        F.sum("n").over(every).alias("n_hours"),
        F.sum("pos").over(every).alias("n_positives"),
    ).filter((F.col("k") >= 1) & (F.col("k") < steps))
    return out.select(
        *groups,
        (F.col("k") / F.lit(float(steps))).alias("threshold"),
        ratio(F.col("tp").cast("double"), F.col("n_positives")).alias("sensitivity"),
        ratio(F.col("tp").cast("double"), F.col("n_alerts")).alias("ppv"),
        ratio(F.lit(2400.0) * F.col("n_alerts"), F.col("n_hours")).alias("alerts_per_100_days"),
        normalised(F.col("_u"), F.col("_inaction"), F.col("_best")).alias("utility"),
    )


def best_threshold(swept: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Utility-max threshold; the lowest one wins ties, null utilities are skipped."""
    order = F.struct((-F.col("utility")).alias("u"), F.col("threshold").alias("t"))
    best = swept.filter(F.col("utility").isNotNull()).groupBy(*groups).agg(F.min(order).alias("_b"))
    return best.select(
        *groups, F.col("_b.t").alias("threshold"), (-F.col("_b.u")).alias("utility_at_threshold")
    )


def freeze_threshold(scored: DataFrame, entity: Sequence[str] = ("site", "entity")) -> float:
    """The chosen threshold as a number; an error if no utility is defined."""
    row = best_threshold(sweep(scored, [], entity), []).first()
    if row is None or row["threshold"] is None:
        raise ValueError("no threshold can be frozen: its utility is undefined everywhere")
    return float(row["threshold"])


def operating_row(swept: DataFrame, groups: Sequence[str], threshold: Column) -> DataFrame:
    """The sweep row nearest a frozen threshold (the lower one on a tie)."""
    columns = [c for c in swept.columns if c not in groups]
    # Rounded, so that float noise cannot decide a tie between two neighbours.
    gap = F.round(F.abs(F.col("threshold") - threshold), 12)
    pick = F.min_by(F.struct(*columns), F.struct(gap, F.col("threshold")))
    return swept.groupBy(*groups).agg(pick.alias("_r")).select(*groups, "_r.*")


# -- subgroups -------------------------------------------------------------------


def subgroup_labels(spec: PanelSpec) -> Column:
    """Array of the subgroups a row belongs to: sex, age band, unit."""
    age, gender = F.col(spec.age), F.col(spec.gender)
    labels = [F.when(gender == g, F.lit(f"sex={g}")) for g in (0, 1)]
    for name, low, high in AGE_BANDS:
        inside = age >= low if high is None else (age >= low) & (age < high)
        labels.append(F.when(inside, F.lit(f"age {name}")))
    labels += [F.when(F.col(u) == 1, F.lit(f"Unit{i}=1")) for i, u in enumerate(spec.units, 1)]
    return F.array_compact(F.array(*labels))


def subgroup_metrics(
    scored: DataFrame,
    labels: Column,
    entity: Sequence[str] = ("site", "entity"),
    min_positives: int = MIN_POSITIVES,
) -> DataFrame:
    """AUROC and average precision per subgroup, hidden where support is thin.

    No threshold enters. A group without rows does not appear.
    """
    rows = scored.select(*entity, "label", "score", F.explode(labels).alias("group"))
    per_entity = rows.groupBy("group", *entity).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")
    )
    support = per_entity.groupBy("group").agg(
        F.sum("n").alias("n_hours"),
        F.count(F.lit(1)).alias("n_patients"),
        F.sum("pos").alias("n_positives"),
    )
    thin = (F.col("n_positives") < min_positives) | (F.col("n_positives") == F.col("n_hours"))
    return (
        support.join(rank_metrics(rows, ["group"]), "group")
        .withColumn("suppressed", thin.cast("int"))
        .withColumn("auroc", F.when(F.col("suppressed") == 0, F.col("auroc")))
        .withColumn("auprc", F.when(F.col("suppressed") == 0, F.col("auprc")))
    )
