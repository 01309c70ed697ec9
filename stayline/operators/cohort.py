"""Validation, hour index, inclusion, and splits by whole entity."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import count_where, hash_block, seeded_hash
from stayline.operators.blocks import join_blocks, row_numbers
from stayline.spec import CONFIG, PanelSpec

CLOCK_BLOCK = 4096


# -- raw records ---------------------------------------------------------------


def read_violations(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rule breaches per entity: one row per (site, entity, rule) with a count.

    Clock duplicates are counted on (entity, clock) groups that were partially
    aggregated first, so a hot entity does not land in one task.
    """
    label, clock = F.col(spec.label), F.col(spec.clock)
    per_clock = raw.groupBy(*spec.key, spec.clock).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(label.isNull()).alias("label_null"),
        count_where(label.isNotNull() & ~label.isin(0, 1)).alias("label_not_binary"),
    )
    per_entity = per_clock.groupBy(*spec.key).agg(
        F.sum("label_null").alias("label_null"),
        F.sum("label_not_binary").alias("label_not_binary"),
        F.sum(F.when(clock.isNull(), F.col("n")).otherwise(0)).alias("clock_null"),
        F.sum(F.when(clock.isNotNull(), F.col("n") - 1).otherwise(0)).alias("clock_duplicate"),
    )
    rules = ["label_null", "label_not_binary", "clock_null", "clock_duplicate"]
    return per_entity.unpivot(spec.key, rules, "rule", "n_rows").filter("n_rows > 0")


def require_valid(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Strict mode: raise on the first breaches, otherwise hand the frame back."""
    found = read_violations(raw, spec).limit(5).collect()
    if found:
        raise ValueError("invalid records: " + "; ".join(str(r.asDict()) for r in found))
    return raw


def index_hours(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add `hour`: 0-based position by clock within the entity, not the clock itself."""
    block = F.floor(F.col(spec.clock) / F.lit(CLOCK_BLOCK)).cast("bigint")
    numbered = row_numbers(raw, spec.key, [spec.clock], block, "_n")
    return numbered.withColumn(spec.hour, (F.col("_n") - 1).cast("int")).drop("_n")


def build_cohort(*sites: DataFrame, spec: PanelSpec) -> DataFrame:
    """Stack the sites and cluster the rows: one entity lies in one file (two for a very long one), in order.

    File statistics on site and entity then prune reads of an entity.
    """
    out = sites[0]
    for other in sites[1:]:
        out = out.unionByName(other)
    order = [spec.site, spec.entity, spec.hour]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


# -- inclusion -----------------------------------------------------------------


def entity_hours(cohort: DataFrame, spec: PanelSpec) -> DataFrame:
    return cohort.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n_hours"))


def apply_inclusion(
    cohort: DataFrame, spec: PanelSpec, min_hours: int = CONFIG.min_hours
) -> DataFrame:
    """Keep whole entities with enough rows; rows are never dropped one by one."""
    kept = entity_hours(cohort, spec).filter(F.col("n_hours") >= min_hours)
    return cohort.join(kept, spec.key, "left_semi")


def inclusion_report(
    cohort: DataFrame, spec: PanelSpec, min_hours: int = CONFIG.min_hours, flag_above: float = 3.0
) -> DataFrame:
    """What the inclusion rule takes away, per site.

    Entities and hours are two units of one long table, so each share is worked
    out once; the site's line puts both units side by side.
    """
    short = F.col("n_hours") < min_hours
    sizes = entity_hours(cohort, spec)
    units = F.array(
        F.struct(F.lit("patients").alias("unit"), F.lit(1).cast("bigint").alias("size")),
        F.struct(F.lit("hours").alias("unit"), F.col("n_hours").alias("size")),
    )
    long = sizes.select(spec.site, short.alias("_short"), F.inline(units)).groupBy(spec.site, "unit")
    lost = long.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("_short"), F.col("size")).otherwise(0)).alias("lost"))
    share = F.lit(100.0) * F.col("lost") / F.col("all")
    # Output names are fixed values.
    columns = {"before": F.col("all"), "after": F.col("all") - F.col("lost"), "dropped": F.col("lost"), "dropped_pct": share}
    wide = lost.groupBy(spec.site).agg(
        *[F.max(F.when(F.col("unit") == u, c)).alias(f"{u}_{n}") for n, c in columns.items() for u in ("patients", "hours")]
    )
    return wide.withColumn("flagged", (F.col("patients_dropped_pct") > flag_above).cast("int"))


# -- seeded splits -------------------------------------------------------------


def ranked_entities(cohort: DataFrame, spec: PanelSpec, seed) -> DataFrame:
    """Distinct entities of each site in seeded order: (site, entity, seed_rank).

    The order is that of md5(seed:id), so it depends on the set of ids and the
    seed only. Ranks are built over even hash cells, not one window per site.
    """
    ids = cohort.select(*spec.key).distinct().withColumn("_h", seeded_hash(seed, F.col(spec.entity)))
    return row_numbers(
        ids, [spec.site], ["_h", spec.entity], hash_block(F.col("_h")), "seed_rank"
    ).drop("_h")


def split_entities(
    cohort: DataFrame,
    spec: PanelSpec,
    fractions: Mapping[str, float],
    names: Mapping[str, tuple[str, str]],
    seed: int = CONFIG.seed,
) -> DataFrame:
    """(site, entity, split) for all sites in one pass.

    The first part gets round-half-even(fraction * n) entities, at least 1 and
    at most n - 1.
    """
    for site, f in fractions.items():
        if not 0.0 < f < 1.0:
            raise ValueError(f"fraction of site {site} must be in (0, 1), got {f}")
    ranked = ranked_entities(cohort, spec, seed).filter(F.col(spec.site).isin(*fractions))
    sizes = ranked.groupBy(spec.site).agg(F.max("seed_rank").alias("_n"))
    site = F.col(spec.site)

    def by_site(values: Mapping[str, object]) -> Column:
        pairs = [F.when(site == s, F.lit(v)) for s, v in values.items()]
        return F.coalesce(*pairs)

    wanted = F.bround(by_site(fractions) * F.col("_n"), 0).cast("bigint")
    n_first = F.least(F.greatest(wanted, F.lit(1)), F.col("_n") - 1)
    first = by_site({s: n[0] for s, n in names.items()})
    second = by_site({s: n[1] for s, n in names.items()})
    return ranked.join(sizes, spec.site).select(
        *spec.key, F.when(F.col("seed_rank") <= n_first, first).otherwise(second).alias("split")
    )


def split_sites(cohort: DataFrame, spec: PanelSpec, config=CONFIG) -> DataFrame:
    """The study's two splits: A into a_train/a_val, B into b_train/b_eval."""
    return split_entities(
        cohort,
        spec,
        {"A": config.train_fraction, "B": config.held_out_train_fraction},
        {"A": ("a_train", "a_val"), "B": ("b_train", "b_eval")},
        config.seed,
    )


def with_split(cohort: DataFrame, splits: DataFrame, spec: PanelSpec) -> DataFrame:
    return join_blocks(cohort, splits, spec.key)


def require_sites(cohort: DataFrame, spec: PanelSpec, *sites: str) -> DataFrame:
    """Raise if one of the sites has no rows."""
    for site in sites:
        if cohort.filter(F.col(spec.site) == site).limit(1).count() == 0:
            raise ValueError(f"no rows for site {site}")
    return cohort


def held_out(cohort: DataFrame, spec: PanelSpec, site: str = "B") -> DataFrame:
    """The held-out site; says so on every access."""
    warnings.warn(f"site {site} is held out: use it for scoring only", UserWarning, stacklevel=2)
    return cohort.filter(F.col(spec.site) == site)


def split_overlap(splits: DataFrame, spec: PanelSpec) -> DataFrame:
    """Entities found in more than one split (none, if the split is right)."""
    return (
        splits.select(*spec.key, "split")
        .distinct()
        .groupBy(*spec.key)
        .agg(F.count(F.lit(1)).alias("n_splits"))
        .filter("n_splits > 1")
    )


def assert_disjoint(splits: DataFrame, spec: PanelSpec) -> None:
    row = split_overlap(splits, spec).limit(1).collect()
    if row:
        raise AssertionError(f"entity {row[0][spec.entity]} is in {row[0]['n_splits']} splits")


def draw_seed(n: int, draw: int, seed: int = CONFIG.seed) -> int:
    """One seed per (n, draw) of the transfer curve."""
    return seed + 17 * n + 101 * draw


def draw_entities(
    cohort: DataFrame, spec: PanelSpec, n: int, seed: int, strict: bool = True
) -> DataFrame:
    """`n` whole entities without replacement, over all sites of `cohort`.

    Only the ids are ordered: a top-n over (hash, id), which Spark merges from
    per-task heads, so no shuffle of the whole id list is needed.
    """
    ids = cohort.select(*spec.key).distinct()
    if strict:
        available = ids.count()
        if n > available:
            raise ValueError(f"cannot draw {n} entities from {available}")
    return ids.orderBy(seeded_hash(seed, F.col(spec.entity)), *spec.key).limit(n)


def draw_overlap(draw: DataFrame, evaluation: DataFrame, spec: PanelSpec) -> DataFrame:
    """Entities both adapted to and scored on."""
    return draw.select(*spec.key).intersect(evaluation.select(*spec.key))


def assert_adaptation_disjoint(draw: DataFrame, evaluation: DataFrame, spec: PanelSpec) -> None:
    row = draw_overlap(draw, evaluation, spec).limit(1).collect()
    if row:
        raise AssertionError(f"entity {row[0][spec.entity]} is adapted to and scored on")


def sample_rows(rows: DataFrame, keys: list[str], k: int, seed: int = CONFIG.seed) -> DataFrame:
    """Fixed-size seeded row sample: the k smallest md5 of the row key.

    Unlike `sample()`, the outcome does not depend on partitioning.
    """
    digest = seeded_hash(seed, *[F.col(c) for c in keys])
    return rows.orderBy(digest, *keys).limit(k)
