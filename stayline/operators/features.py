"""Backward-looking features: every value at hour t uses rows at hours <= t only.

Rows are laid out in hour blocks with a halo (see `blocks`), so trailing frames
are exact and no window partition grows with a stay. What lies before the block
(last measured hour and value) arrives as a per-block summary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.operators.blocks import (
    BLOCK,
    HALO,
    block_hours,
    deal,
    hour_block,
    join_blocks,
    prior_summary,
    with_halo,
)
from stayline.spec import STATISTICS, WINDOWS, PanelSpec


#: Measured on stored panels, eight cores: 1,049,414 hours of 5 variables take 12 to 14 s wide and 22 s as rows, 57,000
#: hours of 34 variables 28 s wide (the generated code grows too long) and 10 s as rows.
WIDE_UP_TO = 5


def missing_flag(x: Column) -> Column:
    return x.isNull().cast("int")


def _recent(x: Column, hour: str, frame) -> Column:
    """The measured values of a trailing frame in order, with their hours.

    All statistics of all shorter windows come from this list. A mostly missing
    variable has short lists, while a frame of Spark's adds up all its rows for
    every statistic again.
    """
    # No two rows share an hour, so the sorted set is the list.
    reading = F.when(x.isNotNull(), F.struct(F.col(hour).alias("h"), x.cast("double").alias("x")))
    return F.sort_array(F.collect_set(reading).over(frame))


def _within(recent: Column, hour: str, n: int) -> Column:
    """The part of a list that lies in the last `n` hours."""
    return F.when(F.size(recent) == 0, recent).otherwise(F.filter(recent, lambda e: e["h"] > F.col(hour) - F.lit(n)))


def _slope(part: Column, hour: str) -> Column:
    """Least squares on the hour position: values from the first one, hours from the row's own, so sums stay small."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("t", "x", "tt", "tx")])

    def add(a: Column, e: Column) -> Column:
        t, x = (e["h"] - F.col(hour)).cast("double"), e["x"] - part[0]["x"]
        return F.struct(
            (a["t"] + t).alias("t"), (a["x"] + x).alias("x"), (a["tt"] + t * t).alias("tt"), (a["tx"] + t * x).alias("tx")
        )

    n = F.size(part)
    return F.aggregate(part, zero, add, lambda a: (n * a["tx"] - a["t"] * a["x"]) / (n * a["tt"] - a["t"] * a["t"]))


def trailing(stat: str, part: Column, hour: str) -> Column:
    """One statistic of the measured values of a window, a list of (h, x). The slope is null below two points."""
    x, n = part["x"], F.size(part)
    return {
        "min": lambda: F.array_min(x),
        "max": lambda: F.array_max(x),
        "mean": lambda: F.when(n > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n),
        "last": lambda: F.when(n > 0, x[n - 1]),
        "slope": lambda: F.when(n > 1, _slope(part, hour)),
    }[stat]()


def _parts(rows: DataFrame, names: Sequence[str], hour: str, w, windows: Sequence[int]) -> DataFrame:
    """Add `_in_<name>_<n>`: the measured values of each column in each window."""
    longest = max(windows)
    frame = w.rowsBetween(-(longest - 1), 0)
    lists = {f"_in_{x}_{longest}": _recent(F.col(x), hour, frame) for x in names}
    shorter = {f"_in_{x}_{n}": _within(F.col(f"_in_{x}_{longest}"), hour, n) for x in names for n in windows if n != longest}
    return rows.withColumns(lists).withColumns(shorter)


def measured_before(spec: PanelSpec, hour: Column, values: bool) -> dict[str, tuple[Column, str]]:
    """For `prior_summary`: `_ph_` and `_pv_`, the last measured hour and value of each variable."""
    summary = {}
    for v in spec.variables:
        at = F.when(F.col(v).isNotNull(), hour)
        summary[f"_ph_{v}"] = (F.max(at), "last")
        if values:
            summary[f"_pv_{v}"] = (F.max_by(F.col(v), at), "last")
    return summary


def _in_blocks(
    panel: DataFrame, spec: PanelSpec, columns: Sequence[str], lookback: int, before: Sequence[str] = ()
) -> DataFrame:
    """The rows dealt out by block, each block with the `lookback` hours before it, and the summaries named in `before`.

    A panel made in blocks has `_block`, `_halo` and the summaries of all of
    `measured_before` among its columns: its rows stay where they are. They must
    come with at least `lookback` hours before each block.
    """
    if BLOCK in panel.columns:
        return panel.select(*columns, BLOCK, HALO, *[f"{b}{v}" for b in before for v in spec.variables])
    rows = deal(with_halo(panel.select(*columns), spec.hour, lookback), *spec.key, BLOCK)
    if not before:
        return rows
    block = hour_block(F.col(spec.hour), block_hours(lookback))
    summary = measured_before(spec, F.col(spec.hour), "_pv_" in before)
    return join_blocks(rows, prior_summary(panel, spec.key, block, summary), [*spec.key, BLOCK])


def recency(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add `_missing`, `_hours_since_measured` and `_last` for every variable."""
    side = [BLOCK, HALO, *[f"{b}{v}" for b in ("_ph_", "_pv_") for v in spec.variables]]
    own = [c for c in panel.columns if c not in side]
    joined = _in_blocks(panel, spec, own, 0, ("_ph_", "_pv_"))
    upto = (
        W.partitionBy(*spec.key, BLOCK)
        .orderBy(spec.hour)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    out = []
    for v in spec.variables:
        at = F.when(F.col(v).isNotNull(), F.col(spec.hour))
        last_at = F.coalesce(F.last(at, ignorenulls=True).over(upto), F.col(f"_ph_{v}"))
        out += [
            missing_flag(F.col(v)).alias(f"{v}_missing"),
            (F.col(spec.hour) - last_at).cast("int").alias(f"{v}_hours_since_measured"),
            F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_pv_{v}")).alias(f"{v}_last"),
        ]
    return joined.select(*own, HALO, *out).filter(~F.col(HALO)).drop(HALO)


def minimal_features(panel: DataFrame, spec: PanelSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Baseline set: missing flags, carried-forward values and model statics, and the columns in `keep`."""
    return recency(panel, spec).select(
        *spec.side, *[F.col(c).cast("double").alias(c) for c in spec.minimal_feature_columns()], *keep
    )


def window_features_long(
    panel: DataFrame,
    spec: PanelSpec,
    windows: Sequence[int] = WINDOWS,
    statistics: Sequence[str] = STATISTICS,
    with_recency: bool = True,
    wide_up_to: int = WIDE_UP_TO,
) -> DataFrame:
    """Trailing statistics, one row per (entity, hour, variable).

    Only the wide rows are shuffled, once, by (site, entity, block). Up to
    `wide_up_to` variables their windows run on the wide rows, which are then
    turned long; with more of them the rows are turned long first, and the
    windows by variable run with small generated code. The generator keeps the
    partitioning.
    """
    carried = [*spec.side, *[c for c in spec.model_static if c not in spec.side]]
    rows = _in_blocks(panel, spec, [*carried, *spec.variables], max(windows) - 1, ("_ph_",) if with_recency else ())
    w = W.partitionBy(*spec.key, BLOCK).orderBy(spec.hour)
    if len(spec.variables) <= wide_up_to:
        wide = _parts(_since(rows, spec.variables, spec, w) if with_recency else rows, spec.variables, spec.hour, w, windows)
        each = [
            F.struct(
                F.lit(i).alias("var_index"), F.lit(v).alias("variable"),
                *([F.col(f"_missing_{v}").alias("missing"), F.col(f"_since_{v}").alias("hours_since_measured")] if with_recency else []),
                *[trailing(s, F.col(f"_in_{v}_{n}"), spec.hour).alias(f"{s}_{n}") for n in windows for s in statistics],
            )
            for i, v in enumerate(spec.variables)
        ]
        return wide.filter(~F.col(HALO)).select(*carried, BLOCK, F.inline(F.array(*each)))
    readings = F.array(
        *[
            F.struct(
                F.lit(i).alias("var_index"),
                F.lit(v).alias("variable"),
                F.col(v).cast("double").alias("x"),
                (F.col(f"_ph_{v}") if with_recency else F.lit(None).cast("int")).alias("_ph_x"),
            )
            for i, v in enumerate(spec.variables)
        ]
    )
    long = rows.select(*carried, BLOCK, HALO, F.inline(readings))
    w = W.partitionBy(*spec.key, BLOCK, "var_index").orderBy(spec.hour)
    parts = _parts(_since(long, ["x"], spec, w) if with_recency else long, ["x"], spec.hour, w, windows)
    recency_cols = [F.col("_missing_x").alias("missing"), F.col("_since_x").alias("hours_since_measured")] if with_recency else []
    stats = [trailing(s, F.col(f"_in_x_{n}"), spec.hour).alias(f"{s}_{n}") for n in windows for s in statistics]
    return parts.filter(~F.col(HALO)).select(*carried, BLOCK, "var_index", "variable", *recency_cols, *stats)


def _since(rows: DataFrame, names: Sequence[str], spec: PanelSpec, w) -> DataFrame:
    """Add `_missing_` and `_since_`: hours since each column was measured, in this block or by `_ph_` before it."""
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    added = {}
    for x in names:
        at = F.when(F.col(x).isNotNull(), F.col(spec.hour))
        last_at = F.coalesce(F.last(at, ignorenulls=True).over(upto), F.col(f"_ph_{x}"))
        added |= {f"_missing_{x}": missing_flag(F.col(x)), f"_since_{x}": (F.col(spec.hour) - last_at).cast("int")}
    return rows.withColumns(added)


def _by_hour(panel: DataFrame, spec: PanelSpec, windows: Sequence[int]) -> DataFrame:
    """Side columns, statics, and `_v`: one array of values per variable.

    The per-variable rows of an hour already sit in one partition, so this
    grouping adds no shuffle; a group is as long as the variable list.
    """
    long = window_features_long(panel, spec, windows, wide_up_to=0)
    values = ["missing", "hours_since_measured", *[f"{s}_{n}" for n in windows for s in STATISTICS]]
    per_var = F.struct("var_index", F.array(*[F.col(c).cast("double") for c in values]).alias("a"))
    carried = [c for c in (spec.label, *spec.model_static) if c not in spec.key]
    grouped = long.groupBy(*spec.key, BLOCK, spec.hour).agg(
        *[F.first(c).alias(c) for c in carried], F.sort_array(F.collect_list(per_var)).alias("_v")
    )
    statics = F.array(*[F.col(c).cast("double") for c in spec.model_static])
    return grouped.select(*spec.side, F.col("_v.a").alias("_v"), statics.alias("_s"))


def feature_arrays(
    panel: DataFrame, spec: PanelSpec, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """Side columns plus `features`: one double array in the frozen column order."""
    width = len(STATISTICS)

    def part(start: int, length: int) -> Column:
        return F.flatten(F.transform("_v", lambda a: F.slice(a, start, length)))

    parts = [part(1, 2)] + [part(3 + i * width, width) for i in range(len(windows))]
    return _by_hour(panel, spec, windows).select(*spec.side, F.concat(*parts, "_s").alias("features"))


def _wide_features(panel: DataFrame, spec: PanelSpec, windows: Sequence[int]) -> DataFrame:
    """All variables of an hour stay in one row: one shuffle, one sort, no grouping back."""
    carried = [*spec.side, *[c for c in spec.model_static if c not in spec.side]]
    rows = _in_blocks(panel, spec, [*carried, *spec.variables], max(windows) - 1, ("_ph_",))
    w = W.partitionBy(*spec.key, BLOCK).orderBy(spec.hour)
    rows = _parts(_since(rows, spec.variables, spec, w), spec.variables, spec.hour, w, windows)
    features = {c: F.col(c) for c in spec.model_static}
    for v in spec.variables:
        features |= {f"{v}_missing": F.col(f"_missing_{v}"), f"{v}_hours_since_measured": F.col(f"_since_{v}")}
        features |= {f"{v}_{s}_{n}": trailing(s, F.col(f"_in_{v}_{n}"), spec.hour) for n in windows for s in STATISTICS}
    columns = [features[c].cast("double").alias(c) for c in spec.window_feature_columns(windows)]
    return rows.filter(~F.col(HALO)).select(*spec.side, *columns)


def window_features(
    panel: DataFrame, spec: PanelSpec, windows: Sequence[int] = WINDOWS, wide_up_to: int = WIDE_UP_TO
) -> DataFrame:
    """The full wide set, in frozen order.

    Up to `wide_up_to` variables the rows stay wide; with more of them the
    variables become rows, and every column is a plain array access.
    """
    names = spec.window_feature_columns(windows)
    if len(spec.variables) <= wide_up_to:
        return _wide_features(panel, spec, windows)
    n, width = len(spec.variables), len(STATISTICS)
    slots = [f"_v[{v}][{j}]" for v in range(n) for j in (0, 1)]
    slots += [
        f"_v[{v}][{2 + i * width + j}]"
        for i in range(len(windows))
        for v in range(n)
        for j in range(width)
    ]
    slots += [f"_s[{i}]" for i in range(len(spec.model_static))]
    return _by_hour(panel, spec, windows).selectExpr(
        *spec.side, *[f"{slot} AS `{name}`" for slot, name in zip(slots, names, strict=True)]
    )


def design_matrix(
    panel: DataFrame, feature_fn: Callable[[DataFrame, PanelSpec], DataFrame], spec: PanelSpec
) -> DataFrame:
    """Side columns first, then the features of any builder."""
    frame = feature_fn(panel, spec)
    return frame.select(*spec.side, *[c for c in frame.columns if c not in spec.side])


def observed_counts(design: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_observed) over the frame: one scan, one row per column."""
    counted = design.agg(*[F.count(c).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "feature", "n_observed")


def observable_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with a value somewhere in train; apply the same list elsewhere."""
    row = train.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 0]
