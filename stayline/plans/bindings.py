"""The driver tables seen as panels.

`events` becomes an hourly panel: entity = user, site = parity of the id, one
variable per event type (the largest value of the hour), label = 1 from the
hour of the user's 15th `error` event on. Two rational scores of exact counts
stand in for model output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.operators.blocks import BLOCK, HALO, join_blocks, prior_summary
from stayline.operators.cohort import split_sites, with_split
from stayline.operators.features import measured_before
from stayline.operators.grid import FIRST, dense_grid, fill_blocks, reading_blocks
from stayline.spec import PanelSpec

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
ONSET_ERRORS = 15
LOOKBACK = 72

EVENTS = PanelSpec(
    entity="user_id",
    clock="clock",
    label="label",
    variables=EVENT_TYPES,
    static=("age", "gender", "unit1", "unit2", "clock"),
    model_static=("age", "gender", "clock"),
    age="age",
    gender="gender",
    units=("unit1", "unit2"),
)
ENTITY = (EVENTS.site, EVENTS.entity)
SCORES = {"A": "score", "B": "score_b", "A+B": "score_ab"}
FROZEN = {"A": 0.59, "B": 0.6, "A+B": 0.55}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_hour(ts):
    """Whole hours since 1970, free of the session time zone for wall-clock types."""
    return F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "*", F.when(user % 2 == 0, "A").otherwise("B").alias("site"), epoch_hour("ts").alias("eh")
    )


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and hour with events: counts, and a value per type."""
    kind = F.col("event_type")
    return (
        events(spark, sf_dir)
        .groupBy("site", "user_id", "eh")
        .agg(
            *[F.max(F.when(kind == t, F.col("value"))).alias(t) for t in EVENT_TYPES],
            F.count(F.lit(1)).alias("n_events"),
            F.sum(F.when(kind == "error", 1).otherwise(0).cast("bigint")).alias("n_errors"),
        )
    )


def _statics():
    user = F.col("user_id")
    unit1 = F.when(user % 5 != 0, (user % 7) % 2)
    return [
        (F.lit(20) + user % 75).cast("int").alias("age"),
        ((user % 3) % 2).cast("int").alias("gender"),
        unit1.cast("int").alias("unit1"),
        (F.lit(1) - unit1).cast("int").alias("unit2"),
    ]


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = dense_grid(hourly_events(spark, sf_dir), list(ENTITY), "eh")
    return grid.fillna(0, ["n_events", "n_errors"])


def event_panel(
    spark: SparkSession, sf_dir: str, scores: bool = False, before: int | None = None, split: bool = False
) -> DataFrame:
    """The labelled panel; with `scores` also the trailing counts and both scores.

    With `split` the split of the entity comes with the summaries of its blocks, so
    that no hour is shuffled for it. With `before` it stays in the blocks it is made in, each with that many hours
    before it and with what was last measured before those (see
    `features.window_features_long`); a label there counts for rows of the block only.
    """
    lookback = LOOKBACK if scores else before or 0
    blocks = reading_blocks(hourly_events(spark, sf_dir), list(ENTITY), "eh", lookback)
    # The row that opens a block keeps it among the summaries.
    own_rows = blocks.filter(~F.col(HALO) | F.col(FIRST).isNotNull())
    summary = {"_errors": (F.sum("n_errors"), "sum")}
    measured = measured_before(EVENTS, F.col("eh"), values=True) if before is not None else {}
    earlier = prior_summary(own_rows, list(ENTITY), F.col(BLOCK), summary | measured)
    if split:
        earlier = with_split(earlier, split_sites(events(spark, sf_dir), EVENTS), EVENTS)
    grid = fill_blocks(blocks, list(ENTITY), "eh", lookback).fillna(0, ["n_events", "n_errors"])
    rows = join_blocks(grid, earlier, [*ENTITY, BLOCK])
    w = W.partitionBy(*ENTITY, BLOCK).orderBy("hour")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    own = F.when(~F.col(HALO), F.col("n_errors")).otherwise(0)
    cols = [(F.sum(own).over(upto) + F.coalesce("_errors", F.lit(0))).alias("ecum")]
    if scores:
        # Counts are whole numbers, so a trailing sum is a difference of running sums.
        rows = rows.withColumn("_n", F.sum("n_events").over(upto))
        cols += [
            (F.col("_n") - F.coalesce(F.lag("_n", n).over(w), F.lit(0))).alias(name)
            for name, n in (("n24", 24), ("n72", LOOKBACK))
        ]
    # The summary counts hours since 1970, a panel from the entity's first one.
    at = {n: (F.col(n) - F.col("eh") + F.col("hour")).cast("int").alias(n) if n.startswith("_ph_") else F.col(n) for n in measured}
    made = rows.select("site", "user_id", "hour", "eh", *EVENT_TYPES, "n_events", "n_errors", BLOCK, HALO, *cols, *at.values(), *(["split"] if split else []))
    kept = made if before is not None else made.filter(~F.col(HALO)).drop(BLOCK, HALO)
    panel = kept.select(
        "*",
        (F.col("hour") + 1).alias("clock"),
        (F.col("ecum") >= ONSET_ERRORS).cast("int").alias("label"),
        *_statics(),
    )
    if not scores:
        return panel
    x = (F.lit(2) * F.col("ecum") + F.lit(3) * F.col("n24") + F.col("n72")).cast("double")
    xb = (F.lit(4) * F.col("ecum") + F.col("n24") + F.col("n72")).cast("double")
    scored = panel.withColumn("score", x / (x + 30)).withColumn("score_b", xb / (xb + 40))
    return scored.withColumn("score_ab", (F.col("score") + F.col("score_b")) / 2)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_panel(spark, sf_dir).select(
        *EVENTS.key, "hour", "clock", *EVENT_TYPES, "label", "age", "gender", "unit1", "unit2"
    )


def cohort_blocks(spark: SparkSession, sf_dir: str, before: int, split: bool = False) -> DataFrame:
    """The cohort in the blocks it is made in (see `event_panel`); features of up to `before` earlier hours shuffle no hours."""
    panel = event_panel(spark, sf_dir, before=before, split=split)
    return panel.drop("eh", "n_events", "n_errors", "ecum")


SCORED = (*EVENTS.key, "hour", "label", "score", "score_b", "score_ab", "age", "gender", "unit1", "unit2")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_panel(spark, sf_dir, scores=True).select(*SCORED)


def scored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_panel(spark, sf_dir, scores=True, split=True).select(*SCORED, "split")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second scored binding: toxic label, length score, site = source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    chars = F.col("n_chars").cast("double")
    return docs.join(labels, "doc_id").select(
        F.col("source").alias("site"), "doc_id", "lang", F.lit(0).alias("hour"),
        F.col("toxic").alias("label"), (chars / (chars + 1000)).alias("score"),
    )
