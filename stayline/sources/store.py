"""Stored cohorts, designs and flat files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from stayline.spec import CLINICAL, PanelSpec


def write_cohort(cohort: DataFrame, path: str, spec: PanelSpec = PanelSpec()) -> None:
    """Parquet by site, so a site filter prunes folders; rows sorted inside files."""
    (
        cohort.sortWithinPartitions(spec.site, spec.entity, spec.hour)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy(spec.site)
        .parquet(path)
    )


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no cohort at {path}: build it first") from error


# -- flat file -------------------------------------------------------------------


def flat_export(
    cohort: DataFrame,
    spec: PanelSpec = PanelSpec(),
    site: str | None = None,
    limit: int | None = None,
    decimals: int = 3,
) -> DataFrame:
    """Rows of the flat file: ids, clock, statics (each once), label, variables.

    `limit` keeps the first entities in id order, whole.
    """
    rows = cohort if site is None else cohort.filter(F.col(spec.site) == site)
    if limit is not None:
        first = rows.select(*spec.key).distinct().orderBy(spec.entity, spec.site).limit(limit)
        rows = rows.join(first, spec.key, "left_semi")
    statics = [c for c in (spec.age, spec.gender, *spec.units) if c in cohort.columns]

    def shown(c: str) -> Column:
        return F.round(F.col(c).cast("double"), decimals).alias(c)

    return rows.select(
        spec.entity, spec.site, F.col(spec.hour).cast("int").alias(spec.hour),
        F.col(spec.clock).cast("int").alias(spec.clock),
        *[shown(c) for c in statics],
        F.col(spec.label).cast("int").alias(spec.label),
        *[shown(v) for v in spec.variables],
    )


def write_flat(flat: DataFrame, path: str, spec: PanelSpec = PanelSpec()) -> None:
    ordered = flat.repartitionByRange(spec.entity, spec.hour).sortWithinPartitions(spec.entity, spec.hour)
    ordered.write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


def read_flat(spark: SparkSession, path: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Columns are found by name; a missing one is an error, extra ones are left out."""
    header = spark.read.option("header", True).csv(path)
    text = [spec.entity, spec.site]
    whole = [spec.hour, spec.clock, spec.label]
    wanted = [*text, *whole, spec.age, spec.gender, *spec.units, *spec.variables]
    missing = [c for c in wanted if c not in header.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return header.select(
        *text, *[F.col(c).cast("int").alias(c) for c in whole],
        *[F.col(c).cast("double").alias(c) for c in wanted if c not in text + whole],
    )


# -- stored designs ----------------------------------------------------------------


def _meta(columns: Sequence[str], windows: Sequence[int], digest: str, n_rows: int) -> str:
    return json.dumps(
        {"columns": list(columns), "windows": list(windows), "input_digest": digest, "n_rows": n_rows}
    )


def write_design(
    design: DataFrame, path: str, columns: Sequence[str], windows: Sequence[int], digest: str
) -> None:
    """Feature parquet first, its description last: a half-written one is not current."""
    spark = design.sparkSession
    if design.limit(1).count() == 0:
        raise ValueError("the design has no rows, so nothing is stored")
    design.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    n = spark.read.parquet(f"{path}/rows").count()
    doc = spark.createDataFrame([(_meta(columns, windows, digest, n),)], "value string")
    doc.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_design(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return spark.read.parquet(f"{path}/rows"), meta


def design_is_current(spark: SparkSession, path: str, columns: Sequence[str], digest: str) -> bool:
    """Complete on disk, same columns in the same order, same input."""
    try:
        rows, meta = read_design(spark, path)
    except AnalysisException:
        return False
    return (
        meta["columns"] == list(columns)
        and meta["input_digest"] == digest
        and rows.count() == meta["n_rows"]
    )


def concatenate_designs(designs: Sequence[DataFrame]) -> DataFrame:
    """Rows of several designs with the same columns in the same order."""
    if not designs:
        raise ValueError("no designs were given")
    out = designs[0]
    for d in designs[1:]:
        if d.columns != out.columns:
            raise ValueError("the designs do not have the same columns in the same order")
        out = out.unionByName(d, allowMissingColumns=False)
    return out


def write_bundles(bundled: DataFrame, path: str) -> None:
    """One JSON document per line."""
    bundled.select("bundle").write.mode("overwrite").text(path)


def new_resources(records: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Records whose idempotency key is not stored yet; loading twice adds nothing."""
    return records.join(stored_keys.select("key").distinct(), "key", "left_anti")
