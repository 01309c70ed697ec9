"""Raw per-stay files: pipe separated, one header, the entity id in the file name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.expr import count_where
from stayline.operators.cohort import index_hours, require_valid
from stayline.spec import CONFIG, RAW_COLUMNS, PanelSpec

# File name pattern, null tokens, separator.
FILE_NAME = r"^(p\d+)\.psv$"
GLOB = "p*.psv"
NULL_TOKENS = ("NaN", "nan", "NA", "")
SEP = "|"


def entity_from_name(name: Column) -> Column:
    """Id from the file name; any other name is an error."""
    found = F.regexp_extract(name, FILE_NAME, 1)
    bad = F.raise_error(F.concat(F.lit("not a record file name: "), name))
    return F.when(found != "", found).otherwise(bad.cast("string"))


def site_from_path(path: Column, sites: Iterable[tuple[str, str]] = CONFIG.sites) -> Column:
    return F.coalesce(*[F.when(path.contains(f"/{folder}/"), F.lit(s)) for s, folder in sites])


def paths(root: str, sites: Iterable[tuple[str, str]] = CONFIG.sites) -> list[str]:
    return [f"{root}/{folder}/{GLOB}" for _, folder in sites]


def read_raw(spark: SparkSession, root: str, spec: PanelSpec = PanelSpec(), sites=CONFIG.sites) -> DataFrame:
    """All files of all sites in one scan; (entity, site) plus the raw columns as doubles.

    A header that differs in name or order fails the read, and so does a cell
    that is neither a number nor a null token. Null tokens become null, not NaN.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", SEP)
        .option("mode", "FAILFAST")
        .csv(paths(root, sites))
    )

    def number(c: str) -> Column:
        cell = F.trim(F.col(c))
        return F.when(~cell.isin(*NULL_TOKENS), cell.cast("double")).alias(c)

    return raw.select(
        entity_from_name(F.col("_metadata.file_name")).alias(spec.entity),
        site_from_path(F.col("_metadata.file_path"), sites).alias(spec.site),
        *[number(c) for c in RAW_COLUMNS],
    )


def _listed(spark: SparkSession, root: str, sites) -> DataFrame:
    """path and length of every record file. Scans skip files of zero bytes, so the names come from Spark's file index."""
    files = spark.read.format("binaryFile").load(paths(root, sites))
    names = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    one_form = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    return names.select(one_form.alias("path")).join(
        files.select(one_form.alias("path"), "length"), "path", "left"
    ).select("path", F.coalesce("length", F.lit(0)).alias("length"))


def list_files(spark: SparkSession, root: str, sites=CONFIG.sites) -> DataFrame:
    """(site, name, length) of every record file, empty ones too; contents are not read."""
    return _listed(spark, root, sites).select(
        site_from_path(F.col("path"), sites).alias("site"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
    )


def empty_files(spark: SparkSession, root: str, raw: DataFrame, spec: PanelSpec = PanelSpec(), sites=CONFIG.sites) -> DataFrame:
    """Files that gave no row. They leave no trace in the read, so the listing tells."""
    listed = list_files(spark, root, sites).select(
        F.col("site").alias(spec.site), entity_from_name(F.col("name")).alias(spec.entity)
    )
    return listed.join(raw.select(*spec.key).distinct(), spec.key, "left_anti")


def load_cohort(
    spark: SparkSession, root: str, spec: PanelSpec = PanelSpec(), sites=CONFIG.sites, strict: bool = True
) -> DataFrame:
    """Read, check, index hours: the cohort table of all sites."""
    raw = read_raw(spark, root, spec, sites)
    if strict:
        none = empty_files(spark, root, raw, spec, sites).limit(1).collect()
        if none:
            raise ValueError(f"no rows in the file of {none[0][spec.entity]}")
        require_valid(raw, spec)
    indexed = index_hours(raw, spec)
    return indexed.select(
        spec.entity, spec.site, spec.hour,
        *[c for c in RAW_COLUMNS if c != spec.label],
        F.col(spec.label).cast("int").alias(spec.label),
    ).sortWithinPartitions(spec.site, spec.entity, spec.hour)


def quarantine(spark: SparkSession, root: str, sites=CONFIG.sites) -> DataFrame:
    """Malformed files with the reasons: header, field count, no data rows.

    Lines keep their order inside a split, and the first split starts at byte
    0, which is how the first line of a file is found. Nothing is deleted.
    """
    header = SEP.join(RAW_COLUMNS)
    lines = spark.read.text(paths(root, sites)).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
        "value",
    )
    fields = F.size(F.split("value", r"\|"))
    per_file = lines.groupBy("path").agg(
        F.min_by("value", "at").alias("first"),
        F.count(F.lit(1)).alias("n"),
        count_where(fields != len(RAW_COLUMNS)).alias("odd_rows"),
    )
    seen = per_file.withColumn("path", F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"))
    joined = _listed(spark, root, sites).join(seen, "path", "left")
    wrong_header = F.coalesce(F.col("first") != header, F.lit(True))
    flags = joined.select(
        "path",
        wrong_header.cast("int").alias("wrong_header"),
        (F.coalesce("odd_rows", F.lit(0)) > 0).cast("int").alias("wrong_field_count"),
        (F.coalesce("n", F.lit(0)) < 2).cast("int").alias("no_rows"),
    )
    return flags.filter("wrong_header + wrong_field_count + no_rows > 0")
