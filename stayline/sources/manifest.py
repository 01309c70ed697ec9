"""Digests of files and rows that need no ordering and no collected group.

Every item is hashed; the hash is cut into numbers that are summed per group.
Sums do not depend on order or partitioning and combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.sources.psv import paths, site_from_path
from stayline.spec import CONFIG

HEX = 15
LANES = 4


def _lane(digest: Column, i: int) -> Column:
    number = F.conv(F.substring(digest, 1 + i * HEX, HEX), 16, 10)
    return F.sum(number.cast("decimal(38,0)"))


def multiset_digest(items: DataFrame, by: Sequence[str], digest: Column) -> DataFrame:
    """(group, n, digest) over the item hashes of each group."""
    sums = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[_lane(digest, i).alias(f"_l{i}") for i in range(LANES)]
    )
    joined = F.concat_ws(":", *[F.col(c).cast("string") for c in ["n", *[f"_l{i}" for i in range(LANES)]]])
    return sums.select(*by, "n", F.sha2(joined, 256).alias("digest"))


def row_digest(table: DataFrame, by: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """Digest of table rows. Columns enter as length:text, so no two rows have one text; null is `-`."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return multiset_digest(table, by, F.sha2(F.concat(*parts), 256))


def file_hashes(spark: SparkSession, root: str, sites=CONFIG.sites) -> DataFrame:
    """(site, name, sha256) of every record file."""
    files = spark.read.format("binaryFile").load(paths(root, sites))
    return files.select(
        site_from_path(F.col("path"), sites).alias("site"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.sha2("content", 256).alias("sha256"),
    )


def site_manifest(hashes: DataFrame) -> DataFrame:
    """(site, n, digest): one digest per site over its (name, hash) pairs."""
    return multiset_digest(hashes, ["site"], F.sha2(F.concat_ws("  ", "sha256", "name"), 256))


def verify(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """OK, FAIL or SKIP (nothing on disk) for every recorded site."""
    joined = recorded.select("site", F.col("digest").alias("expected")).join(
        actual.select("site", F.col("digest").alias("actual")), "site", "left"
    )
    status = (
        F.when(F.col("actual").isNull(), "SKIP")
        .when(F.col("actual") == F.col("expected"), "OK")
        .otherwise("FAIL")
    )
    return joined.withColumn("status", status)


def require_verified(recorded: DataFrame, actual: DataFrame) -> None:
    bad = verify(recorded, actual).filter("status = 'FAIL'").limit(5).collect()
    if bad:
        raise ValueError(f"checksum mismatch for {[r['site'] for r in bad]}")
