"""Origin of a result table, kept as a table beside it: one fact in each row.

Facts come from three places: the session that ran the job, the source tree it
ran from, and the digests of its inputs (see `manifest`). Apart from the time,
two runs of the same tree over the same inputs have the same facts.
"""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.spec import CONFIG

FACTS = "kind string, name string, value string"


def tree_facts(folder: str | None = None) -> list[tuple[str, str, str]]:
    """Revision of the source tree and how many of its files differ from it; nothing outside a checkout."""
    base = folder or str(Path(__file__).parent)

    def ask(*words: str) -> list[str]:
        return subprocess.run(["git", "-C", base, *words], capture_output=True, text=True, check=True).stdout.splitlines()

    try:
        revision, changed = ask("rev-parse", "HEAD"), ask("status", "--porcelain")
    except (OSError, subprocess.CalledProcessError):
        return []
    return [("tree", "revision", revision[0]), ("tree", "changed files", str(len(changed)))]


def session_facts(spark: SparkSession) -> list[tuple[str, str, str]]:
    """What the session can tell of itself."""
    context = spark.sparkContext
    own = {"spark": spark.version, "python": sys.version.split()[0], "application": context.applicationId}
    settings = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
    return [("session", k, v) for k, v in own.items()] + [("setting", k, spark.conf.get(k)) for k in settings]


def origin(spark: SparkSession, inputs: DataFrame | None = None, seed: int = CONFIG.seed, folder: str | None = None) -> DataFrame:
    """(kind, name, value) of a run. `inputs` has (site, digest) rows, which stay distributed."""
    known = [("study", "seed", str(seed)), *tree_facts(folder), *session_facts(spark)]
    facts = spark.createDataFrame(known, FACTS)
    facts = facts.unionByName(spark.range(1).select(F.lit("study").alias("kind"), F.lit("time").alias("name"), F.current_timestamp().cast("string").alias("value")))
    if inputs is None:
        return facts
    return facts.unionByName(inputs.select(F.lit("input").alias("kind"), F.col("site").cast("string").alias("name"), F.col("digest").alias("value")))


def origin_key(facts: DataFrame) -> DataFrame:
    """One row with the digest of all facts but time and application: equal for repeated runs."""
    lasting = facts.where(~F.col("name").isin("time", "application"))
    line = F.to_json(F.struct("kind", "name", "value"))
    return lasting.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(line))), 256).alias("origin"))


def with_origin(results: DataFrame, key: str) -> DataFrame:
    """Results that name their origin, to be joined with a stored table of facts."""
    return results.withColumn("origin", F.lit(key))
