"""Stored results: merged by key, and scored once per fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stayline.sources.manifest import row_digest

RESULT_TYPE = "model_key string, payload string"


def merge_result(spark: SparkSession, path: str, key: str, payload: Mapping) -> None:
    """Replace the result of `key`; results of other keys stay untouched.

    Keys are folders, and only the folder being written is overwritten.
    """
    row = spark.createDataFrame([(key, json.dumps(payload, sort_keys=True))], RESULT_TYPE)
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "model_key"
    ).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(model_key, payload); empty if nothing was stored."""
    try:
        return spark.read.schema("payload string, model_key string").parquet(path).select(
            "model_key", "payload"
        )
    except AnalysisException:
        return spark.createDataFrame([], RESULT_TYPE)


def read_result(spark: SparkSession, path: str, key: str) -> dict | None:
    row = read_results(spark, path).filter(F.col("model_key") == key).first()
    return None if row is None else json.loads(row["payload"])


def fingerprint(parts: Mapping[str, object]) -> dict[str, str]:
    """Digest of each part that determines a score: model, rows, threshold, columns."""
    return {
        k: hashlib.sha256(json.dumps(v, sort_keys=True, default=str).encode()).hexdigest()[:16]
        for k, v in parts.items()
    }


def scoring_decision(stored: Mapping | None, current: Mapping[str, str], force: bool = False) -> str:
    """`score` the first time or when forced, `reuse` if nothing changed, else refuse."""
    if stored is None:
        return "score"
    if force:
        return "score"
    if stored.get("fingerprint") == dict(current):
        return "reuse"
    changed = sorted(k for k in current if stored.get("fingerprint", {}).get(k) != current[k])
    raise RuntimeError(
        f"refusing to score the held-out site again: {', '.join(changed) or 'unknown part'} changed; "
        "use force to record a replacement"
    )


def data_fingerprint(rows: DataFrame, columns: Sequence[str]) -> str:
    """Digest of the rows that are scored, summed up by Spark; order and partitioning do not matter."""
    found = row_digest(rows.select(*columns).withColumn("_all", F.lit(1)), ["_all"], [F.col(f"`{c}`") for c in columns]).first()
    return f"{found['n']}:{found['digest']}" if found else "0:"


def _place(spark: SparkSession, path: str, key: str):
    """The JVM's file system and the folder of the claims of a key."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{hashlib.sha256(key.encode()).hexdigest()[:32]}")
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _claims(spark: SparkSession, path: str, key: str) -> list[int]:
    fs, folder = _place(spark, path, key)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []


def claim(spark: SparkSession, path: str, key: str, generation: int) -> bool:
    """Create the claim of a generation if nobody has: the file system lets one of several drivers succeed."""
    fs, folder = _place(spark, path, key)
    fs.mkdirs(folder)
    return fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, str(generation)))


def release(spark: SparkSession, path: str, key: str, generation: int) -> None:
    fs, folder = _place(spark, path, key)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, str(generation)), False)


def score_once(
    spark: SparkSession, path: str, key: str, current: Mapping[str, str], score: Callable[[], dict], force: bool = False
) -> dict:
    """Run `score()` (a dict of results) at most once per fingerprint, also when several drivers try.

    The claim comes first and is atomic; who does not get it does not score. A
    claim without a result is a driver at work, or one that died: only `force`
    goes past it, by a claim of the next generation. If scoring fails its claim
    is given back.
    """
    held = _claims(spark, path, key)
    stored = read_result(spark, path, key)
    if stored is None and held and not force:
        raise RuntimeError(f"{key} is being scored by another driver, or one that died; use force to take over")
    if scoring_decision(stored, current, force) == "reuse":
        return stored
    generation = max(held, default=-1) + 1
    if not claim(spark, path, key, generation):
        raise RuntimeError(f"{key} has just been claimed by another driver")
    try:
        payload = {"fingerprint": dict(current), "results": score(), "rescored": bool(held) and force}
        merge_result(spark, path, key, payload)
    except BaseException:
        release(spark, path, key, generation)
        raise
    return payload
