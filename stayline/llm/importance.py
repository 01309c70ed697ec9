"""Resampling by importance towards a target: hashed n-gram features found by overlapped regex scanning.

Separators collapse to single spaces; then `finditer` with overlapped=True and
lookarounds at both borders gives the span of every run of n words, and the
CRC32 of the span is its bucket. The buckets of each document are kept as one
binary value (two bytes a feature), so texts are scanned once: counts over all
documents give the gains, and gains and buckets give the weights.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.arrow import map_slices, texts_of
from stayline.operators.blocks import row_numbers
from stayline.session import cut_lineage

#: A-Z folded, letters, digits and bytes of other characters kept, everything else a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1000


@dataclass(frozen=True)
class Resample:
    """n-grams of 1 to `longest` words in `buckets`; `share` of 100 of the documents with `min_words` words are drawn."""

    longest: int = 2
    buckets: int = 10_000
    min_words: int = 20
    share: int = 25
    seed: int = 7


def run_pattern(n: int) -> regex.Pattern:
    """Runs of n words in text with single spaces, each at its own start when scanned overlapped."""
    return regex.compile(rb"(?<![^ ])[^ ]+" + rb" [^ ]+" * (n - 1) + rb"(?![^ ])")


def feature_buckets(text: bytes, patterns: list[regex.Pattern], buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of each feature, and the number of words."""
    plain = b" ".join(text.translate(PLAIN).split())
    spans = (p.finditer(plain, overlapped=True) for p in patterns)
    found = [np.fromiter(map(crc32, map(itemgetter(0), s)), np.int64) for s in spans]
    return np.concatenate(found) % buckets, plain.count(b" ") + bool(plain)


def features(rows: DataFrame, how: Resample) -> DataFrame:
    """doc_id, n_words, n_features, features (binary: little-endian buckets) of `rows` (doc_id, text); null text has none."""
    width = "<u2" if how.buckets <= 1 << 16 else "<u4"

    def run(batch: pa.RecordBatch) -> dict:
        patterns = [run_pattern(n) for n in range(1, how.longest + 1)]
        got = [feature_buckets(t.encode("utf-8"), patterns, how.buckets) for t in texts_of(batch)]
        return {
            "doc_id": batch.column(0),
            "n_words": pa.array([n for _, n in got], pa.int64()),
            "n_features": pa.array([len(b) for b, _ in got], pa.int64()),
            "features": pa.array([b.astype(width).tobytes() for b, _ in got], pa.binary()),
        }

    plain = rows.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_slices(plain, run, "doc_id bigint, n_words bigint, n_features bigint, features binary")


def bucket_counts(found: DataFrame, how: Resample) -> np.ndarray:
    """Features in each bucket over all rows: summed in each task, `buckets` numbers come to the driver."""
    width = "<u2" if how.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer() or b"", width), minlength=how.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    sums = found.select("features").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(how.buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares in the target and in the source, floored."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def gumbel(doc_id: int | None, seed: int) -> int:
    """Seeded noise in thousandths; the same document always gets the same. A null doc_id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-SCALE * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, how: Resample) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    width = "<u2" if how.buckets <= 1 << 16 else "<u4"

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_pylist()
        weights = []
        for value in batch.column(3):
            own = np.frombuffer(value.as_buffer() or b"", width)
            weights.append(int(gain[own].sum()) // len(own) if len(own) else 0)
        return {
            "doc_id": batch.column(0), "n_words": batch.column(1), "n_features": batch.column(2),
            "weight": pa.array(weights, pa.int64()),
            "score": pa.array([w + gumbel(d, how.seed) for w, d in zip(weights, ids)], pa.int64()),
        }

    return map_slices(found, run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint", "")


def resample(docs: DataFrame, target: DataFrame, how: Resample = Resample()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs` (doc_id, text), `target` having text.

    The highest scores among documents with enough words are drawn; rank counts
    them from 1, others have none. Ties go to the smaller doc_id, a null one
    last; repeated rows have equal scores and ranks of their own. A document
    without features weighs 0. Empty tables give no rows; an empty target makes
    rare features weigh more.
    """
    found = cut_lineage(features(docs, how))
    aim = features(target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), how)
    rows = cut_lineage(scored(found, gains(bucket_counts(found, how), bucket_counts(aim, how)), how))
    enough = F.col("n_words") >= how.min_words
    return _ranked(rows, enough, rows.where(enough).count() * how.share // 100)


def _ranked(rows: DataFrame, enough, wanted: int) -> DataFrame:
    """`rank` of the `wanted` highest scores among the rows with `enough`, others null."""
    columns = ["doc_id", "n_features", "weight", "score"]
    # Distinct scores are bounded by the range of gains, so their counts fit one window and the driver.
    steps = {r["score"]: r["n"] for r in rows.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    above, cutoff = 0, None
    for score in sorted(steps, reverse=True):
        if above >= wanted:
            break
        cutoff, above = score, above + steps[score]
    if cutoff is None:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    drawable = enough & (F.col("score") >= F.lit(cutoff))
    top = rows.where(drawable).withColumn("_by", -F.col("score")).withColumn("_null", F.col("doc_id").isNull())
    numbered = row_numbers(top, [], ["_by", "_null", "doc_id"], F.col("_by"), "rank")
    rank = F.when(F.col("rank") <= F.lit(wanted), F.col("rank")).alias("rank")
    others = rows.where(~drawable).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return numbered.select(*columns, rank).unionByName(others)
