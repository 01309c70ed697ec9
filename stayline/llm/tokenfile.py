"""Token-ID files: Parquet with one list of ids per document, laid out for selective reads.

Rows stand in ascending doc_id order, so the statistics of row groups and pages
on doc_id cut a read by document to a few pages. Each file is one contiguous
range of documents. Ids use dictionary or delta encoding; row groups and pages
have the sizes asked for; Parquet's page indexes are written with them. Metadata
columns are read without touching the token pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.llm import tokens
from stayline.llm.arrow import by_text, map_slices

SCHEMA = "doc_id bigint, part int, row bigint, start_in_part bigint, n_tokens bigint, tokens array<int>"


@dataclass(frozen=True)
class Layout:
    """How the files are laid out."""

    encoding: str = "delta"  # or "dictionary"
    row_group_bytes: int = 16 << 20
    page_bytes: int = 64 << 10
    page_rows: int = 2_000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("delta", "dictionary"):
            raise ValueError(f"encoding is {self.encoding!r}; known are delta and dictionary")
        tokens_column = "tokens.list.element"
        return {
            "compression": self.compression,
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            # version 2 pages hold integers outside a dictionary delta encoded and bit packed
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            f"parquet.enable.dictionary#{tokens_column}": str(self.encoding == "dictionary").lower(),
        }


def encode_in_order(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Ids of every row of `docs` (doc_id, text) with `end_id` behind, in ascending doc_id order within and across tasks.

    A null text is empty, so it has the end id alone. A null doc_id comes first
    and stays null; rows with the same doc_id follow each other by text. Only
    these two columns are used. Rows of one document range are dealt to one
    task before they are encoded, so the shuffle moves texts and no text is
    encoded twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        row = start = 0
        coder = tokens.encoder(path)
        for batch in batches:
            for piece in by_text(batch):
                ids, counts = coder.slice(piece.column(1))
                ends = np.cumsum(counts)
                flat = np.insert(ids.astype(np.int32), ends, end_id)
                lengths = counts + 1
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(row + np.arange(len(counts))),
                        pa.array(start + offsets[:-1]),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "row", "start_in_part", "n_tokens", "tokens"],
                )
                row, start = row + len(counts), start + int(offsets[-1])

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, out: str, layout: Layout = Layout(), end_id: int = 0) -> None:
    """Write the token files of `docs` under `out` (a new folder that all executors share)."""
    encode_in_order(docs, path, end_id).write.options(**layout.options()).parquet(out)


def read_tokens(
    spark: SparkSession, out: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens"),
    low: int | None = None, high: int | None = None,
) -> DataFrame:
    """Documents of the files, optionally only doc_ids in [low, high]; only the pages of `columns` are read.

    `start` counts the ids of all documents before, over all files: the sum of
    each file's ids comes from its metadata columns.
    """
    rows = spark.read.schema(SCHEMA).parquet(out)
    wanted = rows
    if low is not None:
        wanted = wanted.where(F.col("doc_id") >= low)
    if high is not None:
        wanted = wanted.where(F.col("doc_id") <= high)
    if "start" in columns:
        sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, so it can be sent to all tasks
        base = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        wanted = wanted.join(F.broadcast(base), "part").withColumn("start", F.col("_base") + F.col("start_in_part"))
    return wanted.select(*columns)


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) from read files."""

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        return {
            "doc_id": batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2),
            "ids_crc32": np.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], np.int64),
        }

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return map_slices(rows.select("doc_id", "start", "n_tokens", "tokens"), run, schema, column="")
