"""Line dedup: keys found in several documents keep their lines only in one of them.

Each long enough line gives a row (key hash, document, position). These rows are
dealt out by ranges of (hash, document descending) and sorted so within tasks: a
key that fills many tasks is split between documents, never within one. One
stream over each task then decides: the first document of a key keeps its
lines; from the third on lines are dropped at once; the second waits for a
third. Only a key at the edge of a task may go on in the next one, so for such
keys the stream emits a summary (documents, first document) and leaves their
lines open; summaries, at most two a task, are added up and close them.

The result is a bitmap of kept lines for each document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.llm.arrow import map_slices
from stayline.llm.columns import numbered, restored
from stayline.session import cut_lineage

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "kind string, h1 bigint, h2 bigint, doc_id bigint, place bigint, documents bigint"


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def row_tag(text: Column) -> Column:
    """A number for a row's text, so that rows with one doc_id and other texts have other places."""
    return F.shiftleft(F.crc32(F.encode(text, "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF)), 32)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (two hashes of the key), doc_id and place (row tag and line number) of lines with long enough keys."""
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    lines = plain.where("doc_id IS NOT NULL").select("doc_id", row_tag(F.col("text")).alias("_tag"), F.posexplode(F.split("text", "\n")))
    key = lines.select("doc_id", "_tag", "pos", line_key(F.col("col")).alias("_key")).where(F.length("_key") >= min_chars)
    return key.select(
        F.xxhash64("_key").alias("h1"),
        F.xxhash64(F.lit(1), "_key").alias("h2"),
        "doc_id",
        (F.col("_tag") + F.col("pos")).alias("place"),
    )


def mark_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Stream over sorted ranges: rows of kind drop, open (undecided) and summary."""
    ranged = rows.repartitionByRange("h1", "h2", F.col("doc_id").desc()).sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stream(batches, min_documents)

    return ranged.mapInArrow(run, MARKS)


def stream(batches: Iterator[pa.RecordBatch], min_documents: int) -> Iterator[pa.RecordBatch]:
    """Decide whole groups with numpy; the last group of a batch waits for the next batch.

    The first and the last key of a task stay open (their rows, group by group
    as they come) and are summed up once each.
    """
    kept: list[np.ndarray] = []  # rows of the group that may go on: h1, h2, doc_id, place
    first_group = True
    open_docs, open_first, open_last, open_key = 0, None, None, None

    def table(kind: str, rows: np.ndarray, documents: np.ndarray | None = None) -> pa.RecordBatch:
        n = rows.shape[1]
        counts = np.zeros(n, np.int64) if documents is None else documents
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.string()), *(pa.array(r) for r in rows), pa.array(counts)],
            names=["kind", "h1", "h2", "doc_id", "place", "documents"],
        )

    def opened(rows: np.ndarray) -> pa.RecordBatch:
        """Rows of an edge key: keep their count of documents, pass them on undecided."""
        nonlocal open_docs, open_first, open_last
        docs = rows[2]
        new = 1 + np.count_nonzero(docs[1:] != docs[:-1])
        if open_first is None:
            open_first = docs[0]
        elif docs[0] == open_last:
            new -= 1
        open_docs, open_last = open_docs + new, docs[-1]
        return table("open", rows)

    def summary() -> pa.RecordBatch:
        nonlocal open_docs, open_first, open_last
        row = np.array([[open_key[0]], [open_key[1]], [open_first], [0]], np.int64)
        out = table("summary", row, np.array([open_docs]))
        open_docs, open_first, open_last = 0, None, None
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)])
        if kept:
            rows = np.concatenate([*kept, rows], axis=1)
            kept = []
        h1, h2, docs = rows[0], rows[1], rows[2]
        new_key = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        begins = np.flatnonzero(new_key)
        last = begins[-1]
        if first_group:
            key = (int(h1[0]), int(h2[0]))
            if open_key is None:
                open_key = key
            stop = begins[1] if key == open_key and len(begins) > 1 else len(docs) if key == open_key else 0
            if stop:
                yield opened(rows[:, :stop])
            if stop == len(docs):
                continue
            yield summary()
            first_group = False
            rows, begins = rows[:, stop:], begins[begins >= stop] - stop
            last = begins[-1]
            docs, new_key = rows[2], np.concatenate(([True], new_key[stop + 1 :]))
        whole = rows[:, :last]
        if last:
            yield table("drop", whole[:, decide(whole[2], new_key[:last], min_documents)])
        kept = [rows[:, last:]]
    if first_group:
        if open_key is not None:
            yield summary()
    elif kept:
        open_key = (int(kept[0][0, 0]), int(kept[0][1, 0]))
        yield opened(np.concatenate(kept, axis=1))
        yield summary()


def decide(docs: np.ndarray, new_key: np.ndarray, min_documents: int) -> np.ndarray:
    """Which lines of whole groups go: groups with enough documents, all but their first document."""
    if not len(docs):
        return np.zeros(0, bool)
    new_doc = new_key | np.concatenate(([True], docs[1:] != docs[:-1]))
    group = np.cumsum(new_key) - 1
    documents = np.bincount(group, weights=new_doc).astype(np.int64)
    nth = np.cumsum(new_doc) - 1
    first = nth[np.flatnonzero(new_key)]
    return (documents[group] >= min_documents) & (nth > first[group])


def keep_bitmap(dropped: np.ndarray) -> bytes:
    """Compressed bits, 1 for a kept line, up to the byte of the last dropped one; all lines behind are kept."""
    keep = np.ones(8 * (int(dropped.max()) // 8 + 1) if len(dropped) else 0, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def kept_lines(text: str, bitmap: bytes) -> str:
    """The lines of a text that its bitmap keeps."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i >= len(bits) or bits[i])


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, tag, n_dropped, keep (compressed bitmap) of the documents of `docs` (doc_id, text) that lose lines.

    A key of at least `min_chars` code points in at least `min_documents`
    documents keeps its lines in the largest doc_id only. Rows with the same
    doc_id are one document; `tag` tells their texts apart. Rows with a null
    doc_id or text take no part. An empty table gives no rows.
    """
    marks = cut_lineage(mark_lines(line_rows(docs, min_chars), min_documents))
    edges = (
        marks.where("kind = 'summary'")
        .groupBy("h1", "h2")
        .agg(F.sum("documents").alias("_documents"), F.max("doc_id").alias("_first"))
        .where(F.col("_documents") >= min_documents)
    )
    # at most two summaries come from a task, so this side is bounded by the number of tasks
    closed = marks.where("kind = 'open'").join(F.broadcast(edges), ["h1", "h2"]).where("doc_id <> _first")
    dropped = marks.where("kind = 'drop'").select("doc_id", "place").unionByName(closed.select("doc_id", "place"))
    grouped = dropped.groupBy("doc_id", F.shiftleft(F.shiftright("place", 32), 32).alias("tag")).agg(
        F.collect_set(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lines")
    )

    def run(batch: pa.RecordBatch) -> dict:
        lines = [np.array(v, np.int64) for v in batch.column(2).to_pylist()]
        return {
            "doc_id": batch.column(0), "tag": batch.column(1), "n_dropped": [len(v) for v in lines],
            "keep": pa.array([keep_bitmap(v) for v in lines], pa.binary()),
        }

    return map_slices(grouped, run, "doc_id bigint, tag bigint, n_dropped bigint, keep binary", column="")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with the kept lines as text (null as empty), and n_lines and n_dropped behind its own columns.

    Columns of `docs` with those two names are replaced.
    """

    @F.pandas_udf(T.StringType())
    def kept(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else kept_lines(t, k) for t, k in zip(text, keep)], dtype=object)

    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = docs.select(*numbered(own), F.col("doc_id").cast("bigint").alias("own_id"), text.alias("own_text"))
    both = left.join(
        bitmaps.select("doc_id", "tag", "n_dropped", "keep"),
        (F.col("own_id") == F.col("doc_id")) & (row_tag(F.col("own_text")) == F.col("tag")),
        "left",
    )
    now = F.when(F.col("keep").isNull(), F.col("own_text")).otherwise(kept("own_text", "keep"))
    n_lines = F.length("own_text") - F.length(F.replace("own_text", F.lit("\n"), F.lit(""))) + 1
    at = own.index("text")
    both = both.withColumn(f"given_{at}", now)
    return both.select(*restored(own), n_lines.cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))
