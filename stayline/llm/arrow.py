"""Running vectorised Python inside Spark tasks, a bounded slice of text at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes; a longer row is alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def by_text(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`slices` by the bytes of a string column."""
    at = batch.schema.get_field_index(column)
    sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
    yield from slices(batch, sizes, limit)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """One output batch per slice: `fn` gives a list or array for each output column.

    Slices go by the bytes of `column`; with "" a whole batch is one slice.
    """
    names = [f.split()[0] for f in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_text(batch, column) if column else (batch,):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string (commas inside <> do not separate)."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
