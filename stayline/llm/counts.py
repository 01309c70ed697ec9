"""Token counts: huge texts are encoded in overlapping chunks and spliced where both chunks provably agree.

A position is a proven boundary if a non-space character stands before it and a
space or line feed after it (see `tokens`): what follows is encoded alike
whatever stands before. Two neighbouring chunks are spliced at such a position
inside their overlap where both encodings start a token. If the overlap has
none, it is doubled; if it reaches back to the last splice, the chunk is grown.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm import tokens
from stayline.llm.arrow import map_slices

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
MODEL_SUFFIX = ".model"

#: text -> character positions where its tokens start, in order
Starts = Callable[[str], np.ndarray]


def _json_starts(path: str) -> Starts:
    tokenizer = tokens.encoder(path).tokenizer

    def starts(text: str) -> np.ndarray:
        spans = tokenizer.encode(text, add_special_tokens=False).offsets
        return np.fromiter((s for s, _ in spans), np.int64, len(spans))

    return starts


def _model_starts(path: str) -> Starts:
    model = tokens.piece_words(path).model

    def starts(text: str) -> np.ndarray:
        pieces = model.encode(text, return_type="proto").pieces
        at = np.fromiter((p.begin for p in pieces), np.int64, len(pieces))
        points = np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80) - 1
        return points[at]  # the library gives byte positions

    return starts


def crosses_words(path: str) -> bool:
    """Whether some piece of a sentencepiece model goes on behind a space mark that follows other text."""
    model = tokens.piece_words(path).model
    mark = "▁"
    return any(mark in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size()))


def is_proven(text: str, at: int, gaps: str = " \n") -> bool:
    """Whether `at` is a token boundary in every context."""
    before = text[at - 1]
    return text[at] in gaps and not before.isspace() and before.isprintable()


def splice_point(text: str, a: np.ndarray, b: np.ndarray, low: int, high: int, gaps: str = " \n") -> int | None:
    """The first proven boundary in (low, high) where both chunks start a token (positions in `text`)."""
    both = np.intersect1d(a, b)
    for at in both[(both > low) & (both < high)].tolist():
        if is_proven(text, at, gaps):
            return at
    return None


def spliced_count(
    text: str, starts: Starts, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, gaps: str = " \n"
) -> tuple[int, int, int]:
    """Tokens of a text of any length, chunks used and how often an overlap or chunk had to be widened."""
    total = widened = 0
    chunks, begin, stop, spliced = 1, 0, min(chunk, len(text)), 0
    here = starts(text[begin:stop]) + begin
    while stop < len(text):
        back = overlap
        while True:
            low = max(spliced, stop - back)
            after = starts(text[low : low + chunk + back]) + low
            at = splice_point(text, here, after, low, stop, gaps)
            chunks += 1
            if at is not None or low == spliced:
                break
            back, widened = back * 2, widened + 1
        if at is None:  # nothing proven since the last splice: grow this chunk
            # a chunk may begin anywhere before the last splice: the token there starts alike in all of them
            begin, stop, widened = max(0, spliced - 1), min(len(text), 2 * stop - low), widened + 1
            here = starts(text[begin:stop]) + begin
            continue
        total += int(np.searchsorted(here, at) - np.searchsorted(here, spliced))
        spliced, begin, stop, here = at, low, min(len(text), low + chunk + back), after
    return total + int(len(here) - np.searchsorted(here, spliced)), chunks, widened


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks, n_widened for every row of `docs` (doc_id, text).

    A null or empty text has no tokens; a null doc_id stays null; repeated rows
    give repeated rows; other columns are not used. Texts of up to `chunk`
    characters are encoded whole. A sentencepiece model with pieces across
    words has no proven boundaries, so its texts are all encoded whole.
    """
    model = path.endswith(MODEL_SUFFIX)

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(1).fill_null("")
        sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False)
        counts, chunks, widened = (np.full(len(column), v, np.int64) for v in (0, 1, 0))
        whole = model and crosses_words(path)
        huge = np.flatnonzero(sizes > chunk) if not whole else np.zeros(0, np.int64)
        if model:
            for i in np.setdiff1d(np.arange(len(column)), huge).tolist():
                counts[i] = len(tokens.piece_words(path).model.encode(column[i].as_py(), num_threads=1))
        else:
            short = pc.if_else(pa.array(sizes <= chunk), column, "")
            _, counts[:] = tokens.encoder(path).slice(short, want_ids=False)
        if len(huge):
            starts = _model_starts(path) if model else _json_starts(path)
            for i in huge.tolist():
                counts[i], chunks[i], widened[i] = spliced_count(
                    column[i].as_py(), starts, chunk, overlap, " " if model else " \n"
                )
        return {
            "doc_id": batch.column(0),
            "n_bytes": pc.binary_length(column).cast(pa.int64()),
            "n_tokens": counts,
            "n_chunks": chunks,
            "n_widened": widened,
        }

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_slices(plain, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chunks bigint, n_widened bigint")
