"""Quality rules: simple repetition rules first, then tokeniser fertility in bands per language or script.

Fertility measures how well a public vocabulary fits a text: characters per
token, the share of tokens that fall back to single bytes, and the entropy of
its tokens. The entropy of prose levels off while a text grows, so it is taken
over consecutive windows of `WINDOW` tokens, each relative to the most that the
tokens of the window could have, and averaged by their tokens: a text is judged
alike at any length. Natural prose of a language lies in a narrow band of each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm import tokens
from stayline.llm.arrow import map_slices
from stayline.llm.words import SPACE, buffer_of, cut_words, row_bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Band:
    """Accepted ranges for long texts; a text outside any of them is rejected.

    Measures of few tokens scatter, so all bounds are widened by `slack` divided
    by the square root of the number of tokens (a quarter of it for entropy).
    """

    chars_per_token: tuple[float, float]
    max_byte_share: float
    relative_entropy: tuple[float, float]
    slack: float = 1.5


#: Tokens of a window of the entropy; less than the vocabulary, so that all of them can differ. The last one may be shorter.
WINDOW = 2048

#: Accepted ranges by language, else by script, else "*". They hold for piece_bpe_32k.model; other vocabularies need
#: their own. The lower bounds lie below the lowest half per cent of labelled good prose, those of entropy by `WINDOW`.
BANDS = {
    "en": Band((2.10, 4.5), 0.06, (0.60, 1.0)),
    "de": Band((2.11, 4.5), 0.06, (0.59, 1.0)),
    "fr": Band((1.84, 4.5), 0.08, (0.58, 1.0)),
    "es": Band((1.85, 4.5), 0.06, (0.58, 1.0)),
    "latin": Band((1.2, 6.0), 0.15, (0.4, 1.0)),
    "*": Band((0.3, 6.0), 1.0, (0.3, 1.0)),
}

#: First bytes of UTF-8 characters by script.
SCRIPT_LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCB)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "hebrew": [0xD7],
    "arabic": [*range(0xD8, 0xDC)],
    "indic": [0xE0],
    "kana": [0xE3],
    "han": [*range(0xE4, 0xEA)],
    "hangul": [*range(0xEA, 0xEE)],
}


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(ids) < 4:
        return 0
    size = len(number)
    if size < 1 << 20:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # number pairs anew so that the key stays within 64 bits
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
    _, code, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[code] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= again
    return int(covered.sum())


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script most letters of each row belong to; without letters "none"."""
    names = list(SCRIPT_LEADS)
    counts = []
    for name in names:
        member = np.zeros(256, bool)
        member[SCRIPT_LEADS[name]] = True
        sums = np.concatenate(([0], np.cumsum(member[data])))
        counts.append(sums[offsets[1:]] - sums[offsets[:-1]])
    table = np.array(counts).reshape(len(names), -1)
    best = table.argmax(axis=0) if table.size else []
    return [names[b] if table[b, i] else "none" for i, b in enumerate(best)]


def window_entropy(ids: np.ndarray) -> float:
    """Mean relative entropy of consecutive windows of tokens, weighted by their tokens (1 for a single token)."""
    total = 0.0
    for a in range(0, len(ids), WINDOW):
        own = ids[a : a + WINDOW]
        if len(own) > 1:
            times = np.bincount(own)
            share = times[times > 0] / len(own)
            total += len(own) * max(0.0, float(-(share * np.log2(share)).sum() / np.log2(len(own))))
        else:
            total += 1.0
    return total / len(ids)


def fertility(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: tokens of its words, how many of them are byte fallbacks, mean relative entropy of windows (1 for one token)."""
    data, offsets = buffer_of(column)
    starts, ends, rows = cut_words(data, offsets, ~SPACE)
    pieces = tokens.piece_words(path)
    ids, counts = pieces.slice(data, starts, ends)
    per_row = row_bounds(np.repeat(rows, counts), len(column))
    n_tokens, n_bytes, entropy = np.diff(per_row), np.zeros(len(column), np.int64), np.ones(len(column))
    for i, (a, b) in enumerate(zip(per_row[:-1].tolist(), per_row[1:].tolist())):
        if b - a > 1:
            entropy[i] = window_entropy(ids[a:b])
        n_bytes[i] = int(pieces.is_byte[ids[a:b]].sum())
    return n_tokens, n_bytes, entropy


def in_band(band: Band, n_tokens: int, chars_per_token: float, byte_share: float, entropy: float) -> bool:
    slack = band.slack / max(n_tokens, 1) ** 0.5
    return (
        band.chars_per_token[0] - slack <= chars_per_token <= band.chars_per_token[1] + slack
        and byte_share <= band.max_byte_share + slack
        and entropy >= band.relative_entropy[0] - slack / 4
        and entropy <= band.relative_entropy[1] + slack / 4
    )


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, script string, chars_per_token double, byte_share double, entropy double"
)


def quality(docs: DataFrame, path: str, bands: dict[str, Band] = BANDS, passed: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict of every row of `docs` (doc_id, text, lang).

    A null text has no words, so its base rules fail; a null or unknown lang is
    judged by its script. Repeated rows give repeated rows; extra columns are
    ignored, except those named in `passed`, which are returned as they are.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        base = np.array([base_features(t) for t in texts], np.int64).reshape(-1, 5)
        n_words, word_chars, repeat = base[:, 0], base[:, 1], base[:, 4]
        failed = (n_words < 50) | (100 * repeat > 50 * n_words)
        n_tokens, n_bytes, entropy = fertility(batch.column(1), path)
        per_token = word_chars / np.maximum(n_tokens, 1)
        byte_share = n_bytes / np.maximum(n_tokens, 1)
        script = scripts(*buffer_of(batch.column(1)))
        names = [lang if lang in bands else s if s in bands else "*" for lang, s in zip(batch.column(2).to_pylist(), script)]
        kept = [
            not f and in_band(bands[name], n, c, b, e)
            for f, name, n, c, b, e in zip(failed, names, n_tokens, per_token, byte_share, entropy)
        ]
        out = {
            "doc_id": batch.column(0), "n_words": n_words, "word_chars": word_chars, "n_symbols": base[:, 2],
            "n_dup_lines": base[:, 3], "n_repeat_words": repeat, "base_failed": failed, "kept": pa.array(kept, pa.bool_()),
            "script": script, "chars_per_token": per_token, "byte_share": byte_share, "entropy": entropy,
        }
        return out | {f"given_{i}": batch.column(3 + i) for i in range(len(passed))}

    given = [F.col(f"`{c}`").alias(f"given_{i}") for i, c in enumerate(passed)]
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"), *given)
    types = [plain.schema[f"given_{i}"].dataType.simpleString() for i in range(len(passed))]
    return map_slices(plain, run, ", ".join([SCHEMA, *(f"given_{i} {t}" for i, t in enumerate(types))]))
