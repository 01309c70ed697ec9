"""Shingles of texts, their TF-IDF weights and consistent weighted samples."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from stayline.llm.words import SPACE, mix, word_hashes

WIDTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def shingles(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each row (A-Z folded), and where each row begins.

    A row with fewer words has one shingle of all its words; one without words
    has the shingle of the empty text.
    """
    words, bounds = word_hashes(column, ~SPACE)
    weights = mix(_ODD[0] * (np.arange(width, dtype=np.uint64) + np.uint64(1))) | np.uint64(1)
    n = len(words)
    runs = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width if len(runs) else 0):
        runs += words[j : n - width + 1 + j] * weights[j]
    sizes = np.diff(bounds)
    counts = np.maximum(sizes - width + 1, 1)
    ends = np.cumsum(counts)
    out = np.full(int(ends[-1]) if len(ends) else 0, _EMPTY)
    long = sizes >= width
    inside = np.repeat(long, counts)
    out[inside] = runs[(np.repeat(bounds[:-1] - (ends - counts), counts) + np.arange(len(out)))[inside]]
    for i in np.flatnonzero(~long & (sizes > 0)).tolist():
        own = words[bounds[i] : bounds[i + 1]]
        out[ends[i] - 1] = (own * weights[: len(own)]).sum(dtype=np.uint64) ^ mix(np.full(1, len(own), np.uint64))[0]
    return mix(out), np.concatenate(([0], ends))


def bags(column: pa.Array, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct shingles in order and how often it has each."""
    hashes, bounds = shingles(column, width)
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def digest(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Equal for texts with the same shingles equally often."""
    h = hashlib.blake2b(bag[0].tobytes(), digest_size=16)
    h.update(bag[1].astype(np.int64).tobytes())
    return h.digest()


@dataclass(frozen=True)
class Idf:
    """Weights of shingles: 1, less for those in at least a share `common` of all documents.

    The inverse document frequency ln(N / df) / ln(1 / common) is bounded to
    [0, 1] and damped to [floor, 1]. Bounded above, it is 1 for every shingle
    outside a table of at most (mean shingles a document) / common entries, so
    the table can be sent to all tasks at any corpus size. Damped below, since
    otherwise a large group of near copies would make its own text common and
    dissolve itself.
    """

    hashes: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, df: np.ndarray, n_docs: int, common: float, floor: float) -> Idf:
        order = np.argsort(hashes)
        inverse = np.clip(np.log(n_docs / np.maximum(df[order], 1)) / np.log(1 / common), 0, 1)
        return Idf(hashes[order], floor + (1 - floor) * inverse)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.weights[at[hit]]
        return out


class Sampler:
    """Improved consistent weighted sampling: `samples` draws whose chance to agree is the weighted Jaccard similarity."""

    BLOCK = 1024

    def __init__(self, samples: int, seed: int = 7):
        self.seeds = mix((np.arange(samples, dtype=np.uint64) + np.uint64(seed)) * _ODD[2])[:, None]
        self.rows = np.arange(samples)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit sample for each draw: the chosen shingle and its quantised weight."""
        best = np.full(len(self.seeds), np.inf, np.float32)
        out = np.zeros(len(self.seeds), np.uint64)
        for ones in (True, False):
            chosen_weights = weights == 1 if ones else weights != 1
            own, log_weight = hashes[chosen_weights], np.log(weights[chosen_weights]).astype(np.float32)
            for a in range(0, len(own), self.BLOCK):
                part = own[a : a + self.BLOCK]
                value, level = self._draw(part, None if ones else log_weight[a : a + self.BLOCK])
                at = value.argmin(axis=1)
                least = value[self.rows, at]
                chosen = part[at]
                if level is not None:
                    chosen = chosen + level[self.rows, at].astype(np.int64).view(np.uint64) * _ODD[3]
                better = least < best
                best[better], out[better] = least[better], chosen[better]
        return mix(out)

    def _draw(self, hashes: np.ndarray, log_weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln a and t of each draw (rows) for each shingle (columns); r and c are Gamma(2, 1), b uniform.

        Without log weights all weights are 1, for which t is always 0.
        """
        bits = (hashes[None, :] ^ self.seeds) * _ODD[0]
        bits ^= bits >> np.uint64(32)
        bits *= _ODD[1]
        bits ^= bits >> np.uint64(29)
        more = bits * _ODD[4]
        more ^= more >> np.uint64(31)
        log_of_range = np.float32(64 * np.log(2))
        half = np.float32(0.5)
        two = bits.view(np.uint32).reshape(*bits.shape, 2)
        r = log_of_range - np.log((two[..., 0].astype(np.float32) + half) * (two[..., 1].astype(np.float32) + half))
        four = more.view(np.uint16).reshape(*more.shape, 4)
        high = more.view(np.uint32).reshape(*more.shape, 2)[..., 1].astype(np.float32)
        c = np.float32(48 * np.log(2)) - np.log((high + half) * (four[..., 0].astype(np.float32) + half))
        b = four[..., 1].astype(np.float32) * np.float32(2.0**-16)
        if log_weight is None:
            return np.log(c) - r * (np.float32(1) - b), None
        level = np.floor(log_weight / r + b)
        return np.log(c) - r * (level - b + np.float32(1)), level


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of consecutive samples; keys of different bands differ."""
    rows = samples.reshape(bands, -1)
    factors = mix(np.arange(1, rows.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((rows * factors).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[2])


def expanded(hashes: np.ndarray, times: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """A weighted bag as a weighted set: the j-th copy of a shingle is an element of its own with the shingle's idf.

    The weight common to two sets is then the sum of the smaller TF-IDF weights.
    """
    weights = idf(hashes)
    if len(times) and times.max() > 1:
        copy = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        base = np.repeat(hashes, times)
        hashes = np.where(copy == 0, base, mix(base + copy.astype(np.uint64) * _ODD[4]))
        weights = np.repeat(weights, times)
        order = np.argsort(hashes)
        hashes, weights = hashes[order], weights[order]
    return hashes, weights


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets in order of their elements."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = float(a[1][b[0][at] == a[0]].sum())
    return common / (float(a[1].sum()) + float(b[1].sum()) - common)
