"""Token ids by a public byte-level vocabulary, each distinct segment encoded once.

No pre-token of these vocabularies holds a non-space character followed by a
space or a line feed: each alternative of the pattern takes at most one leading
space and then only non-space classes, or white space only. So such a place is
a token boundary in every context, and the ids of a text are those of its
segments between such places, one after the other. An added token holds no white
space, so it is never cut either. Segments repeat a lot; only new ones are
encoded, many together, and the rest is gathered with numpy.

The vocabulary file is that of the `tokenizers` library. If it is a plain
byte-level BPE whose ids follow the order of its merges, new segments go through
tiktoken built from that same file (the ids are the same, at four times the
speed); any other file is encoded text by text by `tokenizers` itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from stayline.llm.words import buffer_of, hash_spans

#: Distinct segments kept by a worker; when full the store starts again.
STORE_SEGMENTS = 200_000
#: Fixed value: the pre-token pattern of byte-level BPE with `use_regex`.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A `tokenizers` vocabulary, one thread (Spark runs one task per core)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ordered_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings to ids if ids follow merges in a plain byte-level BPE, else None."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens", [])
    simple = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in added)
    no_space = not any(re.search(r"\s", a["content"]) for a in added)
    if not (plain and byte_level and simple and no_space and spec.get("normalizer") is None):
        return None
    vocab = model["vocab"]
    joined = ["".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [vocab.get(j, -1) for j in joined]
    names = {a["content"] for a in added}
    letters = byte_letters()
    if any(a >= b for a, b in zip(ids, ids[1:])) or not all(c in letters for k in vocab if k not in names for c in k):
        return None
    ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in names}
    singles = {ranks[k] for k in ranks if len(k) == 1}
    return ranks if len(singles) == 256 and len(ranks) == 256 + len(ids) and max(singles) < min(ids, default=1 << 30) else None


class SegmentStore:
    """Ids of distinct segments by their 64-bit hash, filled as new ones come."""

    def __init__(self, limit: int = STORE_SEGMENTS):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot_of: dict[int, int] = {}
        self.offset = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.slots = self.used = 0

    def slots_for(self, hashes: np.ndarray, encode_new) -> np.ndarray:
        """The slot of each segment; `encode_new(positions)` gives ids, offsets and counts of unseen ones."""
        found = pa.array(hashes).dictionary_encode()
        codes, distinct = found.indices.to_numpy(), found.dictionary.to_numpy()
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if self.slots + len(distinct) > max(self.limit, 2 * len(distinct)):
            self.clear()
        get = self.slot_of.get
        slots = np.array([get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(self.slots, self.slots + len(new))
            self._append(*encode_new(first[new]))
            self.slot_of.update(zip(distinct[new].tolist(), slots[new].tolist()))
        return slots[codes]

    def _append(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> None:
        while self.slots + len(counts) > len(self.offset):
            self.offset, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.offset, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.offset[self.slots : self.slots + len(counts)] = self.used + offsets
        self.length[self.slots : self.slots + len(counts)] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.slots += len(counts)
        self.used += len(ids)

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of these segments one after the other."""
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.offset[slots] - (ends - lengths), lengths) + np.arange(total)]


class Encoder:
    """Ids of the texts of a slice, as `tokenizers` gives them without special tokens added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._tokenizer = path, None
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.store = SegmentStore()
        ranks = _ordered_ranks(spec)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ordered", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.id_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            for piece, at in ranks.items():
                self.id_bytes[at] = len(piece)
            by_length = sorted(self.added, key=len, reverse=True)
            self.special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None

    @property
    def tokenizer(self):
        """The library's own object, loaded where it is needed."""
        if self._tokenizer is None:
            self._tokenizer = load_tokenizer(self.path)
        return self._tokenizer

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text."""
        if self.fast is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.special is None or not self.special.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        parts = [
            [self.added[p]] if p in self.added else self.fast.encode_ordinary(p) for p in self.special.split(text) if p
        ]
        return np.array([i for p in parts for i in p], np.uint32)

    def slice(self, column: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other (empty unless wanted) and the number of ids of each row."""
        if self.fast is None:
            each = [self.ids(t or "") for t in column.to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint32), *each]) if want_ids else np.zeros(0, np.uint32)
            return flat, np.array([len(e) for e in each], np.int64)
        data, offsets = buffer_of(column)
        starts, ends, inner = _segments(data, offsets)
        hashes = hash_spans(data, starts, ends)
        hashes ^= (~inner).astype(np.uint64)  # the same bytes at the edge of a text are another segment
        slots = self.store.slots_for(hashes, lambda at: self._encode(data, starts[at], ends[at], inner[at]))
        sums = np.concatenate(([0], np.cumsum(self.store.length[slots])))
        bounds = np.searchsorted(starts, offsets)
        counts = sums[bounds[1:]] - sums[bounds[:-1]]
        return self.store.gather(slots) if want_ids else np.zeros(0, np.uint32), counts

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray):
        """New segments: the inner ones as one text, cut again by the bytes of its ids; the others one by one."""
        ids = np.zeros(0, np.uint32)
        counts = np.zeros(len(starts), np.int64)
        alone = np.ones(len(starts), bool)
        sizes = (ends - starts)[inner]
        wanted = np.cumsum(sizes)
        if len(sizes):
            text = data[np.repeat(starts[inner] - (wanted - sizes), sizes) + np.arange(wanted[-1])].tobytes()
            if not any(name.encode() in text for name in self.added):
                got = np.array(self.fast.encode_ordinary(text.decode("utf-8")), np.uint32)
                reached = np.cumsum(self.id_bytes[got])
                stop = np.searchsorted(reached, wanted) + 1
                if np.array_equal(reached[stop - 1], wanted):
                    ids, alone = got, ~inner
                    counts[inner] = np.diff(np.concatenate(([0], stop)))
        offsets = np.zeros(len(starts), np.int64)
        offsets[~alone] = np.cumsum(counts[~alone]) - counts[~alone]
        every, total = [ids], len(ids)
        for i in np.flatnonzero(alone).tolist():
            got = self.ids(data[starts[i] : ends[i]].tobytes().decode("utf-8"))
            offsets[i], counts[i] = total, len(got)
            every.append(got)
            total += len(got)
        return np.concatenate(every), offsets, counts


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut before a space or line feed that follows a character that is white space in no reading.

    That is ASCII from ! to ~, a two-byte character from U+00C0 on, or a
    three-byte one from U+4000 on. inner: both ends are such cuts.
    """
    n = len(data)
    gap = (data == 0x20) | (data == 0x0A)
    high = data >= 0x80
    solid = (data >= 0x21) & (data <= 0x7E)
    solid[1:] |= high[1:] & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    solid[2:] |= high[2:] & (data[:-2] >= 0xE4) & (data[:-2] <= 0xEF)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = gap[1:] & solid[:-1]
    at_edge = np.zeros(n + 1, bool)
    at_edge[offsets] = True
    places = np.flatnonzero(cut | at_edge)
    starts, ends = places[:-1], places[1:]
    return starts, ends, ~(at_edge[starts] | at_edge[ends])


class PieceWords:
    """Pieces of single words by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())], bool)
        self.store = SegmentStore()

    def slice(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other and the number of ids of each word."""

        def encode_new(at: np.ndarray):
            words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            got = self.model.encode(words, num_threads=1)
            counts = np.array([len(g) for g in got], np.int64)
            flat = np.fromiter((i for g in got for i in g), np.uint32, int(counts.sum()))
            return flat, np.cumsum(counts) - counts, counts

        slots = self.store.slots_for(hash_spans(data, starts, ends), encode_new)
        return self.store.gather(slots), self.store.length[slots]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_PIECES: dict[str, PieceWords] = {}


def piece_words(path: str) -> PieceWords:
    """The worker's sentencepiece model for a file."""
    if path not in _PIECES:
        _PIECES[path] = PieceWords(path)
    return _PIECES[path]
