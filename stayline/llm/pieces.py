"""Exact merge-type (BPE) encoding of a sentencepiece model by backtracking, and decoding.

A sequence of pieces is the encoding of a text if and only if each two
neighbours are compatible: merging the characters of both again gives just these
two. (The merge of highest score, leftmost first, is picked among all; the first
merge across a border would be picked alike if only the pieces on both sides of
it were there.) So at most one such sequence ends at each place of a text, and a
place from which no piece leads on has failed for good.

The encoder takes the longest match at each place, found for the whole segment
by one pass of an Aho-Corasick automaton; a piece that is not compatible with
the one before, or ends at a failed place, is replaced by its longest prefix
that is a piece; when none is left the place is marked as failed in a bit field
and the piece before is taken back.

No piece of most models holds a space mark behind another character, so texts
are cut there and each distinct segment is encoded once. For other models a text
is one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.arrow import map_slices
from stayline.llm.tokens import SegmentStore
from stayline.llm.words import buffer_of, hash_spans

MARK = "▁"
#: Compatible or not, by pair; when full the table starts again.
PAIRS = 1 << 20
#: Distinct segments whose ids a worker keeps.
SEGMENTS = 800_000
#: Places matched at a time, so that the matches of a long segment are never all held.
STRETCH = 1 << 14
#: Fixed values of the model file: kinds of pieces that texts may match, and the byte kind; the merge type.
MATCHED, BYTE, MERGE_TYPE = (1, 4, 5), 6, 2


class PieceModel:
    """The pieces of a merge-type model and the encoder over them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.trainer_spec.model_type != MERGE_TYPE:
            raise ValueError(f"not a merge-type model: {path}")
        if any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError(f"user-defined and unused pieces are not merged by score alone: {path}")
        self.piece_of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in MATCHED}
        self.score = {p.piece: p.score for p in spec.pieces if p.type in MATCHED}
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.unknown, self.eos = self.library.unk_id(), self.library.eos_id()
        self.names = [p.piece for p in spec.pieces]
        self.longest_piece = max(map(len, self.piece_of), default=1)
        # Neighbouring characters without a piece may become one unknown token; a mark that has one parts them.
        self.cuts = (MARK in self.piece_of or bool(self.bytes_of)) and not any(MARK in p.lstrip(MARK) for p in self.piece_of)
        self.automaton = ahocorasick.Automaton()
        for piece, at in self.piece_of.items():
            self.automaton.add_word(piece, (len(piece) - 1, at))
        if self.piece_of:
            self.automaton.make_automaton()
        self.shorter = {at: self._prefix(piece) for piece, at in self.piece_of.items()}
        used = set().union(*self.piece_of)
        #: A character of no piece: no match crosses it.
        self.gap = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in used)
        self.sizes = [len(p) for p in self.names]
        self.pairs: dict[int | None, dict[int, bool]] = {}
        self.n_pairs = 0
        self.store = SegmentStore(SEGMENTS)

    # A character without a piece stands for itself as a negative number.

    def _single(self, c: str) -> int:
        return self.piece_of.get(c, -ord(c) - 1)

    def _prefix(self, piece: str) -> int | None:
        """The longest proper prefix that is a piece or a single character."""
        for n in range(len(piece) - 1, 1, -1):
            if piece[:n] in self.piece_of:
                return self.piece_of[piece[:n]]
        return self._single(piece[0]) if len(piece) > 1 else None

    def _text(self, token: int) -> str:
        return self.names[token] if token >= 0 else chr(-token - 1)

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text: highest score first, leftmost of equal ones."""
        parts = list(text)
        score = self.score.get
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int | None, right: int) -> bool:
        """Whether merging the characters of both gives just these two (without a left piece: just the right one)."""
        row = self.pairs.setdefault(left, {})
        found = row.get(right)
        if found is None:
            if self.n_pairs >= PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
                row = self.pairs.setdefault(left, {})
            both = [self._text(t) for t in (left, right) if t is not None]
            found = row[right] = self.merge("".join(both)) == both
            self.n_pairs += 1
        return found

    def matches(self, text: str) -> list[int | None]:
        """The longest piece at each place of a text."""
        longest: list[int | None] = [None] * len(text)
        if self.piece_of:
            for end, (before, at) in self.automaton.iter(text):
                longest[end - before] = at  # matches come by their ends, so the last one is the longest
        return longest

    def segments(self, texts: list[str]) -> Iterator[list[int]]:
        """The pieces of each segment (normalised text), characters without a piece as negative numbers."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size + len(texts[last]) < STRETCH:
                size += len(texts[last]) + 1
                last += 1
            if last == first:  # longer than a stretch
                yield self.walk(texts[first], _Stretches(self, texts[first]), 0, len(texts[first]), bytearray(len(texts[first]) + 1))
                first += 1
                continue
            joined = self.gap.join(texts[first:last])
            longest, failed, begin = self.matches(joined), bytearray(len(joined) + 1), 0
            for text in texts[first:last]:
                yield self.walk(joined, longest, begin, begin + len(text), failed)
                begin += len(text) + 1
            first = last

    def walk(self, text: str, longest, begin: int, stop: int, failed: bytearray) -> list[int]:
        """Backtracking from `begin` to `stop`; `failed` is the bit field of places that lead nowhere."""
        sizes, pairs, shorter = self.sizes, self.pairs, self.shorter
        out: list[int] = []
        pos, last, token = begin, None, None
        while pos < stop:
            if token is None:
                token = longest[pos]
                if token is None:
                    token = self._single(text[pos])
            end = pos + (sizes[token] if token >= 0 else 1)
            if not failed[end]:
                row = pairs.get(last)
                fits = row.get(token) if row is not None else None
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    pos, last, token = end, token, None
                    continue
            token = shorter.get(token)
            while token is None:  # nothing leads on from here: take the piece before back
                failed[pos] = 1
                back = out.pop()
                pos -= sizes[back] if back >= 0 else 1
                last = out[-1] if out else None
                token = shorter.get(back)
        return out

    def ids(self, tokens: list[int]) -> list[int]:
        """Ids of the pieces; a character without one gives its bytes, or the unknown id."""
        if min(tokens, default=0) >= 0:
            return tokens
        out = []
        for t in tokens:
            if t >= 0:
                out.append(t)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in chr(-t - 1).encode("utf-8")]
            elif not (out and out[-1] == self.unknown):  # neighbouring unknown characters are one token
                out.append(self.unknown)
        return out

    def slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and the number of ids of each, without begin or end."""
        plain = pa.array([self.library.normalize(t or "") for t in column.to_pylist()], pa.large_string())
        data, offsets = buffer_of(plain)
        starts, ends = self._segments(data, offsets)

        def encode_new(at: np.ndarray):
            texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            got = [self.ids(found) for found in self.segments(texts)]
            counts = np.array([len(g) for g in got], np.int64)
            flat = np.fromiter((i for g in got for i in g), np.uint32, int(counts.sum()))
            return flat, np.cumsum(counts) - counts, counts

        slots = self.store.slots_for(hash_spans(data, starts, ends), encode_new)
        sums = np.concatenate(([0], np.cumsum(self.store.length[slots])))
        bounds = np.searchsorted(starts, offsets)
        return self.store.gather(slots), sums[bounds[1:]] - sums[bounds[:-1]]

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut before each space mark that follows another character; texts are never joined."""
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 3:
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            cut[3:-1] = mark[3:] & ~mark[:-3]
        cut[offsets] = True
        places = np.flatnonzero(cut)
        return places[:-1], places[1:]


class _Stretches:
    """The longest pieces of a long segment, matched a stretch at a time."""

    def __init__(self, model: PieceModel, text: str):
        self.model, self.text, self.held = model, text, {}

    def __getitem__(self, at: int) -> int | None:
        part = at // STRETCH
        if part not in self.held:
            if len(self.held) > 1:
                self.held.clear()
            first = part * STRETCH
            self.held[part] = self.model.matches(self.text[first : first + STRETCH + self.model.longest_piece - 1])
        return self.held[part][at - part * STRETCH]


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The worker's model for a file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, end_id: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and, if asked for, `decoded` for every row of `docs` (doc_id, text).

    A null or empty text has no ids but the end id; a null doc_id stays null;
    repeated rows give repeated rows; other columns are not used. `decoded` is
    what the library makes of the ids; it equals the text where the model's
    normaliser keeps it.
    """

    def run(batch: pa.RecordBatch) -> dict:
        model = piece_model(path)
        flat, counts = model.slice(batch.column(1))
        stops = np.cumsum(counts)
        if end_id:
            flat = np.insert(flat, stops, model.eos)
            stops = stops + np.arange(1, len(stops) + 1)
        bounds = np.concatenate(([0], stops)).astype(np.int32)
        out = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))}
        if decoded:
            ids, at = flat.tolist(), bounds.tolist()
            out["decoded"] = model.library.decode([ids[a:b] for a, b in zip(at, at[1:])], num_threads=1)
        return out

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_slices(plain, run, "doc_id bigint, ids array<int>" + (", decoded string" if decoded else ""))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text for every row of `rows` (doc_id, ids): what the library decodes; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> dict:
        given = [i or [] for i in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "text": piece_model(path).library.decode(given, num_threads=1)}

    return map_slices(rows.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")), run, "doc_id bigint, text string", "")
