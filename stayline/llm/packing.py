"""Packing documents into sequences of a fixed number of tokens by linear grouping.

Only the number of pieces of each length reaches the driver: at most one number
for each length up to the capacity, whatever the corpus. From these it plans how
sequences are made; the pieces themselves find their places in parallel.

The plan follows the linear grouping scheme. Large lengths are cut, in order,
into groups with equally many pieces and rounded up to the longest of their
group, so few sizes are left. The linear program over configurations (which
sizes share a sequence) is solved by column generation, and whole multiples of
its configurations are used. Actual pieces take the slots of their group, which
leaves gaps, never overlaps; the last slot of a sequence takes the longest piece
that fits, so that little is lost to rounding. What is left over, then the small pieces, longest
first, go where they fit best, counted by gap and not one by one.

A plan is a list of runs: pieces of one length with ranks first..last lie at one
offset of sequences sequence..sequence + last - first.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm import tokens
from stayline.llm.arrow import by_text
from stayline.session import cut_lineage

CAPACITY = 2048
GROUPS = (32, 64)
#: Lengths above this share of the capacity are large.
LARGE_SHARE = 1 / 8
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, block int, nth bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every row of `docs` (doc_id, text), with their task and rank among its pieces of that length.

    A null text is empty, so its piece is the end id alone; a null doc_id stays
    null; repeated rows give repeated pieces. Documents of more than `capacity`
    ids are cut into pieces of `capacity`, of which the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, np.int64)
        coder = tokens.encoder(path)
        for batch in batches:
            for part in by_text(batch):
                ids, counts = coder.slice(part.column(1))
                flat = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                sizes = counts + 1
                n_pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                head = sizes - (n_pieces - 1) * capacity
                length = np.where(piece == 0, head[row], capacity)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                at = (np.cumsum(sizes) - sizes)[row] + start
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - first + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                crc = np.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at + length)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                        pa.array(crc), pa.array(np.full(len(row), block, np.int32)), pa.array(nth),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"],
                )

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return plain.mapInArrow(run, PIECES)


def linear_groups(count: np.ndarray, smallest: int, groups: int) -> list[list[tuple[int, int]]]:
    """Pieces of length smallest.. in order, cut into groups of equal number: (length, pieces) lists, ascending."""
    total = int(count[smallest:].sum())
    share = max(1, -(-total // groups))
    out, here, room = [], [], share
    for length in range(smallest, len(count)):
        left = int(count[length])
        while left:
            take = min(left, room)
            here.append((length, take))
            left, room = left - take, room - take
            if not room:
                out.append(here)
                here, room = [], share
    return [*out, here] if here else out


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest value: a knapsack by number of pieces, sizes may repeat."""
    layers = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    chosen = []
    for _ in range(layers):
        after, choice = best.copy(), np.full(capacity + 1, -1)
        for g, (size, v) in enumerate(zip(sizes.tolist(), value.tolist())):
            if v <= 0:
                continue
            gain = best[: capacity + 1 - size] + v
            better = gain > after[size:] + 1e-12
            after[size:][better] = gain[better]
            choice[size:][better] = g
        chosen.append(choice)
        if np.array_equal(after, best):
            break
        best = after
    out, room = np.zeros(len(sizes)), capacity
    for choice in reversed(chosen):
        if choice[room] >= 0:
            out[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(out @ value), out


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 3000) -> list[tuple[int, np.ndarray]]:
    """Whole multiples of the configurations of a (nearly) best fractional packing."""
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(steps):
        dual = np.linalg.solve(basis.T, np.ones(len(size)))
        value, column = _best_configuration(size, dual, capacity)
        if value <= 1 + 1e-7:
            break
        used, move = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, np.maximum(used, 0) / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.floor(np.linalg.solve(basis, need) + 1e-6).astype(np.int64)
    return [(int(t), basis[:, j].astype(int)) for j, t in enumerate(times) if t > 0]


@dataclass
class Plan:
    """Runs as parallel lists, and how many sequences there are."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    pieces: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


class _Packer:
    """Bins in runs (first sequence, number) with one gap each."""

    def __init__(self, count: np.ndarray, capacity: int):
        self.capacity, self.left, self.next = capacity, count.astype(np.int64).copy(), np.zeros(len(count), np.int64)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.plan = Plan()

    def open(self, n: int) -> tuple[int, int]:
        first = self.plan.sequences
        self.plan.sequences += n
        return first, n

    def put(self, length: int, first: int, n: int, gap: int) -> int:
        """One piece of this length into each of n bins with this gap; the gap left."""
        for name, v in (("length", length), ("rank", int(self.next[length])), ("pieces", n), ("sequence", first), ("offset", self.capacity - gap)):
            getattr(self.plan, name).append(v)
        self.next[length] += n
        self.left[length] -= n
        return gap - length

    def take(self, low: int, high: int, first: int, n: int, gap: int) -> list[tuple[int, int, int]]:
        """Put the longest pieces left of a length in low..high into n bins; runs (first, number, gap) after it."""
        out = []
        while n:
            there = np.flatnonzero(self.left[low : high + 1])
            if not len(there):
                return [*out, (first, n, gap)]
            length = low + int(there[-1])
            k = min(n, int(self.left[length]))
            out.append((first, k, self.put(length, first, k, gap)))
            first, n = first + k, n - k
        return out

    def configured(self, times: int, config: np.ndarray, sizes: list[int], smallest: int) -> None:
        """Up to `times` bins by a configuration, as many as its largest group still has pieces for.

        A slot takes the longest piece left of its group, else a shorter large
        one, which fits too; the last slot takes the longest piece that fits the
        gap the others left.
        """
        slots = [sizes[g] for g in np.repeat(np.arange(len(config)), config)[::-1].tolist()]
        below = max((s for s in sizes if s < slots[0]), default=smallest - 1)
        times = min(times, int(self.left[below + 1 : slots[0] + 1].sum()))
        if not times:
            return
        runs = [(*self.open(times), self.capacity)]
        for i, size in enumerate(slots):
            last = i == len(slots) - 1
            low = below + 1 if i == 0 else smallest
            runs = [r for first, n, gap in runs for r in self.take(low, min(gap, gap if last and i else size), first, n, gap)]
        for first, n, gap in runs:
            self.gaps[gap].append((first, n))

    def best_fit(self, length: int) -> None:
        """All pieces of this length that are left, each into the smallest gap it fits."""
        while self.left[length]:
            fitting = [g for g, runs in self.gaps.items() if g >= length and runs]
            want = int(self.left[length])
            if fitting:
                gap = min(fitting)
                first, n = self.gaps[gap].pop()
                take = min(n, want)
                if n > take:
                    self.gaps[gap].append((first + take, n - take))
                self.gaps[self.put(length, first, take, gap)].append((first, take))
                continue
            per = self.capacity // length
            full = want // per
            first, n = self.open(full or 1)
            gap = self.capacity
            for _ in range(per if full else want):
                gap = self.put(length, first, n, gap)
            self.gaps[gap].append((first, n))


def plan_packing(count: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
    """count[l] pieces of each length l in 1..capacity; places for all of them.

    The scheme leaves open how many groups there are and in which order
    configurations are filled; of a few choices the plan with the fewest
    sequences is kept.
    """
    smallest = int(capacity * LARGE_SHARE) + 1
    best = None
    for number in groups:
        packer = _Packer(count, capacity)
        # groups that round to the same length are one size
        demand: dict[int, int] = defaultdict(int)
        large = packer.left.copy()
        large[capacity] = 0
        for group in linear_groups(large, smallest, number):
            demand[group[-1][0]] += sum(n for _, n in group)
        sizes = list(demand)
        found = configurations(sizes, list(demand.values()), capacity) if sizes else []
        for ordered in (found, sorted(found, key=lambda f: -int(f[1] @ np.array(sizes)))):  # or the fullest first
            packer = _Packer(count, capacity)
            if packer.left[capacity]:
                first, n = packer.open(int(packer.left[capacity]))
                packer.put(capacity, first, n, capacity)
            for times, config in ordered:
                packer.configured(times, config, sizes, smallest)
            for length in range(capacity, 0, -1):
                packer.best_fit(length)
            if best is None or packer.plan.sequences < best.sequences:
                best = packer.plan
    return best


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, end_id: int = 0) -> DataFrame:
    """Every piece of `docs` with its sequence and offset; sequences are gapless from offset 0.

    Pieces are stored once in the shared folder with their rank in their task;
    a rank over all tasks comes from the tasks' counts by length. An empty
    table gives no rows.
    """
    pieces = cut_lineage(cut_pieces(docs, path, capacity, end_id))
    by_task = pieces.groupBy("block", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("block", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    count = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most `capacity` rows
        count[row["length"]] = row["n"]
    plan = plan_packing(count, capacity, groups)
    length, rank = np.array(plan.length, np.int64), np.array(plan.rank, np.int64)
    order = np.lexsort((rank, length))
    length, rank = length[order], rank[order]
    sequence, offset = np.array(plan.sequence, np.int64)[order], np.array(plan.offset, np.int64)[order]
    bounds = np.searchsorted(length, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            own = of["length"].to_numpy()
            nth = of["nth"].to_numpy() + of["_base"].to_numpy()
            run = np.empty(len(own), np.int64)
            for size in np.unique(own).tolist():
                here = own == size
                a, b = bounds[size], bounds[size + 1]
                run[here] = a + np.searchsorted(rank[a:b], nth[here], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(of[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(sequence[run] + nth - rank[run]), pa.array(offset[run]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return pieces.join(base, ["block", "length"]).mapInArrow(place, PLACED)
