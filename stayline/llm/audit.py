"""Filter interaction audit: what each filter removes in every order of applying them.

Each document gets a mask of the filters it fails, and documents are counted by
part and mask, so a part has at most 2**filters counted masks however large it
is. From these a decision diagram is built: a level for each filter, at each
node a child for failing and one for passing, equal nodes shared, and at every
node the documents below it. Along the path on which everything passes, the
failing child at a level holds what its filter removes at that step, the passing
child what is kept. Another order of the filters needs no new diagram: two
neighbouring levels are swapped, and all orders are reached by such swaps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.arrow import map_slices
from stayline.llm.words import buffer_of
from stayline.session import cut_lineage

#: The filters of the study, in the order of their bits; the last one is a comparison between documents.
FILTERS = "ABCDE"
UPPER = bytes(range(65, 91))
#: Symbols that filter D does not allow.
SYMBOLS = b"#$%&*|"

#: documents, good ones, toxic ones
Weight = tuple[int, int, int]
ZERO: Weight = (0, 0, 0)


def add(a: Weight, b: Weight) -> Weight:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


class Diagram:
    """An ordered, reduced decision diagram over failure masks; each node is weighted by the documents below it.

    A leaf is a weight; an inner node is (level, passing child, failing child),
    found again by its children, so equal parts are one node.
    """

    def __init__(self, counts: Mapping[int, Weight], names: Sequence[str]):
        self.order = list(names)
        self.nodes: list[tuple] = []
        self.weights: list[Weight] = []
        self.found: dict[tuple, int] = {}
        n = len(names)
        layer = [self._leaf(counts.get(mask, ZERO)) for mask in range(1 << n)]
        for level in range(n - 1, -1, -1):  # bit i of a mask is filter i, and level i tests it
            half = 1 << level
            layer = [self.node(level, layer[m], layer[m + half]) for m in range(half)]
        self.root = layer[0]

    def _keep(self, key: tuple, weight: Weight) -> int:
        at = self.found.get(key)
        if at is None:
            at = self.found[key] = len(self.nodes)
            self.nodes.append(key)
            self.weights.append(weight)
        return at

    def _leaf(self, weight: Weight) -> int:
        return self._keep(("leaf", weight), weight)

    def node(self, level: int, passing: int, failing: int) -> int:
        return self._keep((level, passing, failing), add(self.weights[passing], self.weights[failing]))

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and the next one; levels below stay as they are."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        done: dict[int, int] = {}

        def rebuilt(at: int) -> int:
            if at not in done:
                here, passing, failing = self.nodes[at]
                if here < level:
                    done[at] = self.node(here, rebuilt(passing), rebuilt(failing))
                else:
                    _, pp, pf = self.nodes[passing]
                    _, fp, ff = self.nodes[failing]
                    done[at] = self.node(level, self.node(level + 1, pp, fp), self.node(level + 1, pf, ff))
            return done[at]

        self.root = rebuilt(self.root)

    def steps(self) -> Iterator[tuple[Weight, Weight]]:
        """(removed, kept) of each step in the present order, along the path on which everything passes."""
        at = self.root
        for _ in self.order:
            _, passing, failing = self.nodes[at]
            yield self.weights[failing], self.weights[passing]
            at = passing


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places whose swap with the next, one after the other, leads through all orders of n things once each."""
    order, way = list(range(n)), [-1] * n
    while True:
        movable = [v for v in order if 0 <= (to := order.index(v) + way[v]) < n and order[to] < v]
        if not movable:
            return
        largest = max(movable)
        at = order.index(largest)
        to = at + way[largest]
        order[at], order[to] = order[to], order[at]
        for v in range(largest + 1, n):
            way[v] = -way[v]
        yield min(at, to)


STEPS = (
    "filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def audit_steps(counts: Mapping[int, Weight], names: Sequence[str]) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    failing = {f: sum(w[0] for mask, w in counts.items() if mask >> i & 1) for i, f in enumerate(names)}
    unique = {f: counts.get(1 << i, ZERO)[0] for i, f in enumerate(names)}
    diagram = Diagram(counts, names)
    rows, shares = [], dict.fromkeys(names, 0)

    def note() -> None:
        name = "".join(diagram.order)
        for step, (f, (removed, kept)) in enumerate(zip(diagram.order, diagram.steps()), 1):
            shares[f] += removed[0]
            rows.append((name, step, f, kept[0], removed[0], failing[f] - removed[0], unique[f], removed[1], removed[2]))

    note()
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        note()
    return [(name, step, *rest, shares[f]) for name, step, f, *rest in rows]


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (filters A to D), digest of the text for every row of `docs` (doc_id, text, part).

    A null text is empty, a null part the empty string; other columns are not used.
    """

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(1).fill_null("")
        data, offsets = buffer_of(column)
        whole, bounds = data.tobytes(), offsets.tolist()
        chars = pc.utf8_length(column).to_pylist()
        masks, digests = np.zeros(len(column), np.int32), []
        for i, (a, b, n) in enumerate(zip(bounds, bounds[1:], chars)):
            text = whole[a:b]
            words = text.split()  # bytes are cut at space and \t to \r only
            upper = len(text) - len(text.translate(None, UPPER))
            symbol = len(text.translate(None, SYMBOLS)) < len(text)
            masks[i] = (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * n) << 2 | symbol << 3
            digests.append(hashlib.sha256(text).digest())
        return {"doc_id": batch.column(0), "part": batch.column(2), "mask": masks, "digest": pa.array(digests, pa.binary())}

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    return map_slices(plain, run, "doc_id bigint, part string, mask int, digest binary")


def counted_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good, toxic of the documents.

    A document fails filter E if a smaller doc_id holds the same text; a null
    doc_id is smaller than none, has none below it and no labels. Several labels of a
    doc_id count as good or toxic if one of them says so.
    """
    rows = cut_lineage(failure_masks(docs))  # read three times; no texts in it
    # The first holder of each text; from there on the keys are numbers of documents, which no text makes hot.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.select("doc_id", "digest", F.lit(True).alias("_first"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    numbered = rows.where("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    bit = F.when(F.col("_first"), 0).otherwise(1 << 4)
    known = numbered.select("part", F.col("mask").bitwiseOR(bit).alias("mask"), "_good", "_toxic")
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(None).cast("int").alias("_good"), F.lit(None).cast("int").alias("_toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("_good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"),
    )


def audit(counts: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """The steps of every order of the filters for each part of `counts` (part, mask, n, good, toxic).

    Without rows there are no parts and no steps. `names` stand for the bits of
    the mask from the lowest on, a letter each.
    """
    names = list(names)

    def run(batch: pa.RecordBatch) -> dict:
        parts, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [(p, *row) for p, c in zip(parts, cells) for row in audit_steps({x["mask"]: (x["n"], x["good"], x["toxic"]) for x in c}, names)]
        columns = list(zip(*out)) if out else [()] * 10
        return {
            f.split()[0]: pa.array(c, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.split()[1]])
            for f, c in zip(("part string, " + STEPS).split(", "), columns)
        }

    one = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a row for each mask at most
    return map_slices(one, run, "part string, " + STEPS, "")
