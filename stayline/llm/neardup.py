"""Near-duplicate classes by consistent weighted samples over TF-IDF shingles.

1. Document frequencies: shingles in a share of all documents get a lower weight
   (`weighted.Idf`). A first pass adds up documents by hash cells, a second one
   counts exactly the shingles of cells that are full enough.
2. Texts with equal shingles become one entry. Each gets improved consistent
   weighted samples, banded into keys.
3. The members of a key are dealt into blocks of bounded size. A block compares
   all its members by exact weighted Jaccard similarity, as one matrix product
   over shared shingles, and the key's first member is in each block. Keys with
   the same members are compared once.
4. Links give components. Only for keys of several blocks whose members are not
   yet in one component, the members outside the key's largest component are
   compared with its other blocks, so no link between members of a key is lost.

Blocks give links that join components, not all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.arrow import by_text, map_slices
from stayline.llm.columns import numbered, restored
from stayline.llm.components import components
from stayline.llm.weighted import WIDTH, Idf, Sampler, bags, band_keys, digest, expanded, similarity
from stayline.session import cut_lineage

CHUNK = 1 << 16


@dataclass(frozen=True)
class Settings:
    """How near is near, and how the work is cut."""

    threshold: float = 0.8
    width: int = WIDTH
    bands: int = 10
    rows: int = 4
    #: A shingle in at least this share of documents counts as common.
    common: float = 0.01
    #: The weight a shingle in all documents would keep.
    idf_floor: float = 0.8
    cells: int = 1 << 20
    block_shingles: int = 1 << 20
    block_members: int = 1500


def document_frequencies(docs: DataFrame, settings: Settings) -> Idf:
    """Weights of common shingles, from all rows of `docs` (text)."""
    n_docs = docs.count()
    least = max(2, int(np.ceil(settings.common * n_docs)))
    cells, width = settings.cells, settings.width
    shift = np.uint64(64 - cells.bit_length() + 1)

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for part in by_text(batch):
                every = [h for h, _ in bags(part.column(0), width)]
                total += np.bincount((np.concatenate(every) >> shift).astype(np.int64), minlength=cells)
        yield _chunks({i: total[i * CHUNK : (i + 1) * CHUNK] for i in range(-(-cells // CHUNK)) if total.any()})

    def add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(packed), np.int64)
                total[at] = total[at] + got if at in total else got
        full = [at * CHUNK + i for at, v in total.items() for i in np.flatnonzero(v >= least).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64())], names=["cell"])

    texts = docs.select(F.col("text").cast("string"))
    sums = texts.mapInArrow(count_cells, "chunk int, counts binary").repartition("chunk").mapInArrow(add_chunks, "cell bigint")
    # a full cell has `least` documents, so there are at most (shingles of all documents) / least of them
    full = np.zeros(cells, bool)
    full[[r["cell"] for r in sums.collect()]] = True
    if not full.any():
        return Idf(np.zeros(0, np.uint64), np.zeros(0))

    def count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_text(batch):
                every = np.concatenate([h for h, _ in bags(part.column(0), width)])
                found, times = np.unique(every[full[(every >> shift).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["shingle", "n"])

    counted = texts.mapInArrow(count_shingles, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("df"))
    common = counted.where(F.col("df") >= least).collect()  # bounded like the full cells
    hashes = np.array([r["shingle"] for r in common], np.int64).view(np.uint64)
    return Idf.of(hashes, np.array([r["df"] for r in common], float), n_docs, settings.common, settings.idf_floor)


def _chunks(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    packed = [zlib.compress(v.tobytes(), 1) for v in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])


def sketches(docs: DataFrame, idf: Idf, settings: Settings) -> DataFrame:
    """doc_id, text_hash, digest (of the shingles), n_shingles and band keys of each row of `docs`."""
    width, bands = settings.width, settings.bands
    samples = bands * settings.rows

    def run(batch: pa.RecordBatch) -> dict:
        sampler = Sampler(samples)
        own = bags(batch.column(2), width)
        keys = [band_keys(sampler(h, n * idf(h)), bands).view(np.int64) for h, n in own]
        flat = np.concatenate([np.zeros(0, np.int64), *keys])
        return {
            "doc_id": batch.column(0),
            "text_hash": batch.column(1),
            "digest": pa.array([digest(b) for b in own], pa.binary()),
            "n_shingles": np.array([n.sum() for _, n in own], np.int64),
            "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bands), pa.array(flat)),
        }

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_slices(plain, run, "doc_id bigint, text_hash bigint, digest binary, n_shingles bigint, keys array<bigint>")


def vectors(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """node, shingles and times (binary) of the rows of `wanted` (doc_id, text_hash, node)."""
    width = settings.width

    def run(batch: pa.RecordBatch) -> dict:
        own = bags(batch.column(1), width)
        return {
            "node": batch.column(0),
            "shingles": pa.array([h.tobytes() for h, _ in own], pa.binary()),
            "times": pa.array([b"" if n.max() == 1 else n.astype(np.int64).tobytes() for _, n in own], pa.binary()),
        }

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    both = plain.join(wanted, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    return map_slices(both.select("node", "text"), run, "node binary, shingles binary, times binary")


class _Links:
    """Union-find over the members of one block; keeps the links that joined components."""

    def __init__(self, labels: list):
        self.parent = list(range(len(labels)))
        first: dict = {}
        for i, label in enumerate(labels):
            if label is not None:
                self.parent[i] = first.setdefault(label, i)
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.found.append((i, j))


def block_links(sets: list[tuple[np.ndarray, np.ndarray]], labels: list, probes: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Links of similarity `threshold` or more that join components of a block.

    labels: known components, equal ones need no link. probes: which members
    are compared with the others (all by default).
    """
    links = _Links(labels)
    n = len(sets)
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if links.root(i) != links.root(j) and (probes is None or probes[i] or probes[j]):
                    if similarity(sets[i], sets[j]) >= threshold:
                        links.join(i, j)
        return links.found
    total = np.array([w.sum() for _, w in sets])
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    elements, weights = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    distinct, column, times = np.unique(elements, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column, weights = owner[shared], column[shared], weights[shared]
    place = np.cumsum(times > 1) - 1
    column = place[column]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column, weights = owner[order], column[order], weights[order]
    step = 2048
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        there = np.zeros((n, step), np.float32)
        there[owner[lo:hi], column[lo:hi] - a] = np.sqrt(weights[lo:hi])
        common += there @ there.T
    # a little below the threshold in single precision, then exactly
    near = common >= (threshold - 1e-3) * (total[:, None] + total[None, :] - common)
    if probes is not None:
        near &= probes[:, None] | probes[None, :]
    rows, columns = np.nonzero(np.triu(near, 1))
    for i, j in zip(rows.tolist(), columns.tolist()):
        if links.root(i) != links.root(j) and similarity(sets[i], sets[j]) >= threshold:
            links.join(i, j)
    return links.found


def compare_blocks(members: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Links (a, b) within blocks of `members` (key, part, node, shingles, times, label, probe)."""

    def flush(nodes: list, sets: list, labels: list, probes: list) -> list[tuple[bytes, bytes]]:
        some = np.array(probes, bool)
        found = block_links(sets, labels, None if some.all() else some, threshold)
        return [(nodes[i], nodes[j]) for i, j in found if nodes[i] != nodes[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for key, part, node, shingles, times, label, probe in zip(*columns):
                if (key, part) != at:
                    out += flush(*held) if len(held[0]) > 1 else []
                    at, held = (key, part), ([], [], [], [])
                h = np.frombuffer(shingles, np.uint64)
                n = np.frombuffer(times, np.int64) if times else np.ones(len(h), np.int64)
                for to, v in zip(held, (node, expanded(h, n, idf), label, probe)):
                    to.append(v)
            yield _links(out)
        yield _links(flush(*held) if len(held[0]) > 1 else [])

    def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    rows = members.select("key", "part", "node", "shingles", "times", "label", "probe")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(run, "a binary, b binary")


def _parts(shingles: Column, n: Column, settings: Settings) -> Column:
    by_size = F.ceil(shingles / F.lit(settings.block_shingles))
    return F.greatest(by_size, F.ceil(n / F.lit(settings.block_members))).cast("int")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and class_size (rows) for every row of `docs` (doc_id, text).

    Texts are compared by runs of five words with A-Z folded; shorter texts by
    all their words; texts without words (null ones too) are equal. Repeated
    rows and equal texts share a class. A null doc_id stays null and never names
    a class that has another doc_id. An empty table gives no rows. Other columns
    are not used.
    """
    of_row = _classes(docs, settings)
    classes = of_row.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return of_row.join(classes, "_class").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of `docs` of each near-duplicate class, with all its columns: that of the least doc_id (null only if all are)."""
    row = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_hash")
    kept = _classes(docs, settings).groupBy("_class").agg(F.min(row).alias("_row"))
    kept = kept.select(F.col("_row.doc_id").alias("_kept_id"), F.col("_row.text_hash").alias("_kept_hash")).distinct()
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*numbered(names), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(text).alias("_hash"))
    both = own.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")))
    # rows that repeat doc_id and text are one document
    return both.dropDuplicates(["_id", "_hash"]).select(*restored(names))


def _classes(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_hash and _class of every row."""
    idf = document_frequencies(docs, settings)
    rows = cut_lineage(sketches(docs, idf, settings))
    nodes = rows.groupBy(F.col("digest").alias("node")).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("_row"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles")
    )
    banded = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    keys = (
        banded.groupBy("key")
        .agg(
            F.count("*").alias("members"), F.sum("n_shingles").alias("_shingles"), F.min("node").alias("first"),
            F.max("node").alias("_last"), F.sum(F.shiftright(F.xxhash64("node"), 16)).alias("_set"),
        )
        .where("members > 1")
        .groupBy("members", "_shingles", "first", "_last", "_set")
        .agg(F.min("key").alias("key"))
        .select("key", "first", _parts(F.col("_shingles"), F.col("members"), settings).alias("parts"))
    )
    member = cut_lineage(banded.join(keys, "key").select("key", "node", "n_shingles", "first", "parts"))
    wanted = nodes.join(member.select("node").distinct(), "node").select("node", "_row.doc_id", "_row.text_hash")
    known = cut_lineage(vectors(docs, wanted, settings))
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    dealt = member.select(
        "key", "node",
        F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))).alias("part"),
        F.lit(None).cast("binary").alias("label"), F.lit(True).alias("probe"),
    )
    links = cut_lineage(compare_blocks(dealt.join(known, "node"), idf, settings.threshold))
    labels = components(links)
    links = links.unionByName(_rest(member, labels, known, idf, settings))
    labels = components(links)
    return rows.join(labels, rows["digest"] == labels["node"], "left").select(
        "doc_id", "text_hash", F.coalesce("label", "digest").alias("_class")
    )


def _rest(member: DataFrame, labels: DataFrame, known: DataFrame, idf: Idf, settings: Settings) -> DataFrame:
    """Links across the blocks of keys whose members are still in several components."""
    large = member.where("parts > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = cut_lineage(large.select("key", "node", "n_shingles", "parts", "label"))
    by_label = large.groupBy("key", "label").agg(F.count("*").alias("_n"))
    main = by_label.groupBy("key").agg(F.max_by("label", F.struct("_n", "label")).alias("main"), F.count("*").alias("_labels"))
    split = large.join(main.where("_labels > 1").select("key", "main"), "key")
    apart = split.where("label <> main")
    sizes = apart.groupBy("key").agg(_parts(F.sum("n_shingles"), F.count("*"), settings).alias("apart_parts"))
    both = split.join(sizes, "key")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    probe = F.pmod(F.xxhash64("node", F.lit(3)), F.col("apart_parts")).cast("int")
    others = both.select(
        "key", "node", "label", F.lit(False).alias("probe"), own.alias("_own"),
        F.explode(F.sequence(F.lit(0), F.col("apart_parts") - 1)).alias("_probe"),
    )
    probes = both.where("label <> main").select(
        "key", "node", "label", F.lit(True).alias("probe"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_own"), probe.alias("_probe"),
    )
    dealt = others.unionByName(probes).withColumn("part", F.col("_own") * F.lit(1 << 15) + F.col("_probe")).drop("_own", "_probe")
    return compare_blocks(dealt.join(known, "node"), idf, settings.threshold)
