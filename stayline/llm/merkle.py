"""Document fingerprints: Merkle trees over sections, paragraphs and spans.

A paragraph is a line with its line feed. Long paragraphs are cut into spans at
words chosen by their content, so an edit moves no other cut. A section ends
behind an empty line, before a heading, or behind a paragraph chosen by its
content. Leaves hash their exact text; a node hashes its children. Leaves joined
give the text, so equal roots mean equal texts. Branches that differ show where
two texts differ.

A fingerprint is written as ROOT:SECTION|SECTION|..., a section as
HASH(LEAF,LEAF;LEAF,...): leaves by paragraph, each as eight hex digits of its
hash, a dot and its length in code points.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.arrow import slices

LEAF_HEX = 8
ROOT_HEX = 32
#: One word in so many ends a span, one paragraph in so many a section (powers of two).
SPAN_WORDS, SECTION_PARAGRAPHS = 8, 16
#: No span but a paragraph's last is shorter; a longer one ends at its next word.
SHORT_SPAN, LONG_SPAN = 16, 256
WORD = re.compile(r"(\S+)\s*")
PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")


def _hash(data: str, size: int) -> str:
    return hashlib.blake2b(data.encode("utf-8"), digest_size=size // 2).hexdigest()


def spans(paragraph: str) -> list[str]:
    """The leaves of a paragraph; joined they give it back."""
    if len(paragraph) <= SHORT_SPAN:
        return [paragraph] if paragraph else []
    out, start = [], 0
    for word in WORD.finditer(paragraph):
        end = word.end()
        # a cheap content hash of the word that is the same in every process
        first, last = paragraph[word.start()], paragraph[word.end(1) - 1]
        chosen = (ord(last) * 31 + ord(first) * 7 + word.end(1) - word.start()) % SPAN_WORDS == 0
        if end - start >= LONG_SPAN or chosen and end - start >= SHORT_SPAN:
            out.append(paragraph[start:end])
            start = end
    return [*out, paragraph[start:]] if start < len(paragraph) else out


def tree(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of leaves."""
    sections: list[list[list[str]]] = [[]]
    for paragraph in PARAGRAPH.findall(text):
        if paragraph.startswith("#") and sections[-1]:
            sections.append([])
        sections[-1].append(spans(paragraph))
        chosen = int(_hash(paragraph, 4), 16) % SECTION_PARAGRAPHS == 0
        if not paragraph.strip() or chosen:
            sections.append([])
    return [s for s in sections if s]


def fingerprint(text: str) -> str:
    """The written Merkle tree of a text."""
    written, tops = [], []
    for section in tree(text):
        paragraphs, shown = [], []
        for leaves in section:
            hashes = [_hash(leaf, ROOT_HEX) for leaf in leaves]
            paragraphs.append(_hash("p" + "".join(hashes), ROOT_HEX))
            shown.append(",".join(f"{h[:LEAF_HEX]}.{len(leaf)}" for h, leaf in zip(hashes, leaves)))
        tops.append(_hash("s" + "".join(paragraphs), ROOT_HEX))
        written.append(f"{tops[-1][:LEAF_HEX]}({';'.join(shown)})")
    return _hash("d" + "".join(tops), ROOT_HEX) + ":" + "|".join(written)


def root(written: str) -> str:
    return written.split(":", 1)[0]


def sections_of(written: str) -> list[tuple[str, list[str]]]:
    """Hash and leaves of each section of a fingerprint."""
    body = written.split(":", 1)[1]
    out = []
    for part in body.split("|") if body else []:
        at = part.index("(")
        out.append((part[:at], re.split("[,;]", part[at + 1 : -1])))
    return out


def likeness(a: str, b: str) -> float:
    """Shared text of two fingerprints: code points in common leaves over those of both (1 for equal roots).

    Sections with equal hashes are matched as a whole; only the leaves of the
    others are compared.
    """
    if root(a) == root(b):
        return 1.0
    of_a, of_b = sections_of(a), sections_of(b)
    same = Counter(s for s, _ in of_a) & Counter(s for s, _ in of_b)
    shared = total = 0
    left: list[Counter] = []
    for own in (of_a, of_b):
        take, leaves = same.copy(), Counter()
        for name, parts in own:
            size = sum(int(p.split(".")[1]) for p in parts)
            total += size
            if take[name]:
                take[name] -= 1
                shared += size
            else:
                leaves.update(parts)
        left.append(leaves)
    shared += 2 * sum(n * int(p.split(".")[1]) for p, n in (left[0] & left[1]).items())
    return shared / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Code-point ranges of the first text whose branches are not in the second."""
    of_b = sections_of(b)
    names, leaves = Counter(s for s, _ in of_b), Counter(p for _, parts in of_b for p in parts)
    out: list[tuple[int, int]] = []
    at = 0
    for name, parts in sections_of(a):
        known = names[name] > 0
        names[name] -= known
        for part in parts:
            size = int(part.split(".")[1])
            if not known and not leaves[part]:
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + size)
                else:
                    out.append((at, at + size))
            elif not known:
                leaves[part] -= 1
            at += size
    return out


def edited(text: str, other: str) -> str:
    """The last third of a text replaced by as many first code points of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


FINGERPRINTED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_edits bigint, edits array<struct<first:bigint,behind:bigint>>"
)


def compare_neighbours(docs: DataFrame, blocks_per_partition: int = 8) -> DataFrame:
    """Fingerprints of every row of `docs` (doc_id, text) and of its edit by the next row in descending doc_id.

    After the last row comes the first. A null text is empty; null doc_ids come
    last; rows with the same doc_id follow each other by text. Other columns are
    not used. An empty table gives no rows.

    `edits` are the code-point ranges of the text whose branches the edited text
    lacks, in order and apart from each other; they reach to the borders of leaves,
    so a range covers its edit and the rest of the leaves that it touches.

    doc_ids are cut into ranges; each range also gets the head of the next one,
    so texts are shuffled once and each task streams over neighbours.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = blocks_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = plain.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.5 / wanted)
    bounds = np.array(sorted({int(c) for c in cuts}), np.int64)  # as many as there are ranges, not documents

    def ranges(docs_of: pa.Array) -> np.ndarray:
        """How many bounds are at or below each doc_id; -1 for null, which comes last."""
        known = docs_of.fill_null(0).to_numpy()
        return np.where(docs_of.is_null().to_numpy(zero_copy_only=False), -1, np.searchsorted(bounds, known, "right"))

    def first_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int | None] = {}
        for batch in batches:
            for at, doc in zip(ranges(batch.column(0)).tolist(), batch.column(0).to_pylist()):
                most[at] = doc if most.get(at) is None else max(most[at], doc)
        yield pa.RecordBatch.from_arrays([pa.array(most, pa.int64()), pa.array(most.values(), pa.int64())], names=["range", "head"])

    found = plain.select("doc_id").mapInArrow(first_ids, "range bigint, head bigint").groupBy("range").agg(F.max("head").alias("head"))
    heads = sorted((tuple(r) for r in found.collect()), reverse=True)  # at most a row for each range
    # a range's first document is also the guest of the range above it; that of the highest range, of the lowest
    guest_of = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own = ranges(batch.column(0))
            guests = [i for i, doc in enumerate(batch.column(0).to_pylist()) if doc in guest_of]
            ids = batch.column(0).to_pylist()
            take = pa.array([*range(n), *guests], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, np.array([guest_of[ids[i]] for i in guests], np.int64)])),
                    pa.array(np.repeat(np.array([0, 1], np.int32), [n, len(guests)])),
                    batch.column(0).take(take), batch.column(1).take(take),
                ],
                names=["range", "guest", "doc_id", "text"],
            )

    dealt = plain.mapInArrow(deal, "range bigint, guest int, doc_id bigint, text string")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_stream, FINGERPRINTED)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each row with the next one of its range; the first guest ends a range."""
    names = [f.split()[0] for f in FINGERPRINTED.split(", ")]  # the fields of the struct have no blank behind their comma
    places = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), places]
    held = None  # range, doc_id, text and fingerprint of the row whose next one is awaited
    for batch in batches:
        for part in slices(batch, [len(t) for t in batch.column(3).to_pylist()], 1 << 20):
            out: list[tuple] = []
            for own_range, guest, doc, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                if guest and (held is None or held[0] != own_range):
                    continue  # a further row of the head
                mark = fingerprint(text)
                if held is not None and held[0] == own_range:
                    out.append(_pair(*held[1:], text, mark))
                held = None if guest else (own_range, doc, text, mark)
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _pair(doc: int | None, text: str, mark: str, after: str, after_mark: str) -> tuple:
    changed = edited(text, after)
    changed_mark = fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8")).hexdigest()
    places = [{"first": a, "behind": b} for a, b in edits(mark, changed_mark)]
    return doc, len(text), sha, mark, changed_mark, likeness(mark, changed_mark), likeness(mark, after_mark), len(places), places
