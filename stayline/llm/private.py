"""Personal data: pattern spans, and terms that give protected entities away by co-occurrence.

Protected are the values found by the patterns and the classes above them (mail
domain, ip network, phone prefix, card issuer, kind), which recur where single
values do not. What a term discloses of an entity is the lower confidence bound of
the probability that a text with the term holds the entity, provided that this
exceeds the entity's own share of all texts, that is, that the lower bound of
their pointwise mutual information is above zero. One or two chance meetings
prove little, however large the corpus, and texts that hold neither the term nor
the entity change nothing. In a document that holds the entity, terms above one
threshold are generalised to their shape and above a higher one removed, besides
the patterns' own spans.

Terms are runs of letters and digits, A-Z folded, and are counted by a 64-bit
hash. All counts are over the distinct texts of all documents, so copies of a
text prove nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.arrow import by_text, map_slices, texts_of
from stayline.llm.words import ALNUM, FOLD, buffer_of, cut_words, hash_spans, row_bounds
from stayline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its start only: no later start in it can match where the first does not.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ so that long runs cost no retries."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        # a failed @ is no local character, so nothing before it can be in a later match
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end and kind of all pattern spans, by start, then in the order of KINDS."""
    found = [(a, b, "email") for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass(frozen=True)
class Disclosure:
    """Least texts of an entity and of an entity with a term, the two thresholds, and the quantile of the lower bound."""

    support: int = 3
    generalise: float = 0.5
    remove: float = 0.75
    z: float = 1.645  # one-sided 95 %
    cells: int = 1 << 22


def entity_of(kind: str, value: str) -> str:
    """One name for the spellings of a value: case of addresses and punctuation of numbers do not count."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def protected(kind: str, value: str) -> list[str]:
    """The value and the classes above it."""
    name = entity_of(kind, value)
    own = name.split(":", 1)[1]
    above = {
        "email": lambda: "domain:" + own.rsplit("@", 1)[1],
        "ip": lambda: "network:" + ".".join(own.split(".")[:3]),
        "card": lambda: "issuer:" + own[:6],
        "phone": lambda: "prefix:" + own[:4],
    }[kind]()
    return [name, above, f"kind:{kind}"]


SCANNED = "uid bigint, doc_id bigint, digest string, base string, entities array<string>, text string"


def scan(docs: DataFrame) -> DataFrame:
    """uid, doc_id, digest of the text, pattern spans (kind:start:end, comma-joined), entities, and the text where there is an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for part in by_text(batch):
                texts = texts_of(part)
                spans = [base_spans(t) for t in texts]
                names = [sorted({e for a, b, k in s for e in protected(k, t[a:b])}) for t, s in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + len(texts))), part.column(0), part.column(2),
                        pa.array([written(s) for s in spans], pa.string()), pa.array(names, pa.list_(pa.string())),
                        pa.array([t if n else None for t, n in zip(texts, names)], pa.string()),
                    ],
                    names=["uid", "doc_id", "digest", "base", "entities", "text"],
                )
                uid += len(texts)

    return docs.select(F.col("doc_id").cast("bigint"), *keyed_text()).mapInArrow(run, SCANNED)


def keyed_text() -> tuple[Column, Column]:
    """The text, a null one as empty, and its digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return text.alias("text"), F.md5(text).alias("digest")


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def read_spans(text: str) -> list[tuple[int, int, str]]:
    return [(int(a), int(b), k) for k, a, b in (s.split(":") for s in text.split(","))] if text else []


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each row, and where each row begins."""
    data, offsets = buffer_of(column)
    starts, ends, rows = cut_words(data, offsets, ALNUM)
    return hash_spans(FOLD[data], starts, ends), row_bounds(rows, len(column))


def document_terms(rows: DataFrame) -> DataFrame:
    """uid and term for each distinct term of each row of `rows` (uid, text)."""

    def run(batch: pa.RecordBatch) -> dict:
        hashes, bounds = term_hashes(batch.column(1))
        own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        ids = np.repeat(batch.column(0).to_numpy(), [len(h) for h in own])
        return {"uid": ids, "term": np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)}

    return map_slices(rows, run, "uid bigint, term bigint")


def cells_of(rows: DataFrame, key: Column, settings: Disclosure) -> tuple[np.ndarray, int]:
    """A table of at most `cells` flags, set for the 64-bit keys of `rows`, and the shift from key to cell."""
    shift = 64 - settings.cells.bit_length() + 1
    found = rows.select(F.shiftrightunsigned(key, shift).alias("cell")).distinct().toArrow()
    flags = np.zeros(settings.cells, bool)
    flags[found.column(0).to_numpy()] = True
    return flags, shift


def texts_of_terms(docs: DataFrame, scanned: DataFrame, together: DataFrame, settings: Disclosure) -> DataFrame:
    """term and n_term, its distinct texts in the whole corpus, for the terms of `together` at least.

    Only texts whose digest may occur twice are shuffled to be told apart; both
    fixed-size tables of cells leave rows out before a shuffle.
    """
    keep, shift = cells_of(together, F.col("term"), settings)
    copied = scanned.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    again, by = cells_of(copied, F.xxhash64("digest"), settings)
    rows = docs.select(*keyed_text()).select(F.xxhash64("digest").alias("uid"), "text", "digest")

    def run(batch: pa.RecordBatch) -> dict:
        key = batch.column(0).to_numpy().view(np.uint64)
        hit = pa.array(again[(key >> np.uint64(by)).astype(np.int64)])
        part = batch.filter(hit)
        return {"uid": part.column(0), "text": part.column(1), "digest": part.column(2)}

    def count(batch: pa.RecordBatch) -> dict:
        key = batch.column(0).to_numpy().view(np.uint64)
        single = ~again[(key >> np.uint64(by)).astype(np.int64)] if batch.num_columns > 2 else np.ones(batch.num_rows, bool)
        hashes, bounds = term_hashes(batch.column(1))
        own = [np.unique(hashes[a:b]) for a, b, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), single.tolist()) if s]
        terms, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
        kept = keep[(terms >> np.uint64(shift)).astype(np.int64)]
        return {"term": terms[kept].view(np.int64), "n": times[kept]}

    once = map_slices(rows, count, "term bigint, n bigint")
    told_apart = map_slices(rows, run, "uid bigint, text string, digest string").dropDuplicates(["digest"])
    copies = map_slices(told_apart.select("uid", "text"), count, "term bigint, n bigint")
    return once.unionByName(copies).groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(docs: DataFrame, scanned: DataFrame, settings: Disclosure) -> DataFrame:
    """digest and term for the terms of each scanned text that give one of its entities away, with their disclosure.

    An entity of fewer texts than the support proves nothing and is left out before
    terms are paired with it, so a long list of single values costs no pairs.
    Entities of the same texts have the same counts with every term and are one group.
    """
    n_texts = scanned.select("digest").distinct().count()
    holding = scanned.where(F.size("entities") > 0)
    first = holding.groupBy("digest").agg(F.min("uid").alias("uid")).select("uid")
    texts = cut_lineage(holding.join(first, "uid", "left_semi").select("uid", "digest", "entities", "text"))
    names = texts.select("uid", F.explode("entities").alias("entity"))
    entities = names.groupBy("entity").agg(
        F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("uid")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("_b")
    )
    entities = entities.where(F.col("n_entity") >= settings.support)
    grouped = names.join(entities, "entity").select("uid", F.xxhash64("n_entity", "_a", "_b").alias("entity"), "n_entity").distinct()
    frequent = cut_lineage(grouped)
    pairs = cut_lineage(document_terms(texts.select("uid", "text")).join(frequent, "uid"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"))
    together = cut_lineage(together.where(F.col("n_both") >= settings.support))
    counted = together.join(texts_of_terms(docs, scanned, together, settings), "term")
    flagged = counted.withColumn("disclosure", disclosed(n_texts, settings)).where(F.col("disclosure") >= settings.generalise)
    told = pairs.join(flagged.select("entity", "term", "disclosure"), ["entity", "term"])
    told = told.groupBy("uid", "term").agg(F.max("disclosure").alias("disclosure"))
    return told.join(texts.select("uid", "digest"), "uid").drop("uid")


def disclosed(n_texts: int, settings: Disclosure) -> Column:
    """Lower bound of the share of a term's texts that hold the entity, 0 where it is not above the share of all texts."""
    n, k, z2 = F.col("n_term").cast("double"), F.col("n_both").cast("double"), settings.z**2
    spread = F.lit(settings.z) * F.sqrt(k * (n - k) / n + F.lit(z2 / 4))
    low = (k + F.lit(z2 / 2) - spread) / (n + F.lit(z2))
    return F.when(low * F.lit(float(n_texts)) > F.col("n_entity"), low).otherwise(F.lit(0.0))


PRIVATE = "doc_id bigint, base string, spans string, sanitised string"


def shape(term: str) -> str:
    """A term in general: digits as 0, letters as their case."""
    return re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", re.sub(r"\d", "0", term))


def sanitise(docs: DataFrame, settings: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, base and all spans, and the sanitised text (null where nothing changes) of every row of `docs`.

    Spans are kind:start:end in code points, comma-joined by start; kinds are
    those of the patterns, "general" and "removed". A null text is empty; a null
    doc_id stays null; repeated rows give repeated rows, but equal texts count as
    one; other columns are not used. An empty table gives no rows.
    """
    scanned = cut_lineage(scan(docs))
    terms = disclosing_terms(docs, scanned, settings)
    by_text = terms.groupBy("digest").agg(F.collect_list("term").alias("terms"), F.collect_list("disclosure").alias("strength"))
    remove = settings.remove

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("base", "spans", "sanitised")}
        column = batch.column(2)
        data, offsets = buffer_of(column)
        starts, ends, rows = cut_words(data, offsets, ALNUM)
        hashes = hash_spans(FOLD[data], starts, ends).view(np.int64)
        bounds = row_bounds(rows, len(column))
        for i, (base, text, terms, strength) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)))):
            own = read_spans(base)
            added = []
            if terms:
                a, b = bounds[i], bounds[i + 1]
                level = dict(zip(terms, strength))
                hit = np.flatnonzero(np.isin(hashes[a:b], np.array(terms, np.int64)))
                points = np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)
                for k in (a + hit).tolist():
                    s, e = starts[k] - offsets[i], ends[k] - offsets[i]
                    first, last = int(points[s]) - 1, int(points[e - 1])
                    if not any(first < y and x < last for x, y, _ in own):
                        added.append((first, last, "removed" if level[int(hashes[k])] >= remove else "general"))
            every = sorted([*own, *added], key=lambda s: (s[0], (*KINDS, "general", "removed").index(s[2])))
            out["base"].append(base)
            out["spans"].append(written(every))
            out["sanitised"].append(replaced(text, every) if every else None)
        columns = {k: pa.array(v, pa.string()) for k, v in out.items()}
        return {"doc_id": batch.column(0), **columns}

    columns = ["doc_id", "base", "text", "terms", "strength"]
    with_entity = scanned.where(F.size("entities") > 0).join(by_text, "digest", "left").select(*columns)
    without = scanned.where(F.size("entities") == 0).select(
        "doc_id", "base", "text", F.lit(None).cast("array<bigint>").alias("terms"), F.lit(None).cast("array<double>").alias("strength")
    )
    rows = with_entity.unionByName(without)
    return map_slices(rows, run, PRIVATE)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with pattern spans as their kind, general terms as their shape and removed ones left out."""
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        out.append("" if kind == "removed" else shape(text[a:b]) if kind == "general" else f"[{kind.upper()}]")
        at = b
    return "".join([*out, text[at:]])


def private_digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    counts = [F.coalesce(F.regexp_count("base", F.lit(f"(^|,){k}:")), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", F.sha2("sanitised", 256).alias("sanitised_sha256"))
