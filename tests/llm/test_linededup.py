import random

import numpy as np
import pyarrow as pa

from stayline.llm import linededup
from tests.llm.helpers import empty, odd_documents, prose, table


def by_hand(docs, min_chars=20, min_documents=3):
    """Kept text of each row; rows of one doc_id are one document."""
    fold = str.maketrans(linededup.UPPER, linededup.LOWER)

    def key(line):
        return line.strip(linededup.SPACES).translate(fold)

    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and text is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        kept = [
            line for line in (text or "").split("\n")
            if doc is None or len(holders.get(key(line), ())) < min_documents or max(holders[key(line)]) == doc
        ]
        out.append((doc, "\n".join(kept), len((text or "").split("\n")), len((text or "").split("\n")) - len(kept)))
    return sorted(out, key=lambda r: [(v is not None, v or 0) if not isinstance(v, str) else v for v in r])


def run(docs):
    got = linededup.apply_bitmaps(docs, linededup.line_bitmaps(docs)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    return sorted((tuple(r) for r in got), key=lambda r: [(v is not None, v or 0) if not isinstance(v, str) else v for v in r])


def test_odd_documents(spark):
    docs = table(spark, clashing=("tag", "place", "keep", "n_lines", "_dropped"))
    assert run(docs) == by_hand([(d, t) for d, t, *_ in odd_documents()])
    assert run(docs.drop("n_lines")) == by_hand([(d, t) for d, t, *_ in odd_documents()])


def test_hot_lines_over_many_tasks(spark):
    """One line in every document and random shared lines, with more ranges than keys."""
    rng = random.Random(4)
    shared = [prose(i, 6, 50) + f" shared line number {i}" for i in range(12)]
    rows = []
    for doc in range(300):
        own = [rng.choice(shared) for _ in range(rng.randrange(4))]
        rows.append((doc, "\n".join(["the same line in all of the documents", *own, f"only {doc} has this longer line"]), "en", "src1"))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert run(table(spark, rows).repartition(5)) == by_hand([r[:2] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_table(spark):
    assert run(empty(spark)) == []


def stream(rows, cuts, batch):
    """Run the stream over tasks cut at `cuts` (never within a document of a key) and close the open lines."""
    marks = []
    edges = [0, *cuts, len(rows)]
    for a, b in zip(edges, edges[1:]):
        part = rows[a:b]
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[i] for r in part[k : k + batch]], pa.int64()) for i in range(4)], names=["h1", "h2", "doc_id", "place"])
            for k in range(0, len(part), batch)
        ]
        for out in linededup.stream(iter(batches), 3):
            marks += list(zip(*(out.column(i).to_pylist() for i in range(6))))
    dropped = {(m[3], m[4]) for m in marks if m[0] == "drop"}
    sums = {}
    for m in marks:
        if m[0] == "summary":
            n, first = sums.get(m[1:3], (0, -1))
            sums[m[1:3]] = (n + m[5], max(first, m[3]))
    for m in marks:
        if m[0] == "open" and sums[m[1:3]][0] >= 3 and m[3] != sums[m[1:3]][1]:
            dropped.add((m[3], m[4]))
    return dropped


def test_stream_does_not_depend_on_tasks_and_batches():
    rng = random.Random(5)
    for _ in range(150):
        found = {(rng.randrange(4), 0, rng.randrange(6), rng.randrange(5)) for _ in range(rng.randrange(1, 40))}
        rows = sorted(found, key=lambda r: (r[0], r[1], -r[2], r[3]))
        want = set()
        for h in {r[0] for r in rows}:
            docs = {r[2] for r in rows if r[0] == h}
            if len(docs) >= 3:
                want |= {(r[2], h * 100 + r[3]) for r in rows if r[0] == h and r[2] != max(docs)}
        legal = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]]
        cuts = sorted(rng.sample(legal, min(len(legal), rng.randrange(4))))
        tagged = [(h, 0, d, h * 100 + p) for h, _, d, p in rows]
        assert stream(tagged, cuts, rng.randrange(1, 7)) == want


def test_bitmaps():
    for drop in ([0], [7], [8], [0, 3, 31], list(range(40))):
        bits = linededup.keep_bitmap(np.array(drop))
        text = "\n".join(map(str, range(50)))
        assert linededup.kept_lines(text, bits).split("\n") == [str(i) for i in range(50) if i not in drop]
