import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stayline.llm import neardup, weighted
from stayline.llm.components import components
from tests.llm.helpers import WORDS, empty, odd_documents, prose, table


def words(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (text or "").translate(fold).split()


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def by_hand(docs, threshold=0.8, common=0.01, floor=0.8):
    """Row -> set of row numbers in its class, from exact weighted similarities of all pairs."""
    bags = [bag(t) for _, t, *_ in docs]
    df = Counter(s for b in bags for s in b)
    least = max(2, int(np.ceil(common * len(docs))))

    def idf(s):
        if df[s] < least:
            return 1.0
        return floor + (1 - floor) * min(1, max(0, np.log(len(docs) / df[s]) / np.log(1 / common)))

    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    margins = []
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            low = sum(idf(s) * min(n, b[s]) for s, n in a.items() if s in b)
            high = sum(idf(s) * n for s, n in a.items()) + sum(idf(s) * n for s, n in b.items()) - low
            margins.append(abs(low / high - threshold))
            if low / high >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert min(margins) > 1e-9
    return [root(i) for i in range(len(docs))]


def classes(docs, df, settings=neardup.Settings()):
    got = Counter(tuple(r) for r in neardup.near_duplicates(df, settings).collect())
    roots = by_hand(docs)
    named = {}
    for r, (doc, *_) in zip(roots, docs):
        if doc is not None:
            named[r] = min(doc, named.get(r, doc))
    sizes = Counter(roots)
    return got, Counter((doc, named.get(r), sizes[r]) for r, (doc, *_) in zip(roots, docs))


def edits(text, n, rng):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + rng.choice(WORDS) + "q"
    return " ".join(w)


def corpus():
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = prose(family, 220, 220)
        rows += [edits(base, rng.choice([0, 1, 2, 3, 9]), rng) for _ in range(rng.randrange(1, 9))]
    rows += ["repeat after me " * 40, "repeat after me " * 43, "repeat after me " * 80]
    rng.shuffle(rows)
    return [(i, t, "en", "src1") for i, t in enumerate(rows)]


def test_shingles_against_plain_counters():
    texts = [t or "" for _, t, *_ in odd_documents()[:12]] + ["a b c d e a b c d e a b", "A", "a", "a b c d", "b a c d"]
    got = weighted.bags(pa.array(texts))
    for text, (hashes, times) in zip(texts, got):
        assert sorted(times.tolist()) == sorted(bag(text).values())
        assert len(set(hashes.tolist())) == len(hashes)
    marks = [weighted.digest(b) for b in got]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (marks[i] == marks[j]) == (bag(a) == bag(b))


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.choice([1.0, 1.0, 0.85, 2.0, 3.0], 400), rng.choice([1.0, 1.0, 0.85, 2.0], 400)
    b[:40] = 0
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sampler = weighted.Sampler(20_000)
    agree = (sampler(hashes, a) == sampler(hashes[b > 0], b[b > 0])).mean()
    assert abs(agree - exact) < 4 * (exact * (1 - exact) / 20_000) ** 0.5
    order = rng.permutation(400)
    assert (sampler(hashes[order], a[order]) == sampler(hashes, a)).all()


def test_block_links_join_what_pairs_join():
    rng = np.random.default_rng(2)
    idf = weighted.Idf(np.zeros(0, np.uint64), np.zeros(0))
    for n in (2, 5, 9, 40):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = []
        for _ in range(n):
            own = base.copy()
            own[rng.random(60) < rng.choice([0.02, 0.1, 0.2])] += np.uint64(1)
            h, t = np.unique(own, return_counts=True)
            sets.append(weighted.expanded(h, t + (rng.random(len(h)) < 0.1), idf))
        links = neardup.block_links(sets, [None] * n, None, 0.8)
        parent = list(range(n))

        def root(i):
            return i if parent[i] == i else root(parent[i])

        for i in range(n):
            for j in range(i):
                if weighted.similarity(sets[i], sets[j]) >= 0.8:
                    parent[root(i)] = root(j)
        of_links = list(range(n))
        for i, j in links:
            assert weighted.similarity(sets[i], sets[j]) >= 0.8
            a, b = of_links[i], of_links[j]
            of_links = [a if x == b else x for x in of_links]
        assert len(links) == n - len({root(i) for i in range(n)}) == n - len(set(of_links))


def test_classes_against_all_pairs(spark):
    rows = corpus()
    got, want = classes(rows, table(spark, rows).repartition(3))
    assert got == want and max(n for _, _, n in want) > 3


def test_keys_of_many_blocks(spark):
    """Blocks of two members: links between blocks have to come from the second comparison."""
    rows = corpus()
    got, want = classes(rows, table(spark, rows), neardup.Settings(block_members=2, block_shingles=500))
    assert got == want


def test_common_shingles_weigh_less(spark):
    rows = [(i, prose(i, 30, 30) + " " + prose(999, 60, 60), "en", "src1") for i in range(40)]
    idf = neardup.document_frequencies(table(spark, rows), neardup.Settings())
    shared = weighted.bags(pa.array([prose(999, 60, 60)]))[0][0]
    assert np.allclose(idf(shared), 0.8) and np.allclose(idf(np.arange(5, dtype=np.uint64)), 1)


def test_odd_documents(spark):
    docs = odd_documents()
    df = table(spark, clashing=("node", "label", "digest", "class_id", "_hash", "_id"))
    got, want = classes(docs, df)
    assert got == want
    kept = neardup.keep_one(df).collect()
    assert set(kept[0].asDict()) == set(df.columns)
    roots = by_hand(docs)
    assert len(kept) == len(set(roots))
    for r in set(roots):
        ids = [d[0] for d, x in zip(docs, roots) if x == r]
        best = min((i for i in ids if i is not None), default=None)
        assert any(k["doc_id"] == best for k in kept)


def test_empty_table(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.keep_one(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(bytes([i]), bytes([i + 1])) for i in range(40) if i != 20]
    pairs += [(bytes([100]), bytes([rng.randrange(101, 140)])) for _ in range(30)] + [(bytes([7]), bytes([7]))]
    got = {r["node"][0]: r["label"][0] for r in components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert all(got[i] == (0 if i <= 20 else 21) for i in range(41))
    assert all(v == 100 for k, v in got.items() if k >= 100)


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_documents_that_share_a_passage_stay_apart(spark, name):
    rows = [(i, prose(i, 60, 60) + " " + prose(999, 50, 50), "en", "src1") for i in range(30)]
    got = neardup.near_duplicates(table(spark, rows).withColumnRenamed("n_chars", f"{name}_n")).collect()
    assert len({r["class_id"] for r in got}) == 30
