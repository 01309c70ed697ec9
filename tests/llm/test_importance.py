import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from stayline.llm import importance
from stayline.llm.importance import Resample
from tests.llm.helpers import empty, odd_documents, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def features_of(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def by_hand(docs, target, how):
    """(doc_id, n_features, weight, score, rank) by words, dictionaries and one sort."""

    def bucket(f):
        return crc32(f.encode()) % how.buckets

    source = Counter(bucket(f) for _, t in docs for f in features_of(t, how.longest)[0])
    aim = Counter(bucket(f) for t in target for f in features_of(t, how.longest)[0])
    s_all, t_all = sum(source.values()), sum(aim.values())
    rows = []
    for i, (doc, text) in enumerate(docs):
        found, n_words = features_of(text, how.longest)
        gain = [math.floor(1000 * math.log((aim[bucket(f)] + 1) * (s_all + how.buckets) / ((source[bucket(f)] + 1) * (t_all + how.buckets)))) for f in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(found), weight, score, None, n_words])
    drawable = sorted((r for r in rows if r[5] >= how.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawable[: how.share * len(drawable) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(spark, df, target, how=Resample()):
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = importance.resample(df, aim, how).select("doc_id", "n_features", "weight", "score", "rank")
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    return sorted((tuple(r) for r in got.collect()), key=repr)


ODD = ["", "a", " a  B\tc ", "x-y_z.1 2", "É é ß İ", "one\x00two", "日本 語", "A.B", "--", "a" * 5000]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_spans_are_all_runs_of_words(longest):
    patterns = [importance.run_pattern(n) for n in range(1, longest + 1)]
    for text in [*ODD, prose(1, 300)]:
        want, n_words = features_of(text, longest)
        got, words = importance.feature_buckets(text.encode(), patterns, 997)
        assert got.tolist() == [crc32(f.encode()) % 997 for f in want] and words == n_words


@pytest.mark.parametrize("how", [Resample(), Resample(longest=3, buckets=70_000, min_words=5, share=60, seed=3)])
def test_against_plain_python(spark, how):
    rng = random.Random(2)
    rows = [(i, prose(rng.randrange(40), rng.randrange(60)), "en", "src1") for i in range(300)]
    target = [prose(i, 80) for i in range(6)]
    got = run(spark, table(spark, rows).repartition(5), target, how)
    assert got == by_hand([r[:2] for r in rows], target, how)
    assert sum(r[4] is not None for r in got) > 20


def test_odd_documents(spark):
    df = table(spark, clashing=("features", "score", "rank", "n_words", "_by"))
    docs = [(d, t) for d, t, *_ in odd_documents()] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = df.select("doc_id", "text", "score").unionByName(spark.createDataFrame(docs[16:], "doc_id bigint, text string").withColumn("score", F.lit("x")))
    how = Resample(share=100)
    assert run(spark, df, [prose(3, 50), None, ""], how) == by_hand(docs, [prose(3, 50), None, ""], how)


def test_ties_go_to_the_smaller_number(spark):
    """Repeated rows have equal scores, also at the cutoff; each drawn row has a rank of its own."""
    rows = [(i % 7, prose(1, 30), "en", "src1") for i in range(70)]
    got = run(spark, table(spark, rows).repartition(6), [prose(2, 30)])
    assert got == by_hand([r[:2] for r in rows], [prose(2, 30)], Resample())
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 18))


def test_empty_tables(spark):
    assert run(spark, empty(spark), [prose(1, 30)]) == []
    docs = [(1, prose(1, 30)), (2, None)]
    assert run(spark, table(spark, [(d, t, "en", "s") for d, t in docs]), []) == by_hand(docs, [], Resample())


def test_documents_like_the_target_are_drawn(spark):
    like = {i for i in range(200) if i % 4 == 0}
    rows = [(i, "zebra quagga okapi " * 20 if i in like else prose(i, 60), "en", "src1") for i in range(200)]
    got = run(spark, table(spark, rows), ["zebra quagga okapi " * 5000], Resample(share=20))
    assert min(r[2] for r in got if r[0] in like) > max(r[2] for r in got if r[0] not in like)
    drawn = {r[0] for r in got if r[4]}
    assert len(drawn) == 40 and 3 * len(drawn & like) > 2 * len(drawn)
