import hashlib

import corpus_pipeline as pipeline
import pytest

from stayline.llm import quality, tokens
from tests.llm import test_linededup, test_mixing, test_neardup
from tests.llm.helpers import odd_documents, prose, rows_of, table
from tests.llm.test_neardup import edits


def corpus():
    import random

    rng = random.Random(9)
    rows = odd_documents()
    for family in range(10):
        base = prose(family + 50, 150)
        for k in range(4):
            text = edits(base, rng.choice([0, 1, 8]), rng) + ("\nthis line is in a good many of the documents" if k else "")
            rows.append((len(rows) + 100, text, rng.choice(["en", "de", "xx"]), f"src{rng.randrange(14)}"))
    rows.append((900, "##| " * 300, "en", "src1"))
    return rows


@pytest.fixture(scope="module")
def judged_by_script():
    """Bands for the invented words of the tests."""
    kept = dict(quality.BANDS)
    quality.BANDS.clear()
    quality.BANDS.update({"latin": quality.Band((1.0, 9.0), 1.0, (0.2, 1.0)), "*": quality.Band((9.0, 9.0), 0.0, (0.9, 1.0))})
    yield
    quality.BANDS.clear()
    quality.BANDS.update(kept)


def test_stages_against_plain_python(spark, judged_by_script):
    docs = table(spark, corpus())
    plain = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near-duplicate removal", "source mix", "best-fit packing"]

    got = stages["quality rules"](spark, docs, "").cache()
    assert got.columns == docs.columns
    want = []
    for row in plain:
        n, _, _, _, repeat = quality.base_features(row[1] or "")
        if n >= 50 and 100 * repeat <= 50 * n:
            want.append(row)
    key = lambda r: [(v is not None, str(v)) for v in r]
    kept = sorted((tuple(r) for r in got.select("doc_id", "text", "lang", "source").collect()), key=key)
    assert set(kept) <= set(want) and len(kept) > 30
    assert {r[0] for r in want} - {r[0] for r in kept} <= {9, 900}

    lines = stages["line dedup"](spark, got, "").cache()
    assert lines.columns == docs.columns
    hand = test_linededup.by_hand([r[:2] for r in kept])
    assert sorted(rows_of(lines, "doc_id", "text"), key=key) == sorted(((d, t) for d, t, *_ in hand), key=key)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = stages["near-duplicate removal"](spark, lines, "").cache()
    assert near.columns == docs.columns
    before = [tuple(r) for r in lines.select("doc_id", "text", "lang", "source").collect()]
    roots = test_neardup.by_hand(before)
    after = [tuple(r) for r in near.select("doc_id", "text", "lang", "source").collect()]
    assert len(after) == len(set(roots)) and set(after) <= set(before)
    assert len({roots[before.index(r)] for r in after}) == len(after)

    mixed = stages["source mix"](spark, near, "").cache()
    assert mixed.columns == docs.columns
    mix = pipeline.study_mix(share=(1, 1))

    def leaf(d):
        domain = "unknown" if d[3] is None else "crawl" if len(d[3]) == 4 else "curated"
        return domain, d[2] or "unknown", d[3] or "unknown"

    want = [d for d, _, copies in test_mixing.by_hand(after, mix, leaf, test_mixing.words) for _ in range(copies)]
    assert sorted((r["doc_id"] for r in mixed.collect()), key=lambda v: (v is not None, v)) == sorted(want, key=lambda v: (v is not None, v))

    packed = stages["best-fit packing"](spark, mixed, "").collect()
    library = tokens.load_tokenizer(tokens.public_path(pipeline.BYTE_VOCABULARY))
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed) == total
    assert len({r["sequence_id"] for r in packed}) <= 1.2 * -(-total // 2048) + 1


def test_run_is_the_stages_over_documents(spark):
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    digest = hashlib.sha256(repr(rows_of(got, "doc_id", "piece", "length", "ids_crc32")).encode()).hexdigest()
    docs = pipeline.documents(spark, "/root/testdata/sf0.001")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert hashlib.sha256(repr(rows_of(docs, "doc_id", "piece", "length", "ids_crc32")).encode()).hexdigest() == digest
