import random

import numpy as np
import pyarrow as pa
import pytest

from stayline.llm import counts, packing, tokenfile, tokens
from tests.llm.helpers import empty, odd_documents, prose, rows_of, table

PATH = tokens.public_path("byte_bpe_50k.json")
MODEL = tokens.public_path("piece_bpe_32k.model")
ODD = " \n\t\x0b\x1c\x1d\x85   ​ab1'.é漢　あ丁𝒜<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return tokens.load_tokenizer(PATH)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_slices_have_the_ids_of_the_library(library):
    rng = random.Random(1)
    texts = [prose(i, 60) for i in range(20)] + ["".join(rng.choice(ODD) for _ in range(50)) for _ in range(3000)]
    texts += ["", "  ", "a <|endoftext|> b", "x<|endoftext|>y<|endoftext|>", "don't  'll\n\n\tq "]
    for a in range(0, len(texts), 400):
        ids, n = tokens.encoder(PATH).slice(pa.array(texts[a : a + 400]))
        ends = np.cumsum(n)
        for text, lo, hi in zip(texts[a : a + 400], ends - n, ends):
            assert ids[lo:hi].tolist() == library_ids(library, text)


def test_store_that_starts_again_gives_the_same_ids(monkeypatch, library):
    monkeypatch.setattr(tokens, "STORE_SEGMENTS", 10)
    fresh = tokens.Encoder(PATH)
    for i in range(5):
        text = prose(i, 80)
        assert fresh.slice(pa.array([text, "", text]))[0].tolist() == 2 * library_ids(library, text)


def test_other_vocabularies_go_through_the_library():
    path = tokens.public_path("word_bpe_49k.json")
    other = tokens.Encoder(path)
    assert other.fast is None
    ids, n = other.slice(pa.array(["Some words", None, "more"]))
    whole = tokens.load_tokenizer(path)
    assert ids.tolist() == sum((whole.encode(t, add_special_tokens=False).ids for t in ("Some words", "", "more")), [])
    assert n[1] == 0


@pytest.mark.parametrize("path", [PATH, MODEL])
def test_spliced_counts_equal_whole_counts(path):
    model = path == MODEL
    starts = counts._model_starts(path) if model else counts._json_starts(path)
    rng = random.Random(2)
    texts = [prose(i, 300) for i in range(4)] + ["y" * 900, "a b" * 300, " " * 700 + "x"]
    texts += ["".join(rng.choice("ab  \n1'é") for _ in range(700)) for _ in range(40)]
    for text in texts:
        for chunk, overlap in ((64, 8), (200, 20)):
            n, chunks, _ = counts.spliced_count(text, starts, chunk, overlap, " " if model else " \n")
            assert n == len(starts(text)) and chunks > 1


def test_overlaps_are_widened_where_nothing_aligns():
    starts = counts._json_starts(PATH)
    text = "word " * 30 + "z" * 500 + " word" * 30
    n, _, widened = counts.spliced_count(text, starts, 100, 10)
    assert n == len(starts(text)) and widened > 0


def test_model_has_no_pieces_across_words():
    assert not counts.crosses_words(MODEL)


def test_token_counts_of_odd_documents(spark, library):
    got = rows_of(counts.token_counts(table(spark, clashing=("n_tokens", "n_bytes")), PATH, chunk=5000, overlap=100), "doc_id", "n_bytes", "n_tokens")
    want = [(d, len((t or "").encode()), len(library_ids(library, t))) for d, t, *_ in odd_documents()]
    assert got == sorted(want, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
    assert counts.token_counts(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files_round_trip(spark, library, tmp_path, encoding):
    import pyarrow.parquet as pq

    out = str(tmp_path / encoding)
    layout = tokenfile.Layout(encoding=encoding, row_group_bytes=1 << 20, page_bytes=1 << 12)
    tokenfile.write_tokens(table(spark, clashing=("tokens", "start")), PATH, out, layout)
    got = tokenfile.read_tokens(spark, out).orderBy("start").collect()
    at = 0
    for row, (doc, text, *_) in zip(got, sorted(odd_documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
        assert (row["doc_id"], row["start"], row["tokens"]) == (doc, at, [*library_ids(library, text), 0])
        at += row["n_tokens"]
    assert len(got) == len(odd_documents())
    files = sorted((tmp_path / encoding).glob("*.parquet"))
    column = pq.ParquetFile(files[-1]).metadata.row_group(0).column(5)
    assert column.path_in_schema == "tokens.list.element"
    assert column.has_offset_index and column.has_column_index
    assert ("RLE_DICTIONARY" in column.encodings or "PLAIN_DICTIONARY" in column.encodings) == (encoding == "dictionary")
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


def test_token_files_are_read_selectively(spark, tmp_path):
    out = str(tmp_path / "some")
    tokenfile.write_tokens(table(spark), PATH, out)
    some = tokenfile.read_tokens(spark, out, ("doc_id", "n_tokens"), low=7, high=9)
    assert sorted(r["doc_id"] for r in some.collect()) == [7, 8, 9]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,7)" in plan
    assert "tokens:array" not in plan.split("ReadSchema")[1].replace("n_tokens", "")
    digests = tokenfile.token_digests(tokenfile.read_tokens(spark, out, low=7))
    assert digests.count() == 7
    with pytest.raises(ValueError):
        tokenfile.Layout(encoding="plain").options()


def test_empty_table_gives_empty_files(spark, tmp_path):
    out = str(tmp_path / "none")
    tokenfile.write_tokens(empty(spark), PATH, out)
    assert tokenfile.read_tokens(spark, out).count() == 0


def check_plan(count, capacity=2048):
    plan = packing.plan_packing(count, capacity)
    filled, seen = np.zeros(plan.sequences, np.int64), {}
    for length, rank, n, first, offset in zip(plan.length, plan.rank, plan.pieces, plan.sequence, plan.offset):
        assert seen.get(length, 0) == rank
        seen[length] = rank + n
        assert (filled[first : first + n] == offset).all()
        filled[first : first + n] += length
    assert all(seen.get(length, 0) == c for length, c in enumerate(count.tolist()))
    assert (filled <= capacity).all() and (filled > 0).all()
    return plan


def test_plans_are_whole_and_near_the_lower_bound():
    rng = np.random.default_rng(1)
    for lengths, slack in (
        (rng.integers(1, 2048, 5000), 1.01),
        (rng.integers(300, 1500, 20000), 1.02),
        (np.array([2048, 2048, 1, 1]), 2.0),
        (np.full(777, 1024), 1.01),
        (np.array([1000]), 3.0),
    ):
        plan = check_plan(np.bincount(lengths, minlength=2049))
        assert plan.sequences <= slack * -(-int(lengths.sum()) // 2048)
    assert check_plan(np.zeros(2049, np.int64)).sequences == 0


def test_configurations_beat_plain_best_fit_where_it_fails():
    """Lengths just above a third and just below: best fit decreasing pairs them badly."""
    rng = np.random.default_rng(3)
    count = np.bincount(rng.integers(600, 1100, 50000), minlength=2049)
    plain = packing._Packer(count, 2048)
    for length in range(2048, 0, -1):
        plain.best_fit(length)
    assert check_plan(count).sequences < plain.plan.sequences


def test_packing_of_odd_documents(spark, library):
    import zlib

    got = packing.pack(table(spark, clashing=("block", "length", "sequence_id")), PATH, capacity=256).collect()
    want = []
    for doc, text, *_ in odd_documents():
        ids = np.array([*library_ids(library, text), 0], "<u4")
        head = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(head, len(ids) + 1, 256)]
        want += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: [(v is not None, v or 0) for v in r]
    assert sorted(((*r[:5],) for r in got), key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty(spark), PATH).count() == 0
