import random

import pyarrow as pa
import pytest

from stayline.llm import pieces, tokens
from stayline.llm.queries import PIECE_VOCABULARY
from tests.llm.helpers import empty, odd_documents, prose, table

PARTS = [
    "a", "b", "the", "ing", " ", "  ", "\n", "▁", "é", "日本", "🙂", "\x00", "</s>", "<s>", "<0x0A>", "<unk>", "\t", "1", "2024", "ß", "م",
    "​", "xx", "yyyy", "Th", "er", "in", "-", "==", "\r\n", "　", "﻿", "한국", "", "▁▁",
]


@pytest.fixture(scope="module")
def path():
    return tokens.public_path(PIECE_VOCABULARY)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(n)]


def split(flat, counts):
    out, at = [], 0
    for c in counts.tolist():
        out.append(flat[at : at + c].tolist())
        at += c
    return out


def test_ids_are_those_of_the_library(path):
    model = pieces.PieceModel(path)
    texts = odd_texts(6000) + ["", " ", "y" * 40_000, "日本語" * 7000, " " * 20_000, "\n" * 500, prose(5, 3000), prose(6, 300).replace(" ", "")]
    got = split(*model.slice(pa.array([*texts, None])))
    assert got[:-1] == model.library.encode(texts, num_threads=1) and got[-1] == []


def test_without_cuts_the_walk_alone_is_exact(path):
    """One segment a text, so that backtracking has to cross space marks; and stretches shorter than the texts."""
    model = pieces.PieceModel(path)
    model.cuts = False
    texts = odd_texts(800, 2) + [prose(i, 40) for i in range(60)] + ["y" * 3000, prose(7, 4000)]
    assert split(*model.slice(pa.array(texts))) == model.library.encode(texts, num_threads=1)


def test_small_stretches_and_a_small_pair_table(path, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 20)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    model = pieces.PieceModel(path)
    texts = odd_texts(300, 3) + ["y" * 500, "z" * 19, "z" * 20, prose(8, 200)]
    assert split(*model.slice(pa.array(texts))) == model.library.encode(texts, num_threads=1)


def test_compatibility_is_merging_again(path):
    model = pieces.PieceModel(path)
    ids = model.library.encode("an unlikely segmentation of words")
    assert all(model.compatible(a, b) for a, b in zip([None, *ids], ids))
    a, b = model.piece_of["t"], model.piece_of["he"]
    assert not model.compatible(a, b) and model.merge("the") == ["the"]


def test_backtracking_happens(path):
    """Some longest matches have to be given up: the greedy choice alone is wrong for some words."""
    model = pieces.PieceModel(path)
    words = ["▁" + w for t in (prose(9, 3000), " ".join(odd_texts(500, 4))) for w in t.split()]
    found = list(model.segments(words))

    def greedy(text):
        out, at, longest = [], 0, model.matches(text)
        while at < len(text):
            token = longest[at] if longest[at] is not None else model._single(text[at])
            out.append(token)
            at += model.sizes[token] if token >= 0 else 1
        return out

    assert sum(greedy(w) != f for w, f in zip(words, found)) > 50


def test_odd_documents(spark, path):
    df = table(spark, clashing=("ids", "decoded", "n_tokens"))
    library = pieces.PieceModel(path).library
    want = sorted(((d, library.encode(t or "") + [library.eos_id()], library.decode(library.encode(t or ""))) for d, t, *_ in odd_documents()), key=repr)
    got = [(r["doc_id"], r["ids"], r["decoded"]) for r in pieces.encode(df, path, decoded=True).collect()]
    assert sorted(got, key=repr) == want
    back = pieces.decode(pieces.encode(df, path), path).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((d, t) for d, _, t in want), key=repr)
    assert all(i[-1:] != [library.eos_id()] for i in (r["ids"] for r in pieces.encode(df, path, end_id=False).collect()))


def test_empty_table_and_null_ids(spark, path):
    assert pieces.encode(empty(spark), path, decoded=True).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert sorted(tuple(r) for r in pieces.decode(rows, path).collect()) == [(1, ""), (2, "")]


def test_other_model_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3), ("▁a", 1), ("a", 1), ("▁", 1)):
        spec.pieces.add(piece=name, score=0.0, type=kind)
    spec.trainer_spec.model_type = 1
    file = tmp_path / "unigram.model"
    file.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(file))


@pytest.mark.parametrize("seed", range(12))
def test_invented_models(tmp_path, seed):
    """Small models of random pieces, with ties of scores, pieces that no merge reaches and pieces across words."""
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(seed)
    spec = sentencepiece_model_pb2.ModelProto()
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        spec.pieces.add(piece=name, score=0.0, type=kind)
    letters = "abc▁" if seed % 2 else "ab"
    many = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(25)}
    for name in [*letters, *sorted(many)]:
        spec.pieces.add(piece=name, score=-float(rng.randrange(12)), type=1)
    spec.trainer_spec.model_type = 2
    spec.normalizer_spec.name = "identity"
    spec.normalizer_spec.remove_extra_whitespaces = False
    file = tmp_path / "invented.model"
    file.write_bytes(spec.SerializeToString())
    model = pieces.PieceModel(str(file))
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(40))) for _ in range(300)]
    assert split(*model.slice(pa.array(texts))) == model.library.encode(texts, num_threads=1)
