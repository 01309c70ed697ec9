import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stayline.llm import quality, tokens
from tests.llm.helpers import empty, odd_documents, prose, table

MODEL = tokens.public_path("piece_bpe_32k.model")


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    return len({i + k for i, w in enumerate(windows) if w in again for k in range(3)})


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text),
        sum(line in lines[:i] for i, line in enumerate(lines)), plain_repeats(words),
    )


TEXTS = [
    "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "one two three\none two three\n\nOne\x0btwo",
    "# a | b <c> & 100% $ *", "\x1c\x85 not space", prose(1, 60) + "\n" + prose(1, 60),
]


def test_base_features_against_plain_python():
    for text in TEXTS:
        assert quality.base_features(text) == plain_base(text), text


def test_many_distinct_words_do_not_overflow():
    words = [str(i) for i in range(30)] * 2
    big = quality.repeated_words(words)
    assert big == 60 == plain_repeats(words)


def test_fertility_against_the_library():
    model = tokens.piece_words(MODEL).model
    texts = [*TEXTS, "漢字 かな", "𝒜𝒜 \U0010ffff"]
    n, n_bytes, entropy = quality.fertility(pa.array(texts), MODEL)
    for text, got_n, got_bytes, got_entropy in zip(texts, n, n_bytes, entropy):
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in model.encode(w)]
        assert got_n == len(ids) and got_bytes == sum(model.is_byte(i) for i in ids)
        if len(ids) > 1:
            share = np.unique(ids, return_counts=True)[1] / len(ids)
            assert abs(got_entropy - max(0, -(share * np.log2(share)).sum() / np.log2(len(ids)))) < 1e-9
        else:
            assert got_entropy == 1


def test_scripts():
    from stayline.llm.words import buffer_of

    got = quality.scripts(*buffer_of(pa.array(["abc é", "привет", "漢字漢", "", "12 3", "한국", "שלום"])))
    assert got == ["latin", "cyrillic", "han", "none", "none", "hangul", "hebrew"]
    assert quality.scripts(*buffer_of(pa.array([], pa.string()))) == []


def test_bands_are_wider_for_short_texts():
    band = quality.Band((2.0, 3.0), 0.1, (0.5, 0.9), slack=1.0)
    assert quality.in_band(band, 10_000, 2.5, 0.0, 0.7) and not quality.in_band(band, 10_000, 1.9, 0.0, 0.7)
    assert quality.in_band(band, 25, 1.9, 0.0, 0.7)
    assert not quality.in_band(band, 10_000, 2.5, 0.2, 0.7) and not quality.in_band(band, 10_000, 2.5, 0.0, 0.95)


def test_odd_documents(spark):
    docs = table(spark, clashing=("kept", "script", "given_0"))
    got = quality.quality(docs, MODEL, passed=("kept", "n_chars")).collect()
    assert len(got) == len(odd_documents())
    assert {r["given_0"] for r in got} == {"given"}
    by_base = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    assert by_base == sorted(quality.base_features(t or "") for _, t, *_ in odd_documents())
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert quality.quality(empty(spark), MODEL).count() == 0


def test_labelled_prose_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality(docs, MODEL).join(labels, "doc_id").where("NOT base_failed")
    rows = judged.select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.7 * len(bad)


def test_long_clean_prose_is_kept(spark):
    """Distinct good texts one after the other: the verdict does not depend on the number of tokens."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    texts = [r["text"] for r in rows.where("lang = 'en' AND quality = 1").select("text").distinct().orderBy(F.md5("text")).collect()]
    per_char = quality.fertility(pa.array(["\n".join(texts)]), MODEL)[0][0] / sum(map(len, texts))
    docs = []
    for k, n in enumerate((50_000, 1_000_000)):
        part, held = [], 0
        for text in texts:
            if held * per_char < 1.05 * n:
                part.append(text)
                held += len(text)
        docs.append((k, "\n".join(part), "en", "src1"))
    got = sorted(quality.quality(table(spark, docs), MODEL).collect())
    tokens_of = [r["word_chars"] / r["chars_per_token"] for r in got]
    assert tokens_of[0] > 50_000 and tokens_of[1] > 1_000_000, tokens_of
    assert all(r["kept"] for r in got), got
    assert abs(got[0]["entropy"] - got[1]["entropy"]) < 0.02


def test_windows_cover_the_whole_text():
    clean, same = np.arange(quality.WINDOW), np.zeros(quality.WINDOW, np.int64)
    assert quality.window_entropy(np.concatenate([clean, same, same])) == 1 / 3
    assert abs(quality.window_entropy(np.concatenate([same, np.arange(512)])) - 512 / (quality.WINDOW + 512)) < 1e-12
