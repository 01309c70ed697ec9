"""Small tables with the odd cases that every operator has to take."""

import random

from pyspark.sql import functions as F

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "Ner", "so") for b in ("ta", "ru", "né", "x") for c in ("", "s", "ing", "ed")]


def prose(seed, n, per_line=9):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) + "." for i in range(0, n, per_line))


def odd_documents():
    """(doc_id, text, lang, source): nulls, empty, white space, very long, repeated rows, equal and near texts."""
    base = prose(1, 200)
    return [
        (1, base, "en", "src1"),
        (1, base, "en", "src1"),
        (2, base, "en", "src2"),
        (3, base.replace("kata", "zzzz", 1), "en", "src12"),
        (4, None, "en", "src1"),
        (5, "", None, "src1"),
        (6, " \n\t \n", "de", None),
        (7, "two words", "xx", "src3"),
        (None, prose(2, 120), "fr", "src4"),
        (None, None, None, None),
        (8, prose(3, 40_000), "en", "src1"),
        (9, "y" * 30_000, "en", "src15"),
        (10, prose(4, 90) + "\nA line that three documents hold together\nown 10", "es", "src10"),
        (11, prose(5, 90) + "\n  a LINE that three documents hold together \t\nown 11", "es", "src10"),
        (12, prose(6, 90) + "\na line that three documents hold together\na line that three documents hold together", "es", "src10"),
        (12, "another text with the same number, long enough to count", "es", "src10"),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string"


def table(spark, rows=None, clashing=()):
    """A documents table; `clashing` adds columns with names operators use themselves."""
    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
    df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    for name in clashing:
        df = df.withColumn(name, F.lit("given"))
    return df


def empty(spark):
    return table(spark, [])


def rows_of(df, *columns):
    got = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
