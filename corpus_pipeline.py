"""A training-data pipeline over the documents table: each stage applies one operator of `stayline.llm`.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of documents; the last returns the packed pieces. Between stages the
rows are written as Parquet and read again, so a lost executor replays one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import linededup, mixing, neardup, packing, quality, tokens
from stayline.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY, documents, study_mix
from stayline.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the fertility band of their language or script."""
    names = docs.columns
    judged = quality.quality(docs, tokens.public_path(PIECE_VOCABULARY), passed=tuple(names))
    return judged.where("kept").select(*[F.col(f"given_{i}").alias(n) for i, n in enumerate(names)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them share, but for the last that has them."""
    kept = linededup.apply_bitmaps(docs, linededup.line_bitmaps(docs))
    return kept.select(*[F.length("text").cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else F.col(f"`{n}`") for n in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, by the weights of the study mix; a document is repeated for each epoch it is in."""
    chosen = mixing.select(docs, study_mix(share=(1, 1)))
    return chosen.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, tokens.public_path(BYTE_VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("source mix", mix_sources),
    ("best-fit packing", best_fit_packing),
]
#: Tokenisers, consistent sampling and the packing plan cannot be said in SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
