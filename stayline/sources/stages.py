"""Stored intermediate tables, found again by what they were made from.

A stage is named by a digest of its input rows, its columns, its settings and
the source of this library, so a stage with that name is current by its name
alone: other input, other columns or other code give another name. The facts
of its origin lie beside the rows.

Rows and facts are written to folders of their own; a small file written once
names those that count. A driver that is lost leaves folders that nobody reads,
and of two drivers that build the same stage one is read by both.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stayline.sources import files
from stayline.sources.ledger import data_fingerprint
from stayline.sources.provenance import origin
from stayline.spec import CONFIG

DONE = "done"


@cache
def code_revision() -> str:
    """Digest of the library's source outside the operators of training data, which no stage uses."""
    base = Path(__file__).parent.parent
    total = hashlib.sha256()
    for path in sorted(p for p in base.rglob("*.py") if "llm" not in p.relative_to(base).parts):
        body = path.read_bytes()
        total.update(f"{path.relative_to(base)}:{len(body)}:".encode() + body)
    return total.hexdigest()[:16]


def stage_name(recipe: str, inputs: Mapping[str, str], columns: Sequence[str], settings: Mapping | None = None) -> str:
    """`inputs` are digests of rows by name; the order of columns counts."""
    made_from = {"inputs": dict(inputs), "columns": list(columns), "settings": dict(settings or {}), "code": code_revision()}
    return f"{recipe}-{hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()[:32]}"


def read_stage(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    if DONE not in files.names(spark, f"{root}/{name}"):
        return None
    which = files.get(spark, f"{root}/{name}/{DONE}")
    return spark.read.parquet(f"{root}/{name}/rows-{which}") if which else None


def read_origin(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(kind, name, value) facts of a finished stage."""
    return spark.read.parquet(f"{root}/{name}/origin-{files.get(spark, f'{root}/{name}/{DONE}')}")


def stage(
    spark: SparkSession,
    root: str,
    recipe: str,
    inputs: Mapping[str, DataFrame],
    columns: Sequence[str],
    build: Callable[[], DataFrame],
    settings: Mapping | None = None,
    seed: int = CONFIG.seed,
) -> DataFrame:
    """The stored rows of `build()`, built at most once for these inputs, columns, settings and code.

    `columns` names what the stage must hold, in order; anything else is an error.
    """
    digests = {name: data_fingerprint(rows, rows.columns) for name, rows in inputs.items()}
    name = stage_name(recipe, digests, columns, settings)
    found = read_stage(spark, root, name)
    if found is not None:
        return found
    rows, which = build(), uuid.uuid4().hex
    if rows.columns != list(columns):
        raise ValueError(f"the stage {recipe} has columns {rows.columns}, not {list(columns)}")
    rows.write.option("compression", "zstd").parquet(f"{root}/{name}/rows-{which}")
    known = spark.createDataFrame([*digests.items()], "site string, digest string")
    facts = origin(spark, known, seed).unionByName(
        spark.createDataFrame([("stage", "code", code_revision())], "kind string, name string, value string")
    )
    facts.coalesce(1).write.parquet(f"{root}/{name}/origin-{which}")
    if not files.put_once(spark, f"{root}/{name}/{DONE}", which):
        for kind in ("rows", "origin"):
            files.remove(spark, f"{root}/{name}/{kind}-{which}")
    return read_stage(spark, root, name)


def release(spark: SparkSession, root: str, older_than_days: float, keep: Sequence[str] = ()) -> list[str]:
    """Remove stages (unfinished ones too) that are older, but for those named in `keep`; returns their names."""
    gone = []
    for name in files.names(spark, root):
        at = f"{root}/{name}"
        if name not in keep and files.age_seconds(spark, at) >= older_than_days * 86400:
            files.remove(spark, at)
            gone.append(name)
    return gone
