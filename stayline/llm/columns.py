"""Carrying a caller's columns through a plan under names that cannot clash with an operator's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`").alias(f"given_{i}") for i, n in enumerate(names)]


def restored(names: Sequence[str]) -> list[Column]:
    return [F.col(f"given_{i}").alias(n) for i, n in enumerate(names)]
