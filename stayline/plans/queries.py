"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

from stayline.plans.registry import ORACLE, QUERIES

FAMILIES = ("q_cohort", "q_features", "q_profile", "q_models", "q_metrics", "q_compare", "q_serving")
for _family in FAMILIES:
    importlib.import_module(f"stayline.plans.{_family}")

__all__ = ["ORACLE", "QUERIES"]
