"""Registered queries of the engine's operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import answers, layouts, plans, registry, retrieval, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (registry, texts, layouts, retrieval, answers, plans):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
