"""Semantic result cache: nearest stored queries, with scope and freshness rules (M1-M4).

A stored query: cache_id, vector, timeframe, locations, indicators, is_historical, created_at (epoch
seconds, of the parameters if present), response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .angular import angular_join
from .retrieval import small

THRESHOLD, TOP, TTL = 0.90, 3, 86_400


def expired(now: Column) -> Column:
    """Entries that aren't historical expire after a day."""
    return ~F.col("is_historical") & (now - F.col("created_at") > TTL)


def same_scope() -> Column:
    """Equal sets of locations, all wanted indicators stored, the same timeframe."""
    return (
        (F.size(F.array_except("q_locations", "locations")) == 0)
        & (F.size(F.array_except("locations", "q_locations")) == 0)
        & (F.size(F.array_except("q_indicators", "indicators")) == 0)
        & F.col("q_timeframe").eqNullSafe(F.col("timeframe"))
    )


def candidates(stored: DataFrame, queries: DataFrame, scoped: bool) -> DataFrame:
    """The three nearest stored queries at or above the threshold (A19, F5). A given timeframe
    restricts the stored queries before the three are chosen (M2)."""
    none = F.lit(None).cast("string")
    asked = queries.select("query_id", *(["q_timeframe", "q_locations", "q_indicators"] if scoped else []))
    near = angular_join(
        stored.select(F.col("cache_id").alias("id"), "vector", F.col("timeframe").alias("scope")),
        queries.select("query_id", "vector", (F.col("q_timeframe") if scoped else none).alias("scope")),
        THRESHOLD,
        TOP,
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    hits = near.withColumn("rank", rank).where(F.col("rank") <= TOP).withColumnRenamed("id", "cache_id")
    return small(hits).join(stored, "cache_id").join(asked, "query_id")


def lookup(stored: DataFrame, queries: DataFrame, now: Column, scoped: bool = True) -> DataFrame:
    """(query_id, cache_id, score): the best of the three that is valid; validity is judged after the
    three are chosen, so a valid fourth is a miss."""
    found = candidates(stored, queries, scoped).where(~expired(now))
    if scoped:
        found = found.where(same_scope())
    return found.groupBy("query_id").agg(F.min_by("cache_id", "rank").alias("cache_id"), F.min_by("score", "rank").alias("score"))


def store(entries: DataFrame) -> DataFrame:
    """New entries with ids, times and the historical flag (B11); stores append, duplicates included."""
    historical = F.col("timeframe").isNotNull() & (F.lower("timeframe") != "latest")
    return entries.withColumn("cache_id", F.expr("uuid()")).withColumn("created_at", F.unix_timestamp().cast("double")).withColumn("is_historical", historical)
