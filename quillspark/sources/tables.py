"""Readers of the test tables, and the engine's inputs (registry, chunks, blocks, questions) built
from them as SURVEY section 7.2 maps them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, filename, checksum, version, status, session_id: one row per document version."""
    version = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("filename"),
        F.sha2("text", 256).alias("checksum"),
        version.alias("version"),
        F.when(F.col("doc_id") % 7 == 0, "NEEDS_REVIEW").otherwise("CHUNKED").alias("status"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("s"), (F.col("doc_id") % 30).cast("string"))).alias("session_id"),
    )


REGISTRY_SQL = """registry AS (
    SELECT doc_id AS document_id, source AS filename, sha256(text) AS checksum,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version,
           CASE WHEN doc_id % 7 = 0 THEN 'NEEDS_REVIEW' ELSE 'CHUNKED' END AS status,
           CASE WHEN doc_id % 10 = 0 THEN 's' || CAST(doc_id % 30 AS VARCHAR) END AS session_id
    FROM documents)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, page_number, block_number, text and a box: the lines of each document, 20 a page."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    y = (F.col("pos") % 20) * 40.0
    return lines.select(
        "document_id",
        (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page_number"),
        (F.col("pos") + 1).cast("int").alias("block_number"),
        "text",
        F.lit(50.0).alias("x0"),
        y.alias("y0"),
        F.least(F.lit(550.0), 50.0 + F.length("text") * 5.0).alias("x1"),
        (y + 30.0).alias("y1"),
    )


BLOCKS_SQL = r"""lines AS (
    SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text,
           unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
blocks AS (
    SELECT document_id, CAST(pos // 20 + 1 AS INTEGER) AS page_number, CAST(pos + 1 AS INTEGER) AS block_number, text,
           50.0::DOUBLE AS x0, (pos % 20) * 40.0::DOUBLE AS y0,
           least(550.0::DOUBLE, 50.0::DOUBLE + length(text) * 5.0::DOUBLE) AS x1, (pos % 20) * 40.0::DOUBLE + 30.0::DOUBLE AS y1
    FROM lines)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, document_id: the documents that each session uses."""
    return registry(spark, sf_dir).where("session_id is not null").select("session_id", "document_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question: the whole texts of the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


QUESTIONS_SQL = "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)"
