"""Sources and sinks beside plain tables: evaluation cases, parse results, binary files, chunk versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = "struct<block_number:int,bbox:array<double>,text:string,source:string,confidence:double,classification:string,table_number:int>"
TABLE = "struct<table_number:int,page_number:int,bbox:array<double>,rows:array<array<string>>,header:struct<names:array<string>,external:boolean>,row_count:int,column_count:int,source:string>"
OCR = "struct<engine:string,regions:int,blocks:int,tables:int,mean_confidence:double,dropped_lines:int>"
PAGE = f"struct<page_number:int,width:double,height:double,page_type:string,page_type_reason:string,image_coverage:double,text:string,method:string,character_count:int,ocr:{OCR},tables:array<{TABLE}>,text_blocks:array<{BLOCK}>,warnings:array<string>>"
PARSED = f"document_id string, document_name string, document_version int, parser string, pages array<{PAGE}>"


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, category, question, expect_any of a JSON file of cases."""
    schema = "description string, cases array<struct<id:string,category:string,question:string,expect_any:array<array<string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("cases").alias("c"))
    return rows.select(F.col("c.id").alias("case_id"), "c.category", "c.question", "c.expect_any")


def parse_results(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON file each (A15); a file that is no JSON gives a row of nulls, and
    fields that older files lack are null."""
    return spark.read.schema(PARSED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def flat_pages(parsed: DataFrame) -> DataFrame:
    return parsed.select("document_id", F.col("document_version").alias("version"), F.explode("pages").alias("p")).select("document_id", "version", "p.*")


def flat_blocks(parsed: DataFrame) -> DataFrame:
    rows = flat_pages(parsed).select("document_id", "version", "page_number", F.explode("text_blocks").alias("b"))
    box = [F.col("b.bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("document_id", "version", "page_number", "b.block_number", *box, "b.text", "b.classification")


def flat_tables(parsed: DataFrame) -> DataFrame:
    rows = flat_pages(parsed).select("document_id", "version", "page_number", F.explode("tables").alias("t"))
    box = [F.col("t.bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("document_id", "version", "page_number", "t.table_number", *box, "t.rows", "t.header")


def files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, length, content, checksum of the files of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return rows.withColumn("checksum", F.sha2("content", 256))


def with_columns(df: DataFrame, wanted: str) -> DataFrame:
    """``df`` with those columns of a DDL schema that it lacks, as nulls (A5)."""
    have = {c.lower() for c in df.columns}
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromDDL(wanted) if f.name.lower() not in have}
    return df.withColumns(lacking)


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the stored chunks of one version of one document (B1). Refuses an empty set, repeated ids
    and several versions. The partition is replaced whole when the job commits."""
    one = F.countDistinct(F.struct("document_id", "document_version"))
    found = chunks.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), one.alias("versions")).first()
    if not found["n"]:
        raise ValueError("no chunks to save")
    if found["n"] != found["ids"]:
        raise ValueError("chunk ids repeat")
    if found["versions"] != 1:
        raise ValueError("chunks of several document versions")
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id", "document_version").parquet(path)


def save_parse_results(parsed: DataFrame, path: str) -> None:
    """One folder of JSON per document_id (B9); those of the documents in ``parsed`` are replaced whole
    when the job commits, others stay."""
    rows = parsed.withColumn("document", F.col("document_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("document").json(path)
