"""A training-data pipeline over ``documents``: toxicity, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize
from quillspark.llm.decontaminate import drop_leaks
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.jaccard_join import near_duplicates
from quillspark.llm.mixing import mix_sources
from quillspark.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the fitted model finds toxic go. Null and empty texts are never toxic; repeated
    rows and ids are judged one by one; other columns are kept as they are; an empty table stays empty, and
    without labels to learn from nothing goes."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def by_row(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """``docs`` with one more column, and its name, which no column of theirs has: doc_id where it is unique and
    not null, as is returned too, else a number of its own for each row, written with the rows."""
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        return docs.withColumn(name, F.col("doc_id")), name, True
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name, False


def one_of_each(docs: DataFrame, rows: DataFrame, name: str, unique: bool, classes: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each class, null last, and of those that share it the one with the
    smallest number. classes: member, class (the smallest member)."""
    if unique:
        kept = classes.where("member = class").select(F.col("member").alias(name))
    else:
        ids = rows.select(F.col(name).alias("member"), "doc_id").join(classes, "member")
        first = ids.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "member")).alias("first"))
        kept = first.select(F.col("first.member").alias(name))
    return rows.join(kept, name, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the document with the smallest id stays; null counts as empty. Null
    ids come last; of rows that share the smallest id one stays. Other columns are kept as they are, whatever
    their names; an empty table stays empty."""
    rows, name, unique = by_row(docs)
    return one_of_each(docs, rows, name, unique, exact_dedup(rows, name).select(F.col("doc_id").alias("member"), F.col("keep_id").alias("class")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies the document with the smallest id stays, and
    every document without words, as those of null and empty texts. Null ids come last; of rows that share the smallest
    id one stays. Other columns are kept as they are, whatever their names; an empty table stays empty."""
    rows, name, unique = by_row(docs)
    return one_of_each(docs, rows, name, unique, near_duplicates(rows, id_col=name).select(F.col("doc_id").alias("member"), F.col("component_id").alias("class")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go. Null and empty texts hold none; repeated rows and ids
    are judged one by one; other columns are kept as they are; an empty table stays empty."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: how often the mix repeats each document that is left. Null and empty texts have no words to
    take; rows that share an id, null ids too, are taken together; other columns are left out; an empty table
    stays empty."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("mixing", mixing)]

#: Ordinal regression, near-copy components and seeded sampling can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
