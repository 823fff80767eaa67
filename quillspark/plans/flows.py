"""Flows with state in tables: evaluation that stops at the first quota error, and incremental embedding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import small
from ..session import shared_folder, ship, stored
from ..sources.models import Encoder, LLMError, QuotaError

#: Cases of the first batch; each batch is twice as large as the one before, so at most half of the calls are lost.
FIRST_BATCH = 64
ANSWERED = "case_id bigint, nth bigint, status string, answer string"


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``nth``, their number from 0 in the order of a column, without one task for all of them: ranges are
    sorted apart, and only the number of rows of each comes to the driver."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, first, seen = F.shiftright("at", 33), [], 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        first.append((r["part"], seen))
        seen += r["count"]
    first = spark.createDataFrame(first, "part bigint, first bigint")
    out = rows.withColumn("part", part).join(F.broadcast(first), "part")
    return out.withColumn("nth", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "first", "at")


def evaluate(cases: DataFrame, ask: Callable[[str], tuple[str, str]], done: DataFrame | None = None, first: int = FIRST_BATCH) -> DataFrame:
    """(case_id, nth, status, answer) of the cases (case_id, pos, question) in the order of ``pos``, up to the first quota
    error, as a loop over them would give (P6, D18). Other errors of the model are results with status ``error``.

    Cases run in batches over all tasks; when a call meets the quota, the least position that did ends the results, and
    what ran behind it is dropped. ``done`` are results of an earlier run: cases that have one, other than an error,
    are left out. ``ask`` gives a question's status and answer."""
    spark = cases.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/evaluated-{uuid.uuid4().hex}"
    if done is not None:
        cases = cases.join(done.where("status <> 'error'").select("case_id"), "case_id", "left_anti")
    rows = stored(numbered(cases.select("case_id", "question", "pos"), "pos"), "cases")
    total, start, size = rows.count(), 0, first

    def run(batches):
        for df in batches:
            out = []
            for c in df.itertuples(index=False):
                try:
                    status, answer = ask(c.question)
                except QuotaError as e:
                    status, answer = "quota", str(e)
                except LLMError as e:
                    status, answer = "error", str(e)
                out.append((c.case_id, c.nth, status, answer))
            yield pd.DataFrame(out, columns=["case_id", "nth", "status", "answer"])

    schema = ANSWERED.replace("bigint", dict(cases.dtypes)["case_id"], 1)
    out = spark.createDataFrame([], schema)
    while start < total:
        batch = rows.where((F.col("nth") >= start) & (F.col("nth") < start + size)).repartition(spark.sparkContext.defaultParallelism, "nth")
        batch.mapInPandas(run, schema).write.mode("append").parquet(path)
        out = spark.read.schema(schema).parquet(path)
        end = out.where("status = 'quota'").agg(F.min("nth")).first()[0]
        if end is not None:
            return out.where(F.col("nth") < end)
        start, size = start + size, size * 2
    return out


def redo(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id) of the cases to run again: those with an error and those without a result."""
    return cases.select("case_id").join(results.where("status <> 'error'").select("case_id"), "case_id", "left_anti")


class VectorStore:
    """Vectors in a folder, partitioned by model and by the batch that made them (L4, C6, B2). A chunk's vector is
    the one of its latest batch; it is current while it has the hash of the chunk's text."""

    SCHEMA = "chunk_id {}, text_sha256 string, dims int, vector array<float>, model string, epoch bigint"

    def __init__(self, spark, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), self.SCHEMA.format(id_type)

    def read(self, model: str, before: int | None = None) -> DataFrame:
        """The latest vectors of a model, of batches before ``before``."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("model") == model)
        rows = rows if before is None else rows.where(F.col("epoch") < before)
        newest = rows.groupBy("chunk_id").agg(F.max("epoch").alias("epoch"))
        return rows.join(newest, ["chunk_id", "epoch"])

    def update(self, chunks: DataFrame, encoder: Encoder, epoch: int) -> None:
        """Encode the chunks (chunk_id, text) that have no current vector. An epoch that runs again finds the
        store as it was before it, and writes the same partition anew."""
        keyed = chunks.select("chunk_id", F.sha2("text", 256).alias("text_sha256"))
        rows = chunks.select("chunk_id", "text")
        if not keyed.groupBy("chunk_id").count().where("count > 1").isEmpty():
            rows = stored(rows.dropDuplicates(["chunk_id"]), "distinct-chunks")
            keyed = rows.select("chunk_id", F.sha2("text", 256).alias("text_sha256"))
        held = self.read(encoder.name, epoch).select("chunk_id", "text_sha256")
        if not held.isEmpty():  # ids and hashes say what is stale, so texts move at most once
            stale = stored(keyed.join(held, ["chunk_id", "text_sha256"], "left_anti").select("chunk_id"), "stale")
            rows = rows.join(small(stale), "chunk_id", "left_semi")
        made = encoder.encode(rows.withColumn("text_sha256", F.sha2("text", 256)), "text")
        rows = made.select("chunk_id", "text_sha256", F.size("vector").alias("dims"), F.col("vector").cast("array<float>"), F.lit(encoder.name).alias("model"), F.lit(epoch).cast("bigint").alias("epoch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "epoch").parquet(self.path)

    def current(self, chunks: DataFrame, model: str) -> DataFrame:
        """chunks with their current ``vector``, in candidate order where they have its columns."""
        found = chunks.withColumn("text_sha256", F.sha2("text", 256)).join(self.read(model).select("chunk_id", "text_sha256", "vector"), ["chunk_id", "text_sha256"])
        order = [c for c in ("document_name", "page_number", "chunk_id") if c in chunks.columns]
        return found.select(*chunks.columns, "vector").orderBy(*order)


def embed_stream(chunks: DataFrame, store: VectorStore, encoder: Encoder, checkpoint: str):
    """Keep a store up to date with a stream of chunks; a batch that is replayed changes nothing."""
    return chunks.writeStream.foreachBatch(lambda df, epoch: store.update(df, encoder, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
