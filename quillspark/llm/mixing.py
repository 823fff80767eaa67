"""Mixing sources to target weights by capped water-filling.

Each source's share of the total is proportional to its weight, but a target never exceeds
``max_epochs`` times what the source holds. Sources above that are clamped, and what they cannot
take is dealt to the others by weight, until no source is above. A source's target is then sampled
as whole repetitions of all its documents plus a seeded fraction of one more.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

#: Hash buckets a source is cut into to find where its fractional repetition ends.
BUCKETS = 4096
#: Sources up to which their totals (not documents) are levelled on the driver, a few bytes each; beyond it by aggregates.
MAX_SOURCES = 200_000
#: Source totals up to this count are broadcast (under 1 MB); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 4_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], max_epochs: float, total: float | None = None) -> list[float]:
    """Targets that share ``total`` (default: all sizes) by weight, none above max_epochs * size."""
    caps = [max_epochs * s for s in sizes]
    budget = float(sum(sizes) if total is None else total)
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in sorted(free))
        if weight <= 0 or budget <= 0:
            break
        over = [i for i in sorted(free) if budget * weights[i] >= caps[i] * weight]
        if not over:
            for i in free:
                target[i] = budget * weights[i] / weight
            break
        for i in over:
            target[i] = float(caps[i])
            budget -= caps[i]
            free.discard(i)
    return target


def level_sources(totals: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(source, source_size, target, whole, rest) of sources (source, words), too many for the driver.

    The targets of ``water_fill``: min(cap, level * weight). Each round clamps the sources below the
    level and raises it, until no more are clamped; the driver sees one row for each weight and round."""
    n = len(weights)
    rows = materialize(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    first, seen = [], 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per partition
        first.append((r["part"], seen))
        seen += r["count"]
    first = totals.sparkSession.createDataFrame(first, "part bigint, first bigint")
    slot = ((within + F.col("first")) % n).cast("int")
    rows = rows.withColumn("part", part).join(F.broadcast(first), "part").select("source", F.col("words").alias("source_size"), slot.alias("slot"))
    weight = F.get(F.array(*map(F.lit, map(float, weights))), F.col("slot"))
    cap = max_epochs * F.col("source_size")
    rows = materialize(rows.select("*", weight.alias("weight"), cap.alias("cap")), "mix")
    budget = rows.agg(F.sum("source_size")).first()[0]
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight") if clamped >= 0 else F.lit(False)
        found = rows.groupBy("slot").agg(F.count_if(full).alias("full"), F.count_if(~full).alias("free"), F.sum(F.when(full, F.col("cap"))).alias("taken")).collect()
        free = sum(r["free"] * float(weights[r["slot"]]) for r in sorted(found, key=lambda r: r["slot"]))
        now = sum(r["full"] for r in found)
        if free <= 0 or now == clamped:
            break
        clamped = now
        level = (budget - sum(r["taken"] or 0 for r in found)) / free
    target = F.when(F.col("cap") <= level * F.col("weight"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    rows = rows.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("int")
    rest = F.when(F.col("whole") < max_epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    return rows.withColumn("whole", whole).withColumn("rest", rest)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every row.

    The size of a row is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Sources are
    ordered by code point, null last, and take the weights in turn. ``copies`` is how often the mix
    repeats the row, at most ``max_epochs``; ``taken`` is copies * size. A source's fractional
    repetition goes through its rows in the order of a seeded hash of the id until the target is
    reached, so taken words miss the target by less than one document; rows that share an id (null
    ids too) are taken together. A source without words has target 0. Rerunning gives the same mix.

    The hot source is never gathered: its hash range is cut into buckets, sums of buckets say in
    which one the fraction ends, and only that bucket's rows are put in order."""
    spark = docs.sparkSession
    tune(spark)

    def sizes(batches):
        for b in batches:
            n = [len(t.encode("utf-8").split()) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("t"))
    rows = rows.mapInArrow(sizes, f"doc_id {kinds[id_col]}, source {kinds[source_col]}, size bigint")
    rows = materialize(rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "mix")
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))

    cells = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix")
    totals = cells.groupBy("source").agg(F.sum("words").alias("words"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        plan = materialize(level_sources(totals, weights, max_epochs), "mix")
    else:
        found.sort(key=lambda r: (r["source"] is None, r["source"] if r["source"] is not None else ""))
        held = [r["words"] for r in found]
        targets = water_fill(held, [weights[i % len(weights)] for i in range(len(found))], max_epochs)
        plan = []
        for r, size, target in zip(found, held, targets, strict=True):
            whole = min(int(target // size), max_epochs) if size else 0
            plan.append((r["source"], size, target, whole, target - whole * size if whole < max_epochs else 0.0))
        plan = spark.createDataFrame(plan, f"source {kinds[source_col]}, source_size bigint, target double, whole int, rest double")
    small = F.broadcast if len(found) <= BROADCAST_SOURCES else (lambda x: x)

    # The bucket in which each source's running sum passes what is left, and the sum before it.
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = cells.withColumn("before", F.coalesce(before, F.lit(0))).alias("c")
    ends = ends.join(small(plan.select(F.col("source").alias("s"), "rest")), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where("before < rest and rest <= before + words").select("s", F.col("bucket").alias("end"), (F.col("rest") - F.col("before")).alias("left"))
    plan = plan.join(ends, plan["source"].eqNullSafe(ends["s"]), "left").drop("s")
    # Within that bucket: ids in hash order until the nearest point to what is left.
    inside = rows.join(small(plan.where("end is not null").select(F.col("source").alias("s"), "end", "left")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("end")))
    inside = inside.groupBy("s", "h", "doc_id", "left").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("s").orderBy("h", "doc_id"))
    inside = inside.withColumn("mid", run - F.col("words") / 2).where("mid <= left")
    last = inside.groupBy("s").agg(F.max(F.struct("h", "doc_id")).alias("last"))
    plan = plan.join(last, plan["source"].eqNullSafe(last["s"]), "left").drop("s").withColumnRenamed("source", "s")
    plan = materialize(plan.withColumn("key", F.coalesce(F.col("s").cast("string"), F.lit(""))).withColumn("none", F.col("s").isNull()), "mix")

    out = rows.withColumn("key", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("none", F.col("source").isNull())
    out = out.join(small(plan), ["key", "none"])
    extra = (F.col("bucket") < F.col("end")) | ((F.col("bucket") == F.col("end")) & (F.struct("h", "doc_id") <= F.col("last")))
    out = out.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
