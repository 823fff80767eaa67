"""Registration of arriving files against stored state, as Structured Streaming.

Two keyed states follow each other, so neither a scope nor the library as a whole is a key: whether a
scope has seen a checksum (one key for each content), then the newest version of each file name. The
rows are those of ``registry.register`` for any split of the arrivals into batches, as long as a
batch holds no arrival that comes before one of an earlier batch. State lives in RocksDB and in the
checkpoint, so a restart goes on where the last run ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVAL = "seq bigint, filename string, checksum string, session_id string"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, which processors with state need."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstSeen(StatefulProcessor):
    """Marks the first arrival of each content in its scope."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        first = None if self.seen.exists() else min(int(p["seq"].min()) for p in parts)
        if first is not None:
            self.seen.update((True,))
        for p in parts:
            yield p.assign(is_new=p["seq"] == first)[["seq", "filename", "checksum", "session_id", "is_new"]]


class Versions(StatefulProcessor):
    """Numbers the versions of a file name and tells apart its current content from what others have."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "version int, checksum string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        newest = initialState.sort_values("version").iloc[-1]
        self.latest.update((int(newest["version"]), newest["checksum"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrivals = pd.concat(list(rows), ignore_index=True).sort_values("seq")
        version, current = self.latest.get() if self.latest.exists() else (0, None)
        outcomes, versions = [], []
        for checksum, is_new in zip(arrivals["checksum"], arrivals["is_new"], strict=True):
            if is_new:
                version, current = version + 1, checksum
            kind = "registered" if is_new else "already_registered" if checksum == current else "duplicate_content"
            outcomes.append(kind)
            versions.append(None if kind == "duplicate_content" else version)
        if version:
            self.latest.update((version, current))
        out = arrivals[["seq", "filename", "checksum", "session_id"]].assign(outcome=outcomes, version=pd.array(versions, dtype="Int32"))
        yield out


def register_stream(arrivals: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """(seq, filename, checksum, session_id, outcome, version) of a stream of arrivals (seq, filename, checksum,
    session_id; null: the library). ``registered`` (filename, checksum, version, session_id) is what the registry held
    before the first batch."""
    spark = arrivals.sparkSession
    use_rocksdb(spark)
    scope = F.when(F.col("session_id").isNull(), F.lit("library")).otherwise(F.concat(F.lit("session:"), F.col("session_id"))).alias("scope")
    rows = arrivals.select(*(F.col(n).cast(k) for n, k in (c.split() for c in ARRIVAL.split(", "))), scope)
    kwargs = [{}, {}]
    if registered is not None:
        held = registered.select("filename", "checksum", F.col("version").cast("int"), scope)
        kwargs = [{"initialState": held.select("scope", "checksum").distinct().withColumn("held", F.lit(True)).groupBy("scope", "checksum")}, {"initialState": held.groupBy("scope", "filename")}]
    marked = rows.groupBy("scope", "checksum").transformWithStateInPandas(_Seen() if registered is not None else FirstSeen(), f"{ARRIVAL}, is_new boolean", "append", "none", **kwargs[0])
    again = marked.withColumn("scope", scope)
    return again.groupBy("scope", "filename").transformWithStateInPandas(Versions(), f"{ARRIVAL}, outcome string, version int", "append", "none", **kwargs[1])


class _Seen(FirstSeen):
    """``FirstSeen`` that knows the contents of a registry."""

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))
