"""Watching folders: events as differences of listings, and candidates that have come to rest.

``FolderEvents`` is a streaming source whose offsets are listings, so a restart finds what happened while
nothing ran. ``settled`` is the watcher's debounce with state: each event of a path sets its timer anew,
and a file that changes while it is read, or can't be read, is tried again later.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.registry import find_library_documents
from .registration import use_rocksdb

QUIET_MS = 3000
SUFFIXES = (".pdf",)
#: Events that one task reads.
PART = 1000


def supported(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether a path has one of the suffixes, in either case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*suffixes)


# --------------------------------------------------------------------------- listings


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, path, moved_to) between two listings (path, size, modified): created, modified, deleted, and moved
    where a file that is gone has the size and time of just one new file, and that of just one that is gone."""
    key = ["size", "modified"]
    old, new = before.select("path", *key), after.select("path", *key)
    both = old.withColumn("was", F.struct(*key)).drop(*key).join(new.withColumn("now", F.struct(*key)).drop(*key), "path", "full_outer")
    gone, came = both.where("now is null").select("path", "was.*"), both.where("was is null").select(F.col("path").alias("moved_to"), "now.*")
    pairs = gone.join(came, key).groupBy(*key).agg(F.min("path").alias("path"), F.min("moved_to").alias("moved_to"), F.count("*").alias("n")).where("n = 1").select("path", "moved_to")
    changed = both.where("was is null or now is null or was <> now")
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "created").otherwise("modified")
    rows = changed.select(kind.alias("kind"), "path").join(pairs, "path", "left").join(pairs.select(F.col("moved_to").alias("path"), F.lit(True).alias("target")), "path", "left")
    return rows.where("target is null").select(F.when(F.col("moved_to").isNotNull(), "moved").otherwise(F.col("kind")).alias("kind"), "path", "moved_to")


def removed_documents(events: DataFrame, registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Library documents to delete (S4): their file is gone, or moved away, and no current file of theirs is left, as
    one is after the watcher's own move to the archive. events: kind, path, folder, name; listing: folder, name."""
    gone = events.where(F.col("kind").isin("deleted", "moved")).select("path", "folder", "name")
    found = find_library_documents(gone, registry).where("document_id is not null").select("document_id", "folder", "name").distinct()
    return found.join(listing.select("folder", "name").distinct(), ["folder", "name"], "left_anti").select("document_id")


class _Part(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    """The differences of the listings at two offsets."""

    def __init__(self, options: dict):
        self.system, self.folder = fs.FileSystem.from_uri(options["path"])
        self.suffixes = tuple(x.lower() for x in options.get("suffixes", ",".join(SUFFIXES)).split(","))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = self.system.get_file_info(fs.FileSelector(self.folder, recursive=False, allow_not_found=True))
        files = {f.base_name: [f.size, f.mtime_ns] for f in found if f.is_file and f.base_name.lower().endswith(self.suffixes)}
        return {"files": json.dumps(files, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        gone, came = ({n: tuple(a[n]) for n in sorted(a) if n not in b} for a, b in ((old, new), (new, old)))
        rows = [("modified", n, None, *new[n]) for n in sorted(new) if n in old and old[n] != new[n]]
        for name, mark in gone.items():
            to = [n for n, m in came.items() if m == mark]
            if len(to) == 1 and list(gone.values()).count(mark) == 1:
                rows.append(("moved", name, to[0], *came.pop(to[0])))
            else:
                rows.append(("deleted", name, None, None, None))
        rows += [("created", n, None, *m) for n, m in came.items()]
        return [_Part(rows[i : i + PART]) for i in range(0, len(rows), PART)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return iter(partition.rows)


class FolderEvents(DataSource):
    """``readStream.format("folder_events")`` of a folder (a URI): kind (created, modified, moved, deleted), path
    (the name in the folder), moved_to, size, modified (nanoseconds).

    An offset is the folder's listing, so it is as large as the folder has files: meant for an inbox, which is emptied.
    Files are known by their suffix in either case (option ``suffixes``, comma-separated); folders are left out."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return "kind string, path string, moved_to string, size bigint, modified bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def folder_events(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The stream of a folder's events."""
    use_rocksdb(spark)
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format("folder_events").option("path", folder).options(**options).load()


# --------------------------------------------------------------------------- debounce


class Settled(StatefulProcessor):
    """Waits until a path has had no event for a while, then reads it. ``probe`` gives (size, modified) of a path,
    ``digest`` its checksum; either may raise OSError, FileNotFoundError meaning that it is gone."""

    def __init__(self, probe: Callable[[str], tuple], digest: Callable[[str], str], quiet_ms: int):
        self.probe, self.digest, self.quiet_ms = probe, digest, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "n bigint")

    def _arm(self, now_ms: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(now_ms + self.quiet_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(p) for p in rows)
        self.events.update(((self.events.get()[0] if self.events.exists() else 0) + n,))
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        try:
            before = self.probe(key[0])
            checksum = self.digest(key[0])
            after = self.probe(key[0])
        except FileNotFoundError:
            self.events.clear()
            return
        except OSError:
            before, after = None, ()
        if before != after:  # it changed while it was read, or can't be read: later
            self._arm(timerValues.getCurrentProcessingTimeInMs())
            return
        n = self.events.get()[0] if self.events.exists() else 0
        self.events.clear()
        yield pd.DataFrame({"path": [key[0]], "size": [after[0]], "checksum": [checksum], "events": [n]})


def settled(events: DataFrame, probe: Callable[[str], tuple], digest: Callable[[str], str], quiet_ms: int = QUIET_MS) -> DataFrame:
    """(path, size, checksum, events) of the paths of a stream of events (path), each once it has been quiet and
    its size and time were the same before and after it was read (S1). Timers are of processing time: a path that no
    batch comes for is read by the first batch after its time."""
    use_rocksdb(events.sparkSession)
    rows = events.select("path").groupBy("path")
    return rows.transformWithStateInPandas(Settled(probe, digest, quiet_ms), "path string, size bigint, checksum string, events bigint", "append", "processingTime")
