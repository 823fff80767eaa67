"""Exact deduplication by Grace hashing.

Records are dealt to partitions by a hash of their normalised text. A partition that does not fit in
memory is written to spill files by the next bits of the hash, and each file is treated the same
way, until a bucket fits an open-addressing table that compares complete texts. The same routine
runs twice: over each input partition, so that a text with very many copies leaves each partition
once, and over the partitions of the hash.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

#: Bytes of distinct text that a table holds before its bucket is spilled and split further.
TABLE_BYTES = 48 << 20
#: Spill files of one split, and the bits of the hash that choose among them.
FANOUT_BITS = 4
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_HEAD = struct.Struct("<QqqqBI")


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space; null counts as empty."""
    data = (text or "").encode("utf-8").translate(_SPACES)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


class Table:
    """Open addressing with linear probing. A record is (hash, least id or None, rows with that id,
    rows, text); a record whose complete text is present already is merged into it."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.rows: list[list] = []
        self.bytes = 0

    def add(self, h: int, low: int | None, ties: int, n: int, text: bytes) -> None:
        mask = len(self.slots) - 1
        i = h & mask
        while (r := self.slots[i]) >= 0:
            row = self.rows[r]
            if row[0] == h and row[4] == text:
                row[3] += n
                if low == row[1]:
                    row[2] += ties
                elif low is not None and (row[1] is None or low < row[1]):
                    row[1], row[2] = low, ties
                return
            i = (i + 1) & mask
        self.slots[i] = len(self.rows)
        self.rows.append([h, low, ties, n, text])
        self.bytes += len(text) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.grow()

    def grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, row in enumerate(self.rows):
            i = row[0] & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = k


def _dump(f, h, low, ties, n, text) -> None:
    f.write(_HEAD.pack(h, low or 0, ties, n, low is None, len(text)))
    f.write(text)


def _load(f):
    while head := f.read(_HEAD.size):
        h, low, ties, n, none, size = _HEAD.unpack(head)
        yield h, None if none else low, ties, n, f.read(size)


def grace(records, budget: int = TABLE_BYTES, depth: int = 0):
    """One merged record per distinct text. Spill files are the task's own, deleted when read; a
    lost task writes them anew."""
    table, records = Table(), iter(records)
    for rec in records:
        table.add(*rec)
        if table.bytes > budget and (depth + 1) * FANOUT_BITS <= 56 and len(table.rows) > 1:
            break
    else:
        yield from table.rows
        return
    files = [tempfile.TemporaryFile(prefix="grace-") for _ in range(1 << FANOUT_BITS)]
    shift, mask = 60 - depth * FANOUT_BITS, len(files) - 1
    for rows in (table.rows, records):
        for rec in rows:
            _dump(files[rec[0] >> shift & mask], *rec)
    del table
    for f in files:
        f.seek(0)
        yield from grace(_load(f), budget, depth + 1)
        f.close()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """(sha, keep_id, ties, group_size): one row per distinct normalised text."""
    tune(docs.sparkSession)
    schema = "h bigint, low bigint, ties bigint, n bigint, text binary"

    def emit(found, final: bool):
        part, size = [], 0
        for rec in found:
            part.append(rec)
            size += len(rec[4])
            if size > 4 << 20 or len(part) >= 5000:
                yield batch(part, final)
                part, size = [], 0
        if part:
            yield batch(part, final)

    def batch(rows, final: bool):
        ints = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
        if final:
            return pa.record_batch([pa.array([hashlib.sha256(r[4]).digest() for r in rows], pa.binary()), *ints], names=["sha", "keep_id", "ties", "group_size"])
        return pa.record_batch([pa.array([_signed(r[0]) for r in rows], pa.int64()), *ints, pa.array([r[4] for r in rows], pa.binary())], names=["h", "low", "ties", "n", "text"])

    def local(batches):
        def records():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    text = normalise(t)
                    yield xxhash.xxh3_64_intdigest(text), i, 1, 1, text

        yield from emit(grace(records(), budget), False)

    def merge(batches):
        def records():
            for b in batches:
                cols = [b.column(k).to_pylist() for k in range(5)]
                for h, low, ties, n, text in zip(*cols, strict=True):
                    yield h & 0xFFFFFFFFFFFFFFFF, low, ties, n, text

        yield from emit(grace(records(), budget), True)

    first = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).mapInArrow(local, schema)
    return first.repartition("h").mapInArrow(merge, "sha binary, keep_id bigint, ties bigint, group_size bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when identical after each run of ASCII white space became one space; null counts
    as empty, and so does not differ from an empty text. The row with the smallest id of a group
    stays. A null id sorts after every other; a group of null ids only has a null keep_id. Of rows
    that repeat the smallest id, exactly one is kept (any of them: they are the same text). An empty
    table gives an empty table; other columns are ignored.

    Text crosses the network once, after each input partition was deduplicated; the answer goes
    back to the rows by the digest alone. A text with very many copies makes that join skewed in
    its narrow rows, which adaptive execution splits."""
    tune(docs.sparkSession)

    def digests(batches):
        for b in batches:
            found = [hashlib.sha256(normalise(t)).digest() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "sha"])

    classes = materialize(exact_classes(docs, id_col, text_col, budget), "exact")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(digests, "doc_id bigint, sha binary")
    joined = rows.join(classes, "sha").withColumn("low", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if classes.where("ties > 1").isEmpty():
        kept = joined.withColumn("kept", F.col("low"))
    else:
        w = Window.partitionBy("doc_id", "sha").orderBy(F.lit(1))
        kept = joined.withColumn("kept", F.col("low") & (F.row_number().over(w) == 1))
    return kept.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
