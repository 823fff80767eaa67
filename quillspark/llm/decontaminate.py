"""Benchmark decontamination with SimHash over item-sized windows.

Every window of a document that has as many words as a benchmark item is fingerprinted (SimHash of
its five-word shingles; windows that share no shingle with any item have similarity 0 and are
skipped). A multi-index over the blocks of the items' fingerprints returns every item within the
Hamming radius: two fingerprints at distance r have a block of which at most r // BLOCKS bits
differ. Candidates are verified by their exact weighted-shingle similarity.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, fmix, raw_text, shingles, slices, tune, word_hashes

K = 5
BLOCKS = 8
#: Similarity 0.75 has an expected distance of 11 of 64 bits and a standard deviation of about 3.
RADIUS = 24
SIMILARITY = 0.75
#: UTF-8 bytes of benchmark text held at once; a larger benchmark is handled in so many passes.
BLOCK_BYTES = 4 << 20
#: Windows of one text whose fingerprints are summed at once.
RUN = 4096
_FILTER_BITS = 22


def bit_votes(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(fmix(s.copy()).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def simhash(votes: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of summed votes."""
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


def window_runs(places: np.ndarray, size: int, n: int):
    """Ranges of the starts of all windows of ``size`` among n shingles that hold one of the ascending
    places; at most RUN starts each, so that memory follows the window and not the text."""
    lo = np.maximum(places - size + 1, 0)
    hi = np.minimum(places, max(n - size, 0)) + 1
    new = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    for a, b in zip(lo[np.append(0, new)].tolist(), hi[np.append(new - 1, len(hi) - 1)].tolist(), strict=True):
        for x in range(a, b, RUN):
            yield x, min(x + RUN, b)


class Items:
    """The multi-index over one block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None], radius: int = RADIUS):
        self.radius = radius
        col = pa.array([t or "" for t in texts], pa.string())
        data, offs = raw_text(col)
        h, woffs = word_hashes(data, offs, PLAIN)
        s, soffs = shingles(h, woffs, K)
        self.ids, self.sizes, self.counts, self.fingers = [], [], [], []
        every = [np.empty(0, np.uint64)]
        for i, (a, b) in enumerate(zip(soffs[:-1].tolist(), soffs[1:].tolist(), strict=True)):
            if a == b:
                continue
            self.ids.append(ids[i])
            self.sizes.append(b - a)
            self.counts.append(np.unique(s[a:b], return_counts=True))
            self.fingers.append(int(simhash(bit_votes(s[a:b]).sum(0, keepdims=True))[0]))
            every.append(s[a:b])
        self.fingers = np.array(self.fingers, np.uint64)
        self.known = np.unique(np.concatenate(every))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - _FILTER_BITS)] = True
        self.of_shingle: dict[int, set[int]] = defaultdict(set)  # shingle: window sizes to look at
        for size, (keys, _) in zip(self.sizes, self.counts, strict=True):
            for x in keys.tolist():
                self.of_shingle[x].add(size)
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        near = [[v for v in range(256) if (v ^ w).bit_count() <= radius // BLOCKS] for w in range(256)]
        for i, (size, finger) in enumerate(zip(self.sizes, self.fingers.tolist(), strict=True)):
            tables = self.index.setdefault(size, [defaultdict(list) for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                for v in near[finger >> 8 * b & 255]:
                    tables[b][v].append(i)

    def within(self, size: int, finger: int) -> list[int]:
        """All items of a window size whose fingerprints lie within the radius."""
        tables = self.index[size]
        found = {i for b in range(BLOCKS) for i in tables[b].get(finger >> 8 * b & 255, ())}
        return [i for i in found if (int(self.fingers[i]) ^ finger).bit_count() <= self.radius]

    def similarity(self, i: int, window: np.ndarray) -> float:
        """Sum of the smaller over sum of the larger multiplicities of all shingles."""
        keys, n = self.counts[i]
        mine, m = np.unique(window, return_counts=True)
        at = np.searchsorted(mine, keys)
        there = np.where(mine[np.minimum(at, len(mine) - 1)] == keys, m[np.minimum(at, len(mine) - 1)], 0)
        low = int(np.minimum(n, there).sum())
        return low / (int(n.sum()) + int(m.sum()) - low)

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.filter[s >> np.uint64(64 - _FILTER_BITS)])
        if len(at) and len(self.known):
            k = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
            at = at[self.known[k] == s[at]]
        return at

    def leaks(self, s: np.ndarray, hits: np.ndarray, least: float) -> dict[int, tuple[float, int, int, int]]:
        """item: (similarity, first shingle, shingles, distance) of the best window of one row."""
        places: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for size in self.of_shingle[int(s[p])]:
                places[size].append(p)
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, held in places.items():
            for lo, last in window_runs(np.array(held, np.int64), size, len(s)):
                at = np.arange(lo, last)
                ends = np.minimum(at + size, len(s))
                sums = np.zeros((int(ends[-1]) - lo + 1, 64), np.int32)
                np.cumsum(bit_votes(s[lo : ends[-1]]), axis=0, out=sums[1:])
                fingers = simhash(sums[ends - lo] - sums[at - lo]).tolist()
                for a, e, finger in zip(at.tolist(), ends.tolist(), fingers, strict=True):
                    for i in self.within(size, finger):
                        sim = self.similarity(i, s[a:e])
                        if sim >= least and (i not in best or sim > best[i][0]):
                            best[i] = (sim, a, e - a, (int(self.fingers[i]) ^ finger).bit_count())
        return best

    def scan(self, col, least: float):
        """(row, item, similarity, first shingle, shingles, distance) over an Arrow text column."""
        data, offs = raw_text(col)
        for i, j in slices(offs):
            part = offs[i : j + 1]
            h, woffs = word_hashes(data[part[0] : part[-1]], part - part[0], PLAIN)
            s, soffs = shingles(h, woffs, K)
            hits = self.hits(s)
            rows = np.searchsorted(soffs, hits, side="right") - 1
            for r in np.unique(rows).tolist():
                a, b = int(soffs[r]), int(soffs[r + 1])
                for item, found in self.leaks(s[a:b], hits[rows == r] - a, least).items():
                    yield (i + r, self.ids[item], *found)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of bounded size, each an (ids, texts) pair on the driver."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        if part:
            yield [r["i"] for r in part], [r["t"] for r in part]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_shingles, distance): the best window of each row for
    each item with a window of similarity ``least`` or more; start counts the row's shingles.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A row shorter than
    an item is one window; an item or row of fewer than five words has its whole word sequence as
    its one shingle; null, empty and wordless items and rows match nothing. Null and repeated ids
    are carried through row by row; equal items each get their row. An empty table on either side
    gives an empty table. Whole texts are scanned, in parallel and without a shuffle."""
    spark = docs.sparkSession
    tune(spark)
    kinds = (dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col])
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start bigint, n_shingles bigint, distance int"
    out = spark.createDataFrame([], schema)
    for ids, texts in item_blocks(benchmark, item_col, item_text, block_bytes):
        held = spark.sparkContext.broadcast(Items(ids, texts))

        def run(batches, held=held):
            items = held.value
            for b in batches:
                found = list(items.scan(b.column(1), least))
                if found:
                    rows = pa.array([x[0] for x in found], pa.int64())
                    yield pa.record_batch(
                        [b.column(0).take(rows), pa.array([x[1] for x in found]), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64()), pa.array([x[5] for x in found], pa.int32())],
                        names=["doc_id", "item_id", "similarity", "start", "n_shingles", "distance"],
                    )

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, that no benchmark item leaks into."""
    spark = docs.sparkSession
    tune(spark)
    at = docs.columns.index(text_col)
    for ids, texts in item_blocks(benchmark, item_col, item_text, block_bytes):
        held = spark.sparkContext.broadcast(Items(ids, texts))

        def run(batches, held=held):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in held.value.scan(b.column(at), least)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
