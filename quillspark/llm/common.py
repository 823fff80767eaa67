"""Helpers shared by the training-data operators: raw access to Arrow text, vectorised word and
shingle hashing, shared-folder tables, and connected components.

Nothing here depends on a machine-local folder: tables that cut lineage go to the folder that the
session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, stored

#: Rows in an Arrow batch handed to Python. Texts are a few KB on average, so a batch is a few MB.
ARROW_ROWS = 1000
#: Bytes of text that the vectorised kernels work on at once (a single longer text is one slice).
SLICE_BYTES = 2 << 20


def tune(spark: SparkSession) -> None:
    """Ship the package to the workers; small Arrow batches keep their memory bounded when texts are long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


# --------------------------------------------------------------------------- shared tables


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files, so a
    lost executor costs a re-read and not a recomputation. Shuffle files of the write go when it ends."""
    return stored(df, tag)


# --------------------------------------------------------------------------- Arrow text


def raw_text(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int | None = None):
    """Row ranges (i, j) whose texts hold at most ``most`` bytes together (or one row)."""
    i, n, most = 0, len(offs) - 1, most or SLICE_BYTES
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# --------------------------------------------------------------------------- hashing

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and ASCII punctuation as white space.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if _pow["n"] < n:
        size = max(n, SLICE_BYTES + 4096)
        for key, base in (("p", _BASE), ("q", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[key] = np.cumprod(x, dtype=np.uint64)
        _pow["n"] = size
    return _pow["p"], _pow["q"]


def fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[e] - C[s] equal to the polynomial sum of data[s:e], shifted by BASE**s."""
    p, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, q = powers(len(c))
    return fmix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offs: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` and each row's offset.
    ``table`` maps bytes before they are looked at."""
    data = table[data]
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offs), np.int64)
    solid = ~WS[data]
    cut = offs[:-1][offs[:-1] < n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = offs[1:][offs[1:] > 0] - 1
    after[end] = False
    ends = np.flatnonzero(solid & ~after) + 1
    h = span_hash(prefix_hash(data), starts, ends)
    return h, np.searchsorted(starts, offs).astype(np.int64)


def shingles(h: np.ndarray, woffs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, in text order, with row offsets. A row of fewer
    than k words has its whole word sequence as its one shingle; a row without words has none."""
    nw = np.diff(woffs)
    valid = np.ones(len(h), bool)
    for j in range(1, k):
        at = woffs[1:] - j
        valid[at[at >= woffs[:-1]]] = False
    g = np.zeros(len(h), np.uint64)
    m = len(h) - k + 1
    if m > 0:
        acc = h[:m] * _LANE[0]
        for j in range(1, k):
            acc += h[j : m + j] * _LANE[j]
        g[:m] = fmix(acc)
    for size in range(1, k):
        at = woffs[:-1][nw == size]
        if len(at):
            acc = np.full(len(at), size, np.uint64) * _LANE[40 + size]
            for j in range(size):
                acc += h[at + j] * _LANE[j]
            g[at] = fmix(acc)
            valid[at] = True
    counts = np.where(nw >= k, nw - k + 1, (nw > 0).astype(np.int64))
    soffs = np.zeros(len(woffs), np.int64)
    np.cumsum(counts, out=soffs[1:])
    return g[valid], soffs


def shingle_sets(col, k: int = 5):
    """For each row of an Arrow text column, its sorted array of distinct shingle hashes."""
    data, offs = raw_text(col)
    for i, j in slices(offs):
        part = offs[i : j + 1]
        h, woffs = word_hashes(data[part[0] : part[-1]], part - part[0])
        s, soffs = shingles(h, woffs, k)
        for a, b in zip(soffs[:-1].tolist(), soffs[1:].tolist(), strict=True):
            yield np.unique(s[a:b])


# --------------------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """(node, root) for every node of an undirected graph, root being the component's smallest node.

    Boruvka rounds: each node hooks onto its smallest neighbour, pointer doubling turns the trees
    into stars, and the edges are contracted to roots. The live nodes halve at least with each
    round, so the rounds grow with the logarithm of the graph. All state stays in tables; minima
    combine before the shuffle, so a node with very many edges makes no large group."""
    spark = edges.sparkSession
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v and u is not null and v is not null").distinct()
    live = materialize(live, tag)
    levels: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        hook = materialize(hook, tag)
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            step = hook.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved"))
            step = materialize(step, tag)
            hook = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        levels.append(hook)
        left = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        live = live.join(left, "u").join(right, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        live = materialize(live, tag)
    if not levels:
        return spark.createDataFrame([], f"node {dict(edges.dtypes)[a]}, root {dict(edges.dtypes)[a]}")
    out = levels[0]
    for nxt in levels[1:]:
        up = nxt.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(out, tag) if len(levels) > 1 else out
