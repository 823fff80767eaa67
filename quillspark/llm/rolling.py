"""Rolling window features by time sharding and blockwise presorted linked lists.

Every source is cut into time chunks of the longest window's length, and each chunk gets the rows of
that window before it as a halo, so chunks are independent groups. A hot source has as many chunks as
its time has; a chunk holds twice the rows of one long window, and since its halo is one window,
shorter chunks could not halve that.

Inside a chunk, time is cut into blocks as long as the window. A window then covers the end of one
block and the beginning of the next. Each block's values are sorted once into a doubly linked list:
values that leave the older block are unlinked, and those of the newer block, unlinked backwards
beforehand, are linked in again. The pointers of the asked ranks move by single links.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Window lengths in seconds, and the ranks ceil(percent * m / 100) of a window's m values.
WINDOWS = (3600, 21600)
PERCENTS = (50, 75)


class RankPointer:
    """The element of a rank in the union of two linked lists. All that is at or before ``top`` in the
    total order counts as low; ``at`` has each list's first element beyond it."""

    __slots__ = ("at", "low", "top")

    def __init__(self, first: list[int]):
        self.top, self.low, self.at = -1, 0, first

    def linked(self, x: int, place: int, side: int, place_of: list[int]) -> None:
        if place <= self.top:
            self.low += 1
        elif place < place_of[self.at[side]]:
            self.at[side] = x

    def unlinked(self, x: int, place: int, side: int, after: list[int]) -> None:
        if place <= self.top:
            self.low -= 1
        elif self.at[side] == x:
            self.at[side] = after[x]

    def move(self, rank: int, place_of: list[int], after: list[int], before: list[int]) -> int:
        """Step link by link until ``rank`` elements are low; the place of the last of them."""
        at = self.at
        while self.low < rank:
            side = 0 if place_of[at[0]] < place_of[at[1]] else 1
            self.top = place_of[at[side]]
            at[side] = after[at[side]]
            self.low += 1
        while self.low > rank:
            a, b = before[at[0]], before[at[1]]
            side, x = (0, a) if place_of[a] > place_of[b] else (1, b)
            at[side] = x
            self.top = place_of[x] - 1
            self.low -= 1
        return max(place_of[before[at[0]]], place_of[before[at[1]]])


def block_ranks(old_t: np.ndarray, old_v: np.ndarray, new_t: np.ndarray, new_v: np.ndarray, asked: np.ndarray, window: int, percents: Sequence[int]) -> list[list[int | None]]:
    """For each time of ``asked`` (ascending), the values of the ranks among old elements with time >=
    asked - window and new ones with time < asked. Both blocks are in the order of time."""
    n_old, n = len(old_v), len(old_v) + len(new_v)
    values = np.concatenate([old_v, new_v])
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    # Elements 0..n-1, then head and tail of either list; places in the total order, heads -1, tails n.
    places = np.empty(n + 4, np.int64)
    places[order] = np.arange(n)
    places[n:] = (-1, n, -1, n)
    after, before = [0] * (n + 4), [0] * (n + 4)
    for side, chain in enumerate((order[order < n_old].tolist(), order[order >= n_old].tolist())):
        chain = [n + 2 * side, *chain, n + 2 * side + 1]
        for x, y in zip(chain, chain[1:], strict=False):
            after[x], before[y] = y, x
    for x in range(n - 1, n_old - 1, -1):  # the newer block is empty at first
        after[before[x]], before[after[x]] = after[x], before[x]
    place_of = places.tolist()
    pointers = [RankPointer([after[n], n + 3]) for _ in percents]
    gone, come = np.searchsorted(old_t, asked - window).tolist(), np.searchsorted(new_t, asked).tolist()
    out, i, j = [], 0, 0
    for leave, enter in zip(gone, come, strict=True):
        for x in range(i, leave):
            after[before[x]], before[after[x]] = after[x], before[x]
            for p in pointers:
                p.unlinked(x, place_of[x], 0, after)
        for x in range(n_old + j, n_old + enter):
            after[before[x]], before[after[x]] = x, x
            for p in pointers:
                p.linked(x, place_of[x], 1, place_of)
        i, j = max(i, leave), enter
        m = n_old - i + j
        out.append([int(ranked[p.move(-(-percent * m // 100), place_of, after, before)]) if m else None for p, percent in zip(pointers, percents, strict=True)])
    return out


def distinct_kinds(t: np.ndarray, kinds: np.ndarray, asked: np.ndarray, window: int) -> np.ndarray:
    """The number of distinct kinds >= 0 among the rows of each window."""
    seen, live, i, j, codes = [0] * (int(kinds.max(initial=-1)) + 1), 0, 0, 0, kinds.tolist()
    out = np.empty(len(asked), np.int64)
    for k, (leave, enter) in enumerate(zip(np.searchsorted(t, asked - window).tolist(), np.searchsorted(t, asked).tolist(), strict=True)):
        for c in codes[j:enter]:
            if c >= 0:
                live += not seen[c]
                seen[c] += 1
        for c in codes[i:leave]:
            if c >= 0:
                seen[c] -= 1
                live -= not seen[c]
        i, j = leave, enter
        out[k] = live
    return out


def window_features(t: np.ndarray, values: np.ndarray, known: np.ndarray, kinds: np.ndarray, asked: np.ndarray, start: int, window: int, percents: Sequence[int]) -> list:
    """Columns (n, sum, distinct kinds, each rank's value) of the windows before the distinct times
    ``asked``, none of which lies before ``start``. Rows are in the order of time."""
    lo, hi = np.searchsorted(t, asked - window), np.searchsorted(t, asked)
    run = np.concatenate([[0], np.cumsum(np.where(known, values, 0))])
    vt, v = t[known], values[known]
    ranks: list[list[int | None]] = []
    block = (asked - start) // window
    for b in np.unique(block).tolist():
        cut = np.searchsorted(vt, [start + (b - 1) * window, start + b * window, start + (b + 1) * window])
        old, new = slice(cut[0], cut[1]), slice(cut[1], cut[2])
        ranks += block_ranks(vt[old], v[old], vt[new], v[new], asked[block == b], window, percents)
    return [hi - lo, run[hi] - run[lo], distinct_kinds(t, kinds, asked, window), *([r[k] for r in ranks] for k in range(len(percents)))]


def rolling_features(
    events: DataFrame,
    windows: Sequence[int] = WINDOWS,
    percents: Sequence[int] = PERCENTS,
    id_col: str = "doc_id",
    source_col: str = "source",
    time_col: str = "event_s",
    value_col: str = "length",
    kind_col: str = "lang",
    chunk: int | None = None,
) -> DataFrame:
    """(id, source, event_s, window_s, n_events, total, n_kinds, p<percent> ...): for each row and each
    window W, what the rows of its source with event_s - W <= time < event_s hold.

    Times and values are integers, times in seconds. ``n_events`` counts all rows of the window,
    ``total`` adds the values (0 without any), ``n_kinds`` counts distinct non-null kinds, and
    p<percent> is value number ceil(percent * m / 100) of the m non-null values in ascending order,
    repeats kept (m = 0: null). Null is one source. Rows of equal times and repeated rows all count and all
    come back; null and repeated ids are carried through. A row without a time is in no window, and its own
    windows are empty. An empty table gives an empty table; other columns are ignored whatever
    their names.

    ``chunk`` is the length of a time chunk, by default the longest window. One group (source, chunk)
    holds the source's rows of a chunk and of the longest window before it, as narrow columns; a row
    is shuffled once or twice, never its text."""
    tune(events.sparkSession)
    kinds, far = dict(events.dtypes), max(windows)
    chunk = chunk or far
    names = ["id", "source", "event_s", "window_s", "n_events", "total", "n_kinds", *(f"p{p}" for p in percents)]
    schema = f"id {kinds[id_col]}, source {kinds[source_col]}, event_s bigint, window_s bigint, n_events bigint, total bigint, n_kinds bigint" + "".join(f", p{p} bigint" for p in percents)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        start = key[1].as_py() * chunk
        group = group.combine_chunks().sort_by("t")
        t = group["t"].to_numpy()
        mine = np.flatnonzero(t >= start)
        asked, row = np.unique(t[mine], return_inverse=True)
        known = pc.is_valid(group["v"]).to_numpy()
        values = pc.fill_null(group["v"], 0).to_numpy()
        codes = pc.fill_null(group["k"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = group.take(pa.array(mine))
        parts = []
        for w in windows:
            made = window_features(t, values, known, codes, asked, start, w, percents) if len(asked) else [[]] * (3 + len(percents))
            made = [pa.array(x, pa.int64()).take(pa.array(row, pa.int64())) for x in made]
            parts.append(pa.table([own["id"], own["s"], own["t"], pa.array([w] * len(mine), pa.int64()), *made], names=names))
        return pa.concat_tables(parts)

    def place(t: Column) -> Column:
        return F.floor((t - F.pmod(t, F.lit(chunk))) / chunk)

    rows = events.select(F.col(id_col).alias("id"), F.col(source_col).alias("s"), F.col(time_col).cast("bigint").alias("t"), F.col(value_col).cast("bigint").alias("v"), F.col(kind_col).alias("k"))
    dealt = rows.where("t is not null").withColumn("chunk", F.explode(F.sequence(place(F.col("t")), place(F.col("t") + far))))
    # By an explicit number: the rows are narrow but cost Python time, so small partitions stay apart.
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(n, "s", "chunk").groupBy("s", "chunk").applyInArrow(run, schema)
    timeless = rows.where("t is null").select("id", F.col("s").alias("source"), F.col("t").alias("event_s"), F.explode(F.array(*(F.lit(w).cast("bigint") for w in windows))).alias("window_s"), *(F.lit(0).cast("bigint").alias(c) for c in names[4:7]), *(F.lit(None).cast("bigint").alias(c) for c in names[7:]))
    return out.unionByName(timeless)
