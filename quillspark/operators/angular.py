"""Exact range join on the unit sphere: the stored vectors within an angle of each asked one.

Pivots divide the sphere into cells, each vector belonging to the nearest pivot, and the angle to it
divides a cell into rings. By the triangle inequality a vector within the angle of an asked one lies
in cells and rings near it, so only those tiles meet. Inside a tile the vectors are seen in
the directions of most variance first: what these add up to and the lengths of what is left bound the
product, and only pairs whose bound reaches the threshold are multiplied out. Both bounds hold for any
pivots and directions, which come from a bounded sample; they decide the cost and never the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_types, ship, stored

#: Stored vectors that pivots and directions are taken from, and their numbers.
SAMPLE, PIVOTS, PART = 2000, 32, 0.25
#: Stored and asked vectors of a tile at most, on average: larger tiles are dealt out in pieces.
TILE = 20_000
#: Rows that are multiplied at once.
BLOCK = 2048
#: Share of a block's pairs from which on it is multiplied whole, which is cheaper than pair by pair.
DENSE = 0.02
DIGITS, EPS = 6, 1e-6


def _matrix(column, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.empty((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


class Layout:
    """Pivots and directions of most variance, from a sample of the stored vectors."""

    def __init__(self, sample: np.ndarray, threshold: float):
        sample = _unit(sample)
        chosen, nearest = [0], sample @ sample[0]
        while len(chosen) < min(PIVOTS, len(sample)):  # each the farthest from those before
            k = int(nearest.argmin())
            chosen.append(k)
            nearest = np.maximum(nearest, sample @ sample[k])
        self.pivots = sample[chosen]
        self.angle = math.acos(max(-1.0, min(1.0, threshold))) + EPS
        self.directions = np.linalg.svd(sample.T, full_matrices=True)[0]
        self.head = max(1, round(PART * sample.shape[1]))

    def angles(self, m: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(m) @ self.pivots.T, -1, 1))

    def cells(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.angles(m)
        cell = a.argmin(axis=1)
        return cell, (a[np.arange(len(a)), cell] / self.angle).astype(int)

    def reached(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, ring) of all tiles that may hold vectors within the angle of each row."""
        a = self.angles(m)
        most = a.min(axis=1, keepdims=True) + self.angle  # a vector within the angle is this near to its own pivot
        first = np.maximum(0, ((a - self.angle - EPS) / self.angle)).astype(int)
        last = (np.minimum(a + self.angle, most) / self.angle + EPS).astype(int)
        rows, cells = np.nonzero(last >= first)
        n = (last - first)[rows, cells] + 1
        ring = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows, cells], n)
        return np.repeat(rows, n), np.repeat(cells, n), ring


def angular_join(vectors: DataFrame, queries: DataFrame, threshold: float, top: int, counts: bool = False) -> DataFrame:
    """(query_id, id, score) of the stored vectors whose product with a query, rounded to 6 decimals, is at least
    ``threshold``; per tile the ``top`` first by score and id, so that the first ``top`` of a query are among
    them. vectors: id, vector, scope; queries: query_id, vector, scope; a query with a non-empty scope sees the
    vectors of that scope alone. Vectors are of unit length; null vectors match nothing. With ``counts``:
    one row (met, computed) for each tile, the pairs that met and those that the bounds left to be multiplied out."""
    spark = vectors.sparkSession
    ship(spark)
    vectors, queries = vectors.where("vector is not null"), queries.where("vector is not null")
    sample = [r["vector"] for r in vectors.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    id_type, q_type = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    schema = "met bigint, computed bigint" if counts else f"query_id {q_type}, id {id_type}, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    least = threshold - 0.5 * 10**-DIGITS - 1e-12
    layout = Layout(np.array(sample, float), least)

    def cells(batches):
        for b in batches:
            if b.num_rows:
                cell, ring = layout.cells(_matrix(pa.chunked_array([b.column(1)]), b.num_rows))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(ring, pa.int32())], names=["id", "vector", "scope", "cell", "ring"])

    def reached(batches):
        for b in batches:
            if b.num_rows:
                row, cell, ring = layout.reached(_matrix(pa.chunked_array([b.column(1)]), b.num_rows))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(cell, pa.int32()), pa.array(ring, pa.int32())], names=["query_id", "vector", "scope", "cell", "ring"])

    v = dict(vectors.dtypes)["vector"], dict(queries.dtypes)["vector"]
    left = stored(vectors.select("id", "vector", F.col("scope").cast("string")).mapInArrow(cells, f"id {id_type}, vector {v[0]}, scope string, cell int, ring int"), "angular-vectors")
    # A query row is repeated for each tile that it reaches, so only tiles that hold vectors are kept.
    tile = ["cell", "ring"]
    held = left.groupBy(*tile).agg(F.count("*").alias("held"))
    right = queries.select("query_id", "vector", F.col("scope").cast("string")).mapInArrow(reached, f"query_id {q_type}, vector {v[1]}, scope string, cell int, ring int")
    right = stored(right.join(F.broadcast(held), tile), "angular-queries")  # at most PIVOTS times the rings of a half turn
    asked = right.groupBy(*tile, "held").agg(F.count("*").alias("asked"))
    pieces = asked.select(*tile, *(F.ceil(F.col(c) / TILE).cast("int").alias(c) for c in ("held", "asked")))

    def dealt(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """Each row in one piece of its own side and in all pieces of the other."""
        rows = rows.drop("held").join(F.broadcast(pieces), tile)
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        return rows.withColumn(f"{own}_piece", mine).withColumn(f"{other}_piece", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    types = arrow_types(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return types.empty_table()
        m, q = _matrix(a["vector"], a.num_rows), _matrix(b["vector"], b.num_rows)
        turned, asked_for = m @ layout.directions, q @ layout.directions
        k = layout.head
        tail, asked_tail = np.linalg.norm(turned[:, k:], axis=1), np.linalg.norm(asked_for[:, k:], axis=1)
        names, scope = a["id"].to_pylist(), np.array(a["scope"].to_pylist(), object)
        ids, wanted = b["query_id"].to_pylist(), [s or None for s in b["scope"].to_pylist()]
        computed, best = 0, [[] for _ in ids]
        own, any_scope = np.array(wanted, object), np.array([w is None for w in wanted], bool)
        floor = np.full(len(ids), threshold)  # what a query's hits have at least; the score of its last one once it has all
        for i in range(0, len(names), BLOCK):
            for j in range(0, len(ids), BLOCK):
                bound = turned[i : i + BLOCK, :k] @ asked_for[j : j + BLOCK, :k].T + np.outer(tail[i : i + BLOCK], asked_tail[j : j + BLOCK])
                least_of = floor[j : j + BLOCK]
                kept = bound >= least_of - 0.5 * 10**-DIGITS - 1e-9
                if not any_scope[j : j + BLOCK].all():
                    kept &= any_scope[j : j + BLOCK] | (scope[i : i + BLOCK, None] == own[j : j + BLOCK])
                computed += np.count_nonzero(kept)
                if kept.mean() <= DENSE:
                    x, y = np.nonzero(kept)
                    score = np.round(np.einsum("ij,ij->i", m[x + i], q[y + j]), DIGITS)
                else:
                    whole = np.where(kept, np.round(m[i : i + BLOCK] @ q[j : j + BLOCK].T, DIGITS), -np.inf)
                    if not counts and len(whole) > top and np.count_nonzero(whole >= least_of) > 8 * top * len(least_of):
                        # Scores below the block's own last place of a query can't be among its first.
                        least_of = np.maximum(least_of, np.partition(whole, len(whole) - top, axis=0)[len(whole) - top])
                    x, y = np.nonzero(whole >= least_of)
                    score = whole[x, y]
                near = score >= least_of[y]
                for s, n, p in zip(score[near].tolist(), (x[near] + i).tolist(), (y[near] + j).tolist(), strict=True):
                    best[p].append((-s, names[n]))
                for p in () if counts else np.unique(y[near] + j).tolist():
                    if len(best[p]) >= top:
                        best[p] = sorted(best[p])[:top]
                        floor[p] = max(threshold, -best[p][-1][0])
        if counts:
            return pa.Table.from_pydict({"met": [len(names) * len(ids)], "computed": [int(computed)]}, types)
        found = [(q_id, n, -s) for q_id, p in zip(ids, best, strict=True) for s, n in p]
        return pa.Table.from_pydict({f.name: [r[c] for r in found] for c, f in enumerate(types)}, types)

    key = [*tile, "held_piece", "asked_piece"]
    stored_side = dealt(left, "held", "asked", "id").select("id", "vector", "scope", *key)
    asked_side = dealt(right, "asked", "held", "query_id").select("query_id", "vector", "scope", *(F.col(c).alias(c) for c in key))
    return stored_side.groupBy(*key).cogroup(asked_side.groupBy(*key)).applyInArrow(run, schema)
