"""Exact top hits and exact ranks for batches of questions, without ordering a question's chunks.

Vector scores are blocked matrix products over the stored vectors: each task keeps its best hits of each
question, and only those meet. A rank is found by counting the chunks that come before, which is a sum.

Fusing two rankings needs only their beginnings. With scores 1 / (RRF + rank), the k best chunks have at
least 1 / (RRF + k), as those at the top of one ranking do; a chunk that neither ranking has among
its first RRF + 2 k has less. Of the candidates that are left, those that the other ranking has further
down can be ruled out by what it could add at most, and only the rest is counted.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from ..session import arrow_types, shared_folder, ship, stored
from .index import ChunkIndex, counted, placed
from .retrieval import MODES, RRF, small

#: Questions, and candidates to be counted, that go to the tasks at once; vectors that are multiplied at once.
BLOCK_QUESTIONS, BLOCK_CANDIDATES, BLOCK_VECTORS = 1000, 200_000, 2048
#: Pairs that leave a task in one batch.
BLOCK_PAIRS = 1 << 17


def _question_blocks(rows: DataFrame, blocks: int) -> Iterator[list]:
    for k in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == k).collect()
        if found:
            yield found


def _products(batches, matrix: np.ndarray, most: int = BLOCK_VECTORS) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray | None]]:
    """Ids, the rounded scores (questions x vectors) and labels, if any, of blocks of (chunk_id, vector, label) rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            b = whole.slice(at, most)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            yield b.column(0), np.round(matrix @ v.T, 6), b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else None


def vector_top(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(question_id, chunk_id, similarity, vector_rank) of each question's first ``depth`` chunks by
    similarity (6 decimals) and chunk id. questions: question_id, vector, depth; vectors: chunk_id, vector.
    Where both have a ``label``, only chunks of the question's label count, and not the question itself."""
    labelled = "label" in questions.columns and "label" in vectors.columns
    ship(questions.sparkSession)
    schema = f"question_id {dict(questions.dtypes)['question_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, similarity double, depth int"
    types = arrow_types(schema)
    size = questions.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    parts = []
    for rows in _question_blocks(questions.select("question_id", "vector", "depth", *["label"] * labelled), -(-size["n"] // BLOCK_QUESTIONS)):
        labels = np.array([r["label"] for r in rows]) if labelled else None
        ids, depths = [r["question_id"] for r in rows], [r["depth"] for r in rows]
        matrix = np.array([r["vector"] for r in rows], float)

        def run(batches, ids=ids, depths=depths, matrix=matrix, labels=labels):
            best: list[list[tuple]] = [[] for _ in ids]
            least = np.full(len(ids), -np.inf)
            for names, scores, own in _products(batches, matrix):
                names = names.to_pylist()
                if labels is not None:
                    scores[(labels[:, None] != own) | (np.array(ids)[:, None] == np.array(names))] = -np.inf
                for q in np.flatnonzero(scores.max(axis=1, initial=-np.inf) >= least).tolist():
                    at = np.flatnonzero((scores[q] >= least[q]) & np.isfinite(scores[q]))
                    best[q] = heapq.nsmallest(depths[q], [*best[q], *((-s, names[k]) for s, k in zip(scores[q, at].tolist(), at.tolist(), strict=True))])
                    if len(best[q]) == depths[q]:
                        least[q] = -best[q][-1][0]
            for q, found in enumerate(best):
                if found:
                    yield pa.RecordBatch.from_pylist([{"question_id": ids[q], "chunk_id": c, "similarity": -s, "depth": depths[q]} for s, c in found], types)

        parts.append(vectors.select("chunk_id", "vector", *["label"] * labelled).mapInArrow(run, schema))
    if not parts:
        return questions.sparkSession.createDataFrame([], schema.replace("depth", "vector_rank"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "chunk_id"))
    hits = reduce(DataFrame.unionByName, parts).withColumn("vector_rank", rank).where(F.col("vector_rank") <= size["deepest"])
    return hits.where("vector_rank <= depth").drop("depth")


def similarities(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(question_id, chunk_id, similarity) of all pairs (C10), to 6 decimals: a stated query set against all rows, in blocks."""
    spark = questions.sparkSession
    ship(spark)
    schema = f"question_id {dict(questions.dtypes)['question_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, similarity double"
    types = arrow_types(schema)
    parts = [spark.createDataFrame([], schema)]
    for rows in _question_blocks(questions.select("question_id", "vector"), -(-questions.count() // BLOCK_QUESTIONS)):
        ids, matrix = pa.array([r["question_id"] for r in rows], types.field(0).type), np.array([r["vector"] for r in rows], float)

        def run(batches, ids=ids, matrix=matrix):
            for names, scores, _ in _products(batches, matrix, max(BLOCK_PAIRS // len(ids), 1)):
                q, k = np.divmod(np.arange(scores.size), scores.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), names.take(pa.array(k)), pa.array(scores.ravel())], schema=types)

        parts.append(vectors.select("chunk_id", "vector").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def label_extremes(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(question_id, good, bad): the best similarity (6 decimals) of each question (question_id, vector, label) to another row
    of its own label and to one of another label (D17). Tasks keep two numbers of each question, so no pair is shuffled."""
    spark = questions.sparkSession
    ship(spark)
    schema = f"question_id {dict(questions.dtypes)['question_id']}, good double, bad double"
    types = arrow_types(schema)
    parts = [spark.createDataFrame([], schema)]
    known = questions.where("label is not null")
    for rows in _question_blocks(known.select("question_id", "vector", "label"), -(-known.count() // BLOCK_QUESTIONS)):
        ids, labels, matrix = [r["question_id"] for r in rows], np.array([r["label"] for r in rows]), np.array([r["vector"] for r in rows], float)

        def run(batches, ids=ids, labels=labels, matrix=matrix):
            best = np.full((2, len(ids)), -np.inf)
            for names, scores, own in _products(batches, matrix):
                scores[np.array(ids)[:, None] == names.to_numpy(zero_copy_only=False)] = -np.inf
                same = labels[:, None] == own
                for k, part in enumerate((same, ~same)):
                    best[k] = np.maximum(best[k], np.where(part, scores, -np.inf).max(axis=1, initial=-np.inf))
            good, bad = ([x if np.isfinite(x) else None for x in b.tolist()] for b in best)
            yield pa.RecordBatch.from_pydict({"question_id": ids, "good": good, "bad": bad}, types)

        parts.append(vectors.where("label is not null").select("chunk_id", "vector", "label").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts).groupBy("question_id").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))


def vector_ranks(candidates: DataFrame, questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """candidates (question_id, chunk_id, similarity) with ``vector_rank`` among all vectors, by counting."""
    ship(questions.sparkSession)
    sets = candidates.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("chunk_id").alias("c")))).alias("x"))
    sets = stored(sets.join(questions.select("question_id", "vector"), "question_id"), "rank-sets")
    size = sets.agg(F.count("*").alias("n"), F.sum(F.size("x")).alias("m")).first()
    blocks = max(-(-size["n"] // BLOCK_QUESTIONS), -(-(size["m"] or 0) // BLOCK_CANDIDATES))
    schema = f"question_id {dict(questions.dtypes)['question_id']}, place int, n bigint"
    types = arrow_types(schema)
    parts = [questions.sparkSession.createDataFrame([], schema)]
    for rows in _question_blocks(sets, blocks):
        ids, matrix = [r["question_id"] for r in rows], np.array([r["vector"] for r in rows], float)
        wanted, names = [np.array([-x["s"] for x in r["x"]]) for r in rows], [[x["c"] for x in r["x"]] for r in rows]

        def run(batches, ids=ids, matrix=matrix, wanted=wanted, names=names):
            counts = [np.zeros(len(w) + 1, np.int64) for w in wanted]
            for chunks, scores, _ in _products(batches, matrix):
                chunks = chunks.to_pylist()
                for q, w in enumerate(wanted):
                    at = np.flatnonzero(scores[q] >= w[-1])
                    counts[q] += placed(w, names[q], scores[q, at], [chunks[k] for k in at.tolist()])
            for q, c in enumerate(counts):
                at = np.flatnonzero(c[:-1])
                if len(at):
                    yield pa.RecordBatch.from_pydict({"question_id": [ids[q]] * len(at), "place": at.tolist(), "n": c[at].tolist()}, types)

        parts.append(vectors.select("chunk_id", "vector").mapInArrow(run, schema))
    return counted(candidates, reduce(DataFrame.unionByName, parts), "similarity", "vector_rank")


def _similarities(pairs: DataFrame, questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (question_id, chunk_id) with ``similarity``."""
    known = small(pairs).join(vectors.select("chunk_id", "vector"), "chunk_id").join(questions.select("question_id", F.col("vector").alias("q")), "question_id")
    return known.withColumn("similarity", F.round(vector.dot(F.col("q"), F.col("vector")), 6)).drop("vector", "q")


class Searcher:
    """Search over an index and the vectors of its chunks (L2, L3): the chunks of ``scope`` (chunk_id), or all.
    questions: question_id, question, vector; blank ones find nothing."""

    def __init__(self, index: ChunkIndex, vectors: DataFrame, questions: DataFrame, scope: DataFrame | None = None):
        self.questions = stored(questions.where(text.strip(F.col("question")) != "").select("question_id", "question", "vector"), "asked")
        self.view = index.view(self.questions, scope)
        self.vectors = vectors.select("chunk_id", "vector").join(self.view.live.select("chunk_id"), "chunk_id", "left_semi")

    def _completed(self, rows: DataFrame) -> DataFrame:
        """rows (question_id, chunk_id, similarity, vector_rank, bm25_score, bm25_rank) with what is null filled in."""
        key = ["question_id", "chunk_id"]
        rows = stored(rows.select(*key, "similarity", "vector_rank", "bm25_score", "bm25_rank"), "fused")
        far = stored(_similarities(rows.where("vector_rank is null").select(*key), self.questions, self.vectors), "far")
        far = vector_ranks(far, self.questions, self.vectors).toDF(*key, "s", "vr")
        weak = stored(self.view.scores(rows.where("bm25_rank is null").select(*key)), "weak")
        weak = self.view.ranks(weak).toDF(*key, "b", "br")
        out = rows.join(far, key, "left").join(weak, key, "left")
        fill = {"similarity": F.coalesce("similarity", "s"), "vector_rank": F.coalesce("vector_rank", "vr"), "bm25_score": F.coalesce("bm25_score", "b", F.lit(0.0)), "bm25_rank": F.coalesce("bm25_rank", "br")}
        return out.select(*key, *(c.alias(n) for n, c in fill.items()))

    def _fused(self, depth: DataFrame, least: DataFrame) -> DataFrame:
        """The chunks of each question that may be among its k best or have a fused score of ``floor`` at least, with
        all ranks known. ``depth`` (question_id, depth) says how much of the two rankings is read; least:
        question_id, k, floor, of which one is null."""
        asked = self.questions.join(depth, "question_id")
        near = vector_top(asked, self.vectors)
        rows = near.join(self.view.top(depth), ["question_id", "chunk_id"], "full_outer").join(depth, "question_id").join(least, "question_id")
        beyond = 1 / (RRF + F.col("depth") + 1)
        known = F.coalesce(1 / (RRF + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("bm25_rank")), F.lit(0.0))
        rows = rows.withColumn("known", known).withColumn("most", known + F.when(F.col("vector_rank").isNull() | F.col("bm25_rank").isNull(), beyond).otherwise(0.0))
        question = Window.partitionBy("question_id")
        rows = rows.withColumn("nth", F.row_number().over(question.orderBy(F.desc("known"))))
        kth = F.max(F.when(F.col("nth") == F.col("k"), F.col("known"))).over(question)
        rows = rows.withColumn("kth", F.coalesce("floor", kth, F.lit(0.0))).where("most >= kth - 1e-12")
        return _ranked(self._completed(rows), "hybrid")

    def search(self, top_k: int = 5, mode: str = "hybrid") -> DataFrame:
        """question_id, chunk_id, score, similarity, bm25_score, vector_rank, bm25_rank, rank of the best hits.
        Ties go by similarity, then by chunk id."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        depth = self.questions.select("question_id", F.lit(RRF + 2 * top_k if mode == "hybrid" else top_k).alias("depth"))
        if mode == "hybrid":
            rows = self._fused(depth, depth.select("question_id", F.lit(top_k).alias("k"), F.lit(None).cast("double").alias("floor")))
        elif mode == "vector":
            near = vector_top(self.questions.join(depth, "question_id"), self.vectors)
            rows = _ranked(self._completed(near.withColumns({"bm25_score": F.lit(None).cast("double"), "bm25_rank": F.lit(None).cast("int")})), mode)
        else:
            # Hits that score as the last one does go by similarity. Where there are too few, the nearest
            # of the others follow; among the first 2 k by similarity there are enough of them.
            key = ["question_id", "chunk_id"]
            hits = stored(self.view.top(depth, ties=True), "bm25-top")
            few = hits.groupBy("question_id").count().join(depth, "question_id", "right").where("coalesce(count, 0) < depth").select("question_id", (F.col("depth") * 2).alias("depth"))
            more = vector_top(self.questions.join(few, "question_id"), self.vectors).join(hits, key, "left_anti")
            tied = hits.join(_similarities(hits.select(*key), self.questions, self.vectors), key)
            both = tied.withColumn("vector_rank", F.lit(None).cast("int")).unionByName(more.withColumns({"bm25_score": F.lit(0.0), "bm25_rank": F.lit(None).cast("int")}))
            best = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bm25_score"), F.desc("similarity"), "chunk_id"))
            rows = _ranked(self._completed(both.withColumn("n", best).where(F.col("n") <= top_k)), mode)
        return rows.where(F.col("rank") <= top_k)

    def first_relevant(self, relevant: DataFrame) -> DataFrame:
        """(question_id, mode, first): the rank over all chunks of each question's first relevant one in each
        mode, null where none is (L5, E4). relevant: question_id, chunk_id."""
        key = ["question_id", "chunk_id"]
        relevant = stored(relevant.select(*key).distinct(), "relevant")  # read once: it may come from a scan of all texts
        sims = relevant.join(self.vectors, "chunk_id").join(self.questions.select("question_id", F.col("vector").alias("q")), "question_id")
        sims = sims.select(*key, F.round(vector.dot(F.col("q"), F.col("vector")), 6).alias("similarity"))
        sims = stored(sims, "relevant-similarities")
        nearest = sims.groupBy("question_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("chunk_id").alias("c"))).alias("x"))
        nearest = nearest.select("question_id", F.col("x.c").alias("chunk_id"), (-F.col("x.s")).alias("similarity"))
        near = stored(vector_ranks(nearest, self.questions, self.vectors), "nearest")
        # Fused: the nearest relevant chunk has at least 1 / (RRF + its rank), so deeper ones need not be read.
        n = self.view.n
        depth = near.select("question_id", F.least(F.col("vector_rank") * 2 + RRF, F.lit(n)).cast("int").alias("depth"))
        least = near.select("question_id", F.lit(None).cast("int").alias("k"), (1 / (RRF + F.col("vector_rank"))).alias("floor"))
        fused = self._fused(depth, least).join(relevant, key, "left_semi").groupBy("question_id").agg(F.min("rank").alias("first"))
        words = self._first_by_words(relevant, sims, near)
        every = [near.select("question_id", F.col("vector_rank").alias("first"), F.lit("vector").alias("mode")), fused.withColumn("mode", F.lit("hybrid")), words.withColumn("mode", F.lit("bm25"))]
        found = reduce(DataFrame.unionByName, every)
        modes = self.questions.select("question_id", F.explode(F.array(*map(F.lit, sorted(MODES)))).alias("mode"))
        return modes.join(found, ["question_id", "mode"], "left").select("question_id", "mode", "first")

    def _first_by_words(self, relevant: DataFrame, sims: DataFrame, near: DataFrame) -> DataFrame:
        """In bm25 mode chunks of equal score go by similarity, those without a common term last."""
        key = ["question_id", "chunk_id"]
        scored = self.view.scores(relevant).join(sims, key)
        best = scored.groupBy("question_id").agg(F.min(F.struct((-F.col("bm25_score")).alias("b"), (-F.col("similarity")).alias("s"), F.col("chunk_id").alias("c"))).alias("x"))
        best = stored(best.select("question_id", F.col("x.c").alias("chunk_id"), (-F.col("x.b")).alias("bm25_score"), (-F.col("x.s")).alias("similarity")), "best")
        # All hits up to the best relevant one and those that score as it does.
        ranks = self.view.ranks(best.select(*key, "bm25_score"))
        depth = ranks.select("question_id", F.col("bm25_rank").alias("depth"))
        top = self.view.top(depth, ties=True).join(best.select("question_id", F.col("chunk_id").alias("c"), F.col("bm25_score").alias("b"), F.col("similarity").alias("s")), "question_id")
        ahead = top.where("bm25_score > b").groupBy("question_id").count()
        tied = _similarities(top.where("bm25_score = b").select(*key), self.questions, self.vectors).join(best.select("question_id", F.col("chunk_id").alias("c"), F.col("similarity").alias("s")), "question_id")
        tied = tied.groupBy("question_id").agg(F.count_if((F.col("similarity") > F.col("s")) | ((F.col("similarity") == F.col("s")) & (F.col("chunk_id") < F.col("c")))).alias("level"))
        found = best.select("question_id").join(ahead, "question_id", "left").join(tied, "question_id", "left")
        found = found.select("question_id", (F.coalesce("count", F.lit(0)) + F.coalesce("level", F.lit(0)) + 1).cast("int").alias("first"))
        # No relevant chunk has a common term: behind all hits, the nearest relevant one among the rest.
        rest = near.join(best, "question_id", "left_anti")
        hits = self.view.top(rest.select("question_id", F.lit(self.view.n).cast("int").alias("depth")))
        sims = _similarities(hits.select(*key), self.questions, self.vectors).join(rest.select("question_id", F.col("chunk_id").alias("c"), F.col("similarity").alias("s")), "question_id")
        behind = sims.groupBy("question_id").agg(F.count_if((F.col("similarity") < F.col("s")) | ((F.col("similarity") == F.col("s")) & (F.col("chunk_id") > F.col("c")))).alias("behind"))
        rest = rest.join(behind, "question_id", "left").select("question_id", (F.col("vector_rank") + F.coalesce("behind", F.lit(0))).cast("int").alias("first"))
        return found.unionByName(rest)


def _ranked(rows: DataFrame, mode: str) -> DataFrame:
    score = {
        "hybrid": 1 / (RRF + F.col("vector_rank")) + F.coalesce(1 / (RRF + F.col("bm25_rank")), F.lit(0.0)),
        "vector": F.col("similarity"),
        "bm25": F.col("bm25_score"),
    }[mode]
    rows = rows.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("similarity"), "chunk_id"))
    return rows.withColumn("rank", rank).select("question_id", "chunk_id", "score", "similarity", "bm25_score", "vector_rank", "bm25_rank", "rank")


def search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, top_k: int = 5, mode: str = "hybrid") -> DataFrame:
    """Top hits in chunks (chunk_id, text) that have no index yet: one is made for them in the shared folder."""
    spark = questions.sparkSession
    index = ChunkIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", dict(chunks.dtypes)["chunk_id"])
    index.refresh(chunks)
    return Searcher(index, vectors, questions).search(top_k, mode)
