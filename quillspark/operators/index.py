"""A stored inverted index of chunks, and exact top hits by BM25 from its blocks.

The index is one table of posting blocks and one of tombstones, in a folder that all executors share.
A block is what one term has in one shard, a run of at most ``SHARD_CHUNKS`` chunks that were read
together: which chunks, how often, the greatest count and the least length. Refreshing compares chunk ids
and text hashes, reads the texts of new and changed chunks alone and appends them as a segment; what is
gone or replaced gets a tombstone. A search reads the blocks of its terms and no text. Statistics are
those of the scope that is searched, as if it had an index of its own.

Greatest count and least length bound what any chunk of a block can score, whatever the average
length. The shards with the highest bounds are scored first; the score that a question's last wanted
hit has there rules out all shards, and inside the others all terms, that cannot reach it.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship, stored
from .retrieval import K1, B, question_terms, small

#: Chunks of a shard at most, and files that terms are dealt to.
SHARD_CHUNKS, BUCKETS = 1024, 64
#: Questions that are scored together in a shard.
QUESTIONS = 1000
#: Segments beyond which a refresh merges them.
MOST_SEGMENTS = 16
#: Shards of each question that are scored first, and how far a score may lie below a threshold that was rounded.
FIRST, SLACK = 4, 2e-6


def placed(wanted: np.ndarray, wanted_ids: list, scores: np.ndarray, ids: list) -> np.ndarray:
    """How many rows (score, id) come before each candidate but after the one before it, in the order of
    falling scores and rising ids. Candidates are in that order; the last count is of rows behind all."""
    keys = -wanted
    lo, at = np.searchsorted(keys, -scores, "left"), np.searchsorted(keys, -scores, "right")
    for k in np.flatnonzero(lo < at).tolist():
        at[k] = bisect_right(wanted_ids, ids[k], int(lo[k]), int(at[k]))
    return np.bincount(at, minlength=len(wanted) + 1)


#: How a block holds which chunks of its shard have a term, and how often: numbers one after another, as one value of a row.
DOC, COUNT = np.dtype("<u2"), np.dtype("<i4")


def _packed(values: np.ndarray, ends: np.ndarray, kind: np.dtype) -> pa.Array:
    """Lists of numbers, of which number k stops before ``ends[k + 1]``, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.astype(kind).tobytes())])


def _unpacked(column: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary values without nulls, and their ends."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
    if not len(a):
        return np.empty(0, kind), np.zeros(1, np.int64)
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return raw.view(kind), (ends - ends[0]) // kind.itemsize


class ChunkIndex:
    """The index in a folder. Chunks are rows (chunk_id, text), with text_sha256 where it is known: an index
    that is up to date is then left without reading any text."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        ship(spark)

    # ------------------------------------------------------------------ tables

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def segments(self) -> list[str]:
        """The segments in use, oldest first. A segment counts once its row is written, so what a run that
        broke off has left is never read."""
        rows = self._table("segments", "segment string, seq int, merged boolean").collect()
        base = max((r["seq"] for r in rows if r["merged"]), default=0)
        return [r["segment"] for r in sorted(rows, key=lambda r: r["seq"]) if r["seq"] >= base]

    def blocks(self, segments: list[str]) -> DataFrame:
        """The rows of shards (bucket -1: ids, lengths and hashes of its chunks) and of terms."""
        schema = f"shard bigint, term string, docs binary, counts binary, most int, least int, ids array<{self.id_type}>, lengths array<int>, hashes array<string>, segment string, bucket int"
        return self._table("blocks", schema).where(F.col("segment").isin(segments))

    def chunks(self) -> DataFrame:
        """(segment, shard, doc, chunk_id, length, text_sha256) of the live chunks, without their texts."""
        segments = self.segments()
        rows = self.blocks(segments).where("bucket = -1").select("segment", "shard", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.size("ids") - 1).alias("doc"), "ids", "lengths", "hashes")))
        rows = rows.toDF("segment", "shard", "doc", "chunk_id", "length", "text_sha256")
        dead = self._table("dead", f"chunk_id {self.id_type}, segment string, at string").where(F.col("at").isin(segments))
        return rows.join(dead.select("chunk_id", "segment"), ["chunk_id", "segment"], "left_anti")

    # ------------------------------------------------------------------ refreshing

    def refresh(self, chunks: DataFrame) -> int:
        """Bring the index to the state of ``chunks`` (of equal ids one row counts); the number of chunks that
        were added, replaced or removed."""
        known = "text_sha256" in chunks.columns
        now = chunks.select("chunk_id", (F.col("text_sha256") if known else F.sha2("text", 256)).alias("now")).dropDuplicates(["chunk_id"])
        segments = self.segments()
        diff = now.withColumn("here", F.lit(True)).join(self.chunks().select("chunk_id", "segment", "text_sha256"), "chunk_id", "full_outer")
        same = F.col("here").isNotNull() & F.col("segment").isNotNull() & F.col("now").eqNullSafe(F.col("text_sha256"))
        diff = stored(diff.where(~same).select("chunk_id", F.col("here").isNotNull().alias("fresh"), "segment"), "index-diff")
        n = diff.agg(F.count("*").alias("all"), F.count_if("fresh").alias("fresh"), F.count("segment").alias("dead")).first()
        if not n["all"]:
            return 0
        name = f"s{uuid.uuid4().hex}"
        rows = chunks.select("chunk_id", "text", *(["text_sha256"] if known else []))
        if segments:
            rows = rows.join(small(diff.where("fresh").select("chunk_id"), n["fresh"]), "chunk_id", "left_semi")
        if n["fresh"]:
            if not rows.groupBy("chunk_id").count().where("count > 1").isEmpty():
                rows = rows.dropDuplicates(["chunk_id"])
            digest = F.col("text_sha256") if known else F.sha2("text", 256)
            self._append(self._made(rows.select("chunk_id", text.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"), digest.alias("hash"))), name)
        if n["dead"]:
            diff.where("segment is not null").select("chunk_id", "segment", F.lit(name).alias("at")).write.mode("append").parquet(f"{self.path}/dead")
        self._commit(name, False)
        if len(segments) >= MOST_SEGMENTS:
            self.merge()
        return n["all"]

    def _made(self, rows: DataFrame) -> DataFrame:
        """Shards and blocks of rows (chunk_id, tokens, hash): each task turns the batches that it reads into
        shards, so nothing is shuffled for it."""
        names = ["shard", "bucket", "term", "docs", "counts", "most", "least", "ids", "lengths", "hashes"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), None, pa.list_(pa.int32()), pa.list_(pa.string())]

        def run(batches):
            shard = TaskContext.get().partitionId() << 32
            for whole in batches:
                for start in range(0, whole.num_rows, SHARD_CHUNKS):
                    b = whole.slice(start, SHARD_CHUNKS)
                    tokens = b.column(1)
                    lengths = pc.list_value_length(tokens).to_numpy()
                    words = tokens.flatten().dictionary_encode()
                    doc = np.repeat(np.arange(len(lengths)), lengths)
                    pair, counts = np.unique(words.indices.to_numpy().astype(np.int64) * len(lengths) + doc, return_counts=True)
                    code, doc = np.divmod(pair, len(lengths))
                    first = np.flatnonzero(np.diff(code, prepend=-1))
                    ends = np.append(first, len(code))
                    most = np.maximum.reduceat(counts, first) if len(first) else first
                    least = np.minimum.reduceat(lengths[doc], first) if len(first) else first
                    m = len(first)
                    ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                    hashes = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(2))
                    kinds[7] = ids.type
                    yield pa.record_batch([pa.array([shard]), pa.array([-1], pa.int32()), pa.nulls(1, kinds[2]), *(pa.nulls(1, k) for k in kinds[3:7]), ids, pa.array([lengths.tolist()], kinds[8]), hashes], names=names)
                    terms = words.dictionary.take(pa.array(code[first]))
                    made = [_packed(doc, ends, DOC), _packed(counts, ends, COUNT)]
                    yield pa.record_batch([pa.array([shard] * m, pa.int64()), pa.nulls(m, pa.int32()), terms, *made, pa.array(most, pa.int32()), pa.array(least, pa.int32()), *(pa.nulls(m, k) for k in kinds[7:])], names=names)
                    shard += 1

        schema = f"shard bigint, bucket int, term string, docs binary, counts binary, most int, least int, ids array<{self.id_type}>, lengths array<int>, hashes array<string>"
        return rows.mapInArrow(run, schema)

    def _append(self, blocks: DataFrame, name: str) -> None:
        out = blocks.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))).withColumn("segment", F.lit(name))
        out.hint("rebalance", "bucket").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/blocks")

    def _commit(self, name: str, merged: bool) -> None:
        seq = self._table("segments", "segment string, seq int, merged boolean").agg(F.max("seq")).first()[0] or 0
        self.spark.createDataFrame([(name, seq + 1, merged)], "segment string, seq int, merged boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def merge(self) -> None:
        """Make one segment of all, without tombstones and without reading texts."""
        segments, name, live = self.segments(), f"s{uuid.uuid4().hex}", self.chunks()
        home = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-live.count() // SHARD_CHUNKS))))
        moved = live.withColumn("home", home)
        moved = stored(moved.withColumn("to", (F.row_number().over(Window.partitionBy("home").orderBy("chunk_id")) - 1).cast("int")), "index-merge")
        heads = moved.groupBy("home").agg(F.array_sort(F.collect_list(F.struct("to", "chunk_id", "length", "text_sha256"))).alias("x"))
        heads = heads.select(F.col("home").alias("shard"), F.lit(-1).alias("bucket"), F.col("x.chunk_id").alias("ids"), F.col("x.length").alias("lengths"), F.col("x.text_sha256").alias("hashes"))
        rows = self.blocks(segments).where("bucket >= 0").select("segment", "shard", "term", "docs", "counts").mapInArrow(_entries, "segment string, shard bigint, term string, doc int, n int")
        rows = rows.join(moved.select("segment", "shard", "doc", "home", "to", "length"), ["segment", "shard", "doc"])
        rows = rows.groupBy("home", "term").agg(F.array_sort(F.collect_list(F.struct("to", "n"))).alias("x"), F.max("n").alias("most"), F.min("length").alias("least"))
        rows = rows.select(F.col("home").alias("shard"), F.lit(None).cast("int").alias("bucket"), "term", F.arrow_udf(_pack_docs, "binary")("x.to").alias("docs"), F.arrow_udf(_pack_counts, "binary")("x.n").alias("counts"), "most", "least")
        self._append(heads.unionByName(rows, allowMissingColumns=True), name)
        self._commit(name, True)

    # ------------------------------------------------------------------ searching

    def view(self, questions: DataFrame, scope: DataFrame | None = None, k1: float = K1, b: float = B) -> View:
        """What questions (question_id, question) need of the live chunks, or of those of ``scope`` (chunk_id)."""
        return View(self, questions, scope, k1, b)


def _entries(batches):
    """One row for each chunk of each block."""
    for b in batches:
        t = pa.table(b)
        (docs, ends), (counts, _) = _unpacked(t["docs"], DOC), _unpacked(t["counts"], COUNT)
        rows = t.select(["segment", "shard", "term"]).take(pa.array(np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
        yield from rows.append_column("doc", pa.array(docs.astype(np.int32))).append_column("n", pa.array(counts.astype(np.int32))).combine_chunks().to_batches()


def _pack_docs(lists: pa.Array) -> pa.Array:
    return _pack(lists, DOC)


def _pack_counts(lists: pa.Array) -> pa.Array:
    return _pack(lists, COUNT)


def _pack(lists: pa.Array, kind: np.dtype) -> pa.Array:
    sizes = pc.list_value_length(lists).to_numpy()
    return _packed(lists.flatten().to_numpy(), np.append(0, np.cumsum(sizes)), kind)


class View:
    """The blocks of the asked terms in a scope, written once, with the scope's statistics."""

    def __init__(self, index: ChunkIndex, questions: DataFrame, scope: DataFrame | None, k1: float, b: float):
        self.index, self.k1, self.b = index, k1, b
        live = index.chunks()
        live = live if scope is None else live.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi")
        self.live = stored(live.drop("text_sha256"), "view-chunks")
        stats = self.live.agg(F.count("*").alias("n"), F.avg("length").alias("a")).first()
        self.n, self.average = stats["n"], stats["a"] or 1.0
        terms = stored(question_terms(questions), "view-terms")
        wanted = terms.select("term").distinct()
        hit = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        asked = index.blocks(index.segments()).where(F.col("bucket").isin(hit)).select("segment", "shard", "term", "docs", "counts", "most", "least")
        asked = asked.join(small(wanted), "term", "left_semi")
        heads = self.live.groupBy("segment", "shard").agg(F.array_sort(F.collect_list(F.struct("doc", "chunk_id", "length"))).alias("x"))
        heads = heads.select("segment", "shard", F.col("x.doc").alias("here"), F.col("x.chunk_id").alias("ids"), F.col("x.length").alias("lengths"))
        self.blocks = stored(self._in_scope(asked, heads), "view-blocks")
        df = self.blocks.where("term is not null").groupBy("term").agg(F.sum(F.expr(f"length(docs) div {DOC.itemsize}")).alias("df"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        groups = max(1, -(-questions.count() // QUESTIONS))
        terms = terms.join(df, "term").select("question_id", F.pmod(F.xxhash64("question_id"), F.lit(groups)).cast("int").alias("part"), "term", idf.alias("idf"))
        bound = F.col("idf") * F.col("most") * (k1 + 1) / (F.col("most") + k1 * (1 - b + b * F.col("least") / self.average))
        pairs = self.blocks.where("term is not null").select("segment", "shard", "term", "most", "least").join(terms, "term")
        pairs = pairs.groupBy("question_id", "part", "segment", "shard").agg(F.sum(bound).alias("bound"), F.collect_list(F.struct("term", "idf")).alias("terms"))
        #: One row for each question and shard that has any of its terms.
        self.pairs = stored(pairs, "view-pairs")

    def _in_scope(self, asked: DataFrame, heads: DataFrame) -> DataFrame:
        """The blocks without the chunks that are dead or outside the scope, and the shards' own rows."""
        id_type = self.index.id_type
        both = asked.unionByName(heads, allowMissingColumns=True)

        def run(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            head = t.filter(pc.is_null(t["term"]))
            t = t.filter(pc.is_valid(t["term"]))
            if not head.num_rows:
                return t.slice(0, 0)
            here = head["here"].combine_chunks().flatten().to_numpy()
            (docs, ends), (counts, _) = _unpacked(t["docs"], DOC), _unpacked(t["counts"], COUNT)
            known = np.isin(docs, here)
            if not known.all():
                ends = np.append(0, np.cumsum(known))[ends]
                for name, values, kind in (("docs", docs, DOC), ("counts", counts, COUNT)):
                    t = t.set_column(t.schema.get_field_index(name), name, _packed(values[known], ends, kind))
                t = t.filter(pa.array(np.diff(ends) > 0))
            return pa.concat_tables([head, t.cast(head.schema)])

        schema = f"term string, segment string, shard bigint, docs binary, counts binary, most int, least int, here array<int>, ids array<{id_type}>, lengths array<int>"
        both = both.select("term", "segment", "shard", "docs", "counts", "most", "least", "here", "ids", "lengths")
        return both.groupBy("segment", "shard").applyInArrow(run, schema)

    def _score(self, pairs: DataFrame, how: str) -> DataFrame:
        """(question_id, chunk_id, score, place, n) of pairs with their columns: ``top``: the hits that may be
        among the first ``depth`` at or above ``floor``, ties included; ``count``: how many chunks come before each of the
        candidates (c_scores, c_ids); ``some``: the scores of the chunks c_ids."""
        k1, b, average = self.k1, self.b, self.average
        q_type = dict(pairs.dtypes)["question_id"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple[list, list, list, list, list]] = []
            head = left.filter(pc.is_null(left["term"]))
            docs_here = head["here"].combine_chunks().flatten().to_numpy()
            ids = head["ids"].combine_chunks().flatten()
            lengths = head["lengths"].combine_chunks().flatten().to_numpy()
            slot = np.full(int(docs_here.max()) + 1, -1)
            slot[docs_here] = np.arange(len(docs_here))
            norm = k1 * (1 - b + b * lengths / average)
            own = left.filter(pc.is_valid(left["term"]))
            (docs, ends), (counts, _) = _unpacked(own["docs"], DOC), _unpacked(own["counts"], COUNT)
            places, most, least = slot[docs], own["most"].to_numpy(), own["least"].to_numpy()
            weights = counts * (k1 + 1) / (counts + norm[places])
            highest = most * (k1 + 1) / (most + k1 * (1 - b + b * least / average))
            blocks = {term: (places[i:j], weights[i:j], top) for term, i, j, top in zip(own["term"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), highest.tolist(), strict=True)}
            names = ids.to_pylist()
            order = np.empty(len(names), np.int64)
            order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(names))
            for r in right.to_pylist():
                floor = r["floor"] - SLACK
                terms = sorted(((x["idf"] * blocks[x["term"]][2], x["idf"], x["term"]) for x in r["terms"]), reverse=True)
                rest = np.cumsum([x[0] for x in terms][::-1])[::-1]  # the most that this term and all behind it can add
                score, live = np.zeros(len(names)), None
                for (_, idf, term), left_over in zip(terms, rest.tolist(), strict=True):
                    at, weight, _ = blocks[term]
                    if left_over < floor:  # only chunks that have scored before can still reach the floor
                        live = score + left_over >= floor if live is None else live & (score + left_over >= floor)
                        if not live.any():
                            break
                        on = live[at]
                        at, weight = at[on], weight[on]
                    score[at] += idf * weight
                score = np.round(score, 6)
                q = r["question_id"]
                if how == "some":
                    pick = np.flatnonzero(np.isin(ids.to_numpy(zero_copy_only=False), r["c_ids"]))
                else:
                    pick = np.flatnonzero((score > 0) & (score >= r["floor"]))
                if how == "count":
                    n = placed(np.array(r["c_scores"]), r["c_ids"], score[pick], [names[k] for k in pick.tolist()])[:-1]
                    at = np.flatnonzero(n)
                    out.append(([q] * len(at), [None] * len(at), [None] * len(at), at.tolist(), n[at].tolist()))
                    continue
                if how == "top" and len(pick) > r["depth"]:
                    pick = pick[score[pick] >= np.partition(score[pick], -r["depth"])[-r["depth"]]]
                    if not r["ties"]:
                        pick = pick[np.lexsort((order[pick], -score[pick]))][: r["depth"]]
                out.append(([q] * len(pick), [names[k] for k in pick.tolist()], score[pick].tolist(), [None] * len(pick), [None] * len(pick)))
            cols = [[x for part in out for x in part[k]] for k in range(5)]
            kinds = (right.schema.field("question_id").type, ids.type, pa.float64(), pa.int32(), pa.int64())
            return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["question_id", "chunk_id", "score", "place", "n"])

        need = pairs.select("segment", "shard", "part", F.explode("terms.term").alias("term")).distinct()
        left = self.blocks.join(need, ["segment", "shard", "term"]).unionByName(self.blocks.where("term is null").join(pairs.select("segment", "shard", "part").distinct(), ["segment", "shard"]))
        key = ["segment", "shard", "part"]
        pairs = pairs.select(*(F.col(c).alias(c) for c in pairs.columns))  # columns of its own: both sides come from one table
        schema = f"question_id {q_type}, chunk_id {self.index.id_type}, score double, place int, n bigint"
        return left.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInArrow(run, schema)

    def top(self, depth: DataFrame, ties: bool = False) -> DataFrame:
        """(question_id, chunk_id, bm25_score, bm25_rank) of each question's first ``depth`` hits by score and chunk
        id; depth: question_id, depth. With ``ties`` also the hits that score as the last one does."""
        depth = depth.select("question_id", "depth")
        deepest = depth.agg(F.max("depth")).first()[0] or 0
        pairs = self.pairs.join(depth, "question_id").withColumn("ties", F.lit(ties))
        nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bound"), "segment", "shard"))
        pairs = stored(pairs.withColumn("nth", nth), "view-order")
        first = stored(self._score(pairs.where(F.col("nth") <= FIRST).withColumn("floor", F.lit(0.0)), "top"), "view-first")
        at = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
        floors = first.join(depth, "question_id").withColumn("at", at).where((F.col("at") <= deepest) & (F.col("at") == F.col("depth"))).select("question_id", F.col("score").alias("floor"))
        rest = pairs.where(F.col("nth") > FIRST).join(floors, "question_id", "left").fillna({"floor": 0.0}).where(F.col("bound") >= F.col("floor") - SLACK)
        hits = first.unionByName(self._score(rest, "top")).select("question_id", "chunk_id", F.col("score").alias("bm25_score"))
        order = Window.partitionBy("question_id").orderBy(F.desc("bm25_score"), "chunk_id")
        if ties:  # a rank, not a number, keeps the equals of the last hit
            tied = F.rank().over(Window.partitionBy("question_id").orderBy(F.desc("bm25_score")))
            hits = hits.withColumn("tied", tied).where(F.col("tied") <= deepest).join(depth, "question_id").where("tied <= depth")
            return hits.select("question_id", "chunk_id", "bm25_score", F.row_number().over(order).alias("bm25_rank"))
        hits = hits.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= deepest).join(depth, "question_id").where("bm25_rank <= depth")
        return hits.select("question_id", "chunk_id", "bm25_score", "bm25_rank")

    def scores(self, candidates: DataFrame) -> DataFrame:
        """(question_id, chunk_id, bm25_score) of the candidates (question_id, chunk_id) with a common term."""
        at = candidates.join(self.live.select("chunk_id", "segment", "shard"), "chunk_id").groupBy("question_id", "segment", "shard").agg(F.collect_list("chunk_id").alias("c_ids"))
        rows = self._score(self.pairs.join(at, ["question_id", "segment", "shard"]).withColumn("floor", F.lit(0.0)), "some")
        return rows.where("score > 0").select("question_id", "chunk_id", F.col("score").alias("bm25_score"))

    def ranks(self, candidates: DataFrame) -> DataFrame:
        """candidates (question_id, chunk_id, bm25_score > 0) with ``bm25_rank`` among all chunks, by counting those
        that come before: a sum, without ordering the chunks."""
        sets = candidates.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("bm25_score")).alias("s"), F.col("chunk_id").alias("c")))).alias("x"))
        sets = sets.select("question_id", F.transform("x.s", lambda s: -s).alias("c_scores"), F.col("x.c").alias("c_ids"), F.array_min(F.transform("x.s", lambda s: -s)).alias("floor"))
        rows = self._score(self.pairs.join(sets, "question_id").where(F.col("bound") >= F.col("floor") - SLACK), "count")
        return counted(candidates, rows, "bm25_score", "bm25_rank")


def counted(candidates: DataFrame, rows: DataFrame, score: str, rank: str) -> DataFrame:
    """candidates with their rank, from counts (question_id, place, n) of the rows before each of them."""
    per = rows.groupBy("question_id", "place").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("question_id").orderBy(F.desc(score), "chunk_id")
    out = candidates.withColumn("place", F.row_number().over(order) - 1).join(per, ["question_id", "place"], "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("question_id").orderBy("place"))
    return out.withColumn(rank, (before + 1).cast("int")).drop("place", "n")
