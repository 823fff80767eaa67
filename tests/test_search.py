"""The stored index, exact top hits and ranks, and the angular join, against plain versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import STOPWORDS
from quillspark.operators import index as ix
from quillspark.operators import topk
from quillspark.operators.angular import angular_join

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def tokens(text):
    return [w for w in re.findall(r"\w+", (text or "").lower()) if w not in STOPWORDS]


def plain_bm25(chunks, question, k1=1.5, b=0.75):
    toks = {c: tokens(t) for c, t in chunks.items()}
    average = sum(map(len, toks.values())) / max(1, len(toks)) or 1
    out = dict.fromkeys(chunks, 0.0)
    for term in set(tokens(question)):
        df = sum(term in t for t in toks.values())
        idf = math.log(1 + (len(toks) - df + 0.5) / (df + 0.5))
        for c, t in toks.items():
            tf = t.count(term)
            out[c] += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / average)) if tf else 0
    return {c: round(s, 6) for c, s in out.items()}


def plain_ranks(chunks, vectors, question, q_vector):
    """{mode: chunks in order}, and the parts of the scores."""
    sim = {c: round(float(np.dot(vectors[c], q_vector)), 6) for c in chunks}
    bm = plain_bm25(chunks, question)
    vr = {c: k for k, c in enumerate(sorted(chunks, key=lambda c: (-sim[c], c)), 1)}
    br = {c: k for k, c in enumerate(sorted((c for c in chunks if bm[c] > 0), key=lambda c: (-bm[c], c)), 1)}
    fused = {c: 1 / (60 + vr[c]) + (1 / (60 + br[c]) if c in br else 0) for c in chunks}
    order = {m: sorted(chunks, key=lambda c, s=s: (-s[c], -sim[c], c)) for m, s in (("vector", sim), ("bm25", bm), ("hybrid", fused))}
    return order, {c: (sim[c], bm[c], vr[c], br.get(c)) for c in chunks}


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(ix, "SHARD_CHUNKS", 7)
    monkeypatch.setattr(ix, "QUESTIONS", 3)


def corpus(rng, n):
    chunks = {f"c{i:03}": " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randrange(12))) for i in range(n)}
    chunks |= {f"d{i}": chunks["c001"] for i in range(9)} | {"e": None, "f": ""}  # copies, and texts without words
    return chunks


def frame(spark, chunks, **extra):
    return spark.createDataFrame(list(chunks.items()), "chunk_id string, text string").repartition(3)


def test_search_equals_the_plain_ranking(spark, tmp_path, small_shards):
    rng = random.Random(4)
    chunks = corpus(rng, 150)
    vectors = {c: [float(rng.randrange(-2, 3)) for _ in range(3)] for c in chunks}
    questions = [(k, " ".join(rng.sample(WORDS, k % 4 + 1)), [float(rng.randrange(-2, 3)) for _ in range(3)]) for k in range(7)] + [(90, "unknown words", [1.0, 0.0, 0.0]), (91, "  ", [1.0, 0.0, 0.0]), (92, "mu", [0.0, 1.0, 0.0])]
    index = ix.ChunkIndex(spark, f"file://{tmp_path}/index", "string")
    index.refresh(frame(spark, chunks))
    v = spark.createDataFrame(list(vectors.items()), "chunk_id string, vector array<double>")
    q = spark.createDataFrame(questions, "question_id int, question string, vector array<double>")
    scope = sorted(chunks)[::3]
    for inside in (None, spark.createDataFrame([(c,) for c in scope] * 2, "chunk_id string")):
        searcher = topk.Searcher(index, v, q, inside)
        seen = chunks if inside is None else {c: chunks[c] for c in scope}
        plain = {k: plain_ranks(seen, vectors, text, vec) for k, text, vec in questions if text.strip()}
        for mode in ("hybrid", "vector", "bm25"):
            got = {}
            for r in searcher.search(5, mode).collect():
                got.setdefault(r["question_id"], []).append(r)
            assert set(got) == set(plain)
            for k, (order, parts) in plain.items():
                rows = sorted(got[k], key=lambda r: r["rank"])
                assert [r["chunk_id"] for r in rows] == order[mode][:5], (mode, k)
                assert [(r["similarity"], r["bm25_score"], r["vector_rank"], r["bm25_rank"]) for r in rows] == [parts[c] for c in order[mode][:5]]
        relevant = [(k, c) for k in plain for c in seen if rng.random() < 0.03] + [(90, "d3")]
        first = searcher.first_relevant(spark.createDataFrame(relevant, "question_id int, chunk_id string")).collect()
        for r in first:
            want = [p for p, c in enumerate(plain[r["question_id"]][0][r["mode"]], 1) if (r["question_id"], c) in relevant]
            assert r["first"] == (want[0] if want else None), r
        assert len(first) == 3 * len(plain)
    with pytest.raises(ValueError, match="mode"):
        searcher.search(mode="other")


def hits(index, spark, question="alpha mu beta"):
    q = spark.createDataFrame([(1, question)], "question_id int, question string")
    return [(r["chunk_id"], r["bm25_score"]) for r in sorted(index.view(q).top(q.select("question_id", F.lit(500).alias("depth"))).collect(), key=lambda r: r["bm25_rank"])]


def wanted(chunks, question="alpha mu beta"):
    return sorted(((c, s) for c, s in plain_bm25(chunks, question).items() if s > 0), key=lambda x: (-x[1], x[0]))


def test_refresh_reads_what_has_changed_alone(spark, tmp_path, small_shards, monkeypatch):
    rng = random.Random(5)
    chunks = corpus(rng, 60)
    index = ix.ChunkIndex(spark, f"file://{tmp_path}/index", "string")

    def refresh(readable):
        unread = F.when(F.col("chunk_id").isin(readable), F.col("text")).otherwise(F.raise_error(F.lit("a text was read")).cast("string"))
        known = spark.createDataFrame([(c, t, str(hash(t))) for c, t in chunks.items()], "chunk_id string, text string, text_sha256 string").repartition(3)
        return index.refresh(known.withColumn("text", unread))

    assert hits(index, spark) == []  # an empty index
    assert refresh(list(chunks)) == len(chunks) and hits(index, spark) == wanted(chunks)
    assert refresh([]) == 0
    monkeypatch.setattr(ix, "MOST_SEGMENTS", 3)
    for n in range(5):
        gone, changed, new = f"c{n:03}", f"c{n + 20:03}", f"n{n}"
        del chunks[gone]
        chunks |= {changed: f"mu mu {n} alpha", new: "beta beta"}
        assert refresh([changed, new]) == 3
        assert hits(index, spark) == wanted(chunks)
        assert len(index.segments()) <= 4
    # What a run that broke off has left doesn't count.
    index._append(index._made(spark.createDataFrame([("x", ["alpha"], "h")], "chunk_id string, tokens array<string>, hash string")), "broken")
    assert hits(index, spark) == wanted(chunks)
    chunks.clear()
    assert refresh([]) > 0 and hits(index, spark) == []


def test_shards_are_ruled_out(spark, tmp_path, small_shards):
    # The words of the question are rare outside of the first shards, so that others can't reach the floor.
    chunks = {i: "alpha beta" if i < 40 else "alpha " + "gamma " * 30 for i in range(400)}
    index = ix.ChunkIndex(spark, f"file://{tmp_path}/index")
    index.refresh(spark.createDataFrame(list(chunks.items()), "chunk_id bigint, text string").coalesce(1))
    q = spark.createDataFrame([(1, "alpha beta")], "question_id int, question string")
    view = index.view(q)
    scored = []
    plain = view._score
    view._score = lambda pairs, how: scored.append(pairs.count()) or plain(pairs, how)
    assert [r["chunk_id"] for r in sorted(view.top(q.select("question_id", F.lit(5).alias("depth"))).collect(), key=lambda r: r["bm25_rank"])] == list(range(5))
    assert sum(scored) < view.pairs.count() / 5


@pytest.mark.parametrize("tile", [20_000, 30])
def test_angular_join_equals_all_pairs(spark, monkeypatch, tile):
    from quillspark.operators import angular

    monkeypatch.setattr(angular, "TILE", tile)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    v = centres[rng.integers(12, size=600)] + rng.normal(size=(600, 24)) * 0.12
    v[200:400] = v[200]  # one very common vector
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[599] = 0
    scopes = ["a", "b", None, ""]
    rows = [(i, x.tolist(), scopes[i % 4]) for i, x in enumerate(v)] + [(600, None, "a")]
    asked = [(i, v[i].tolist(), scopes[i // 7 % 4]) for i in range(0, 600, 7)] + [(999, None, None)]
    left = spark.createDataFrame(rows, "id int, vector array<double>, scope string")
    right = spark.createDataFrame(asked, "query_id int, vector array<double>, scope string")
    got = {}
    for r in angular_join(left, right, 0.9, 3).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    met = 0
    for k, q, scope in asked[:-1]:
        near = sorted((-s, i) for i, s in enumerate(np.round(v @ np.array(q), 6)) if s >= 0.9 and (not scope or rows[i][2] == scope))
        assert sorted(got.get(k, []))[:3] == [(pytest.approx(s), i) for s, i in near[:3]]
        met += len(near)
    count = angular_join(left, right, 0.9, 3, counts=True).agg(F.sum("met"), F.sum("computed")).first()
    assert met > 1000 and count[0] < 0.5 * 600 * len(asked) and met <= count[1] < 2.5 * met
    assert angular_join(left.limit(0), right, 0.9, 3).count() == 0


def test_dense_blocks_keep_the_first_by_score_and_id(spark):
    """Many vectors near each query, more than a block, with ties: the first three are those of all pairs."""
    rng = np.random.default_rng(5)
    m = np.abs(rng.normal(size=(2500, 8))) + 3
    m[1000:1040] = m[0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(k, x.tolist(), str(k % 2)) for k, x in enumerate(m)], "id long, vector array<double>, scope string")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", F.when(F.col("id") % 200 == 0, F.lit("1")).alias("scope"))
    got = {}
    for r in angular_join(v, q, 0.9, 3).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    score = np.round(m @ m.T, 6)
    for k in range(0, 2500, 100):
        want = sorted((-score[k, n], n) for n in range(2500) if score[k, n] >= 0.9 and (k % 200 or n % 2))
        assert sorted(got[k])[:3] == want[:3] and len(got[k]) < len(want)


def test_label_extremes_shuffle_no_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.8, 0.6], 1), (4, [0.0, 1.0], None)], "chunk_id long, vector array<double>, label int")
    q = v.select(F.col("chunk_id").alias("question_id"), "vector", "label").where("chunk_id <> 2")
    out = topk.label_extremes(q, v)
    assert {tuple(r) for r in out.collect()} == {(1, 0.6, 0.8), (3, None, 0.96)}


def test_pairs_leave_in_bounded_batches():
    """All pairs of a large Arrow batch are not made at once."""
    b = pa.RecordBatch.from_pydict({"chunk_id": list(range(5000)), "vector": [[1.0, 0.0]] * 5000})
    found = list(topk._products([b], np.ones((1000, 2)), topk.BLOCK_PAIRS // 1000))
    assert max(s.size for _, s, _ in found) <= topk.BLOCK_PAIRS and sum(s.size for _, s, _ in found) == 5_000_000


def test_blocks_hold_one_value_for_all_numbers():
    docs, ends = np.array([1, 5, 1023, 0, 7]), np.array([0, 3, 3, 5])
    packed = ix._packed(docs, ends, ix.DOC)
    assert packed.type == pa.binary() and packed.nbytes < 40
    for at, want in ((0, [1, 5, 1023, 0, 7]), (1, [0, 7]), (3, [])):
        got, stops = ix._unpacked(pa.chunked_array([packed.slice(at)]), ix.DOC)
        assert got.tolist() == want and stops.tolist() == [x - ends[at] for x in ends[at:]]
    lists = pa.array([[2, 70_000], [], [3]], pa.list_(pa.int32()))
    assert ix._unpacked(pa.chunked_array([ix._pack_counts(lists)]), ix.COUNT)[0].tolist() == [2, 70_000, 3]


def test_merged_blocks_find_the_same(spark, tmp_path):
    chunks = {1: "alpha beta", 2: "alpha alpha gamma", 3: "gamma", 4: ""}
    index = ix.ChunkIndex(spark, f"file://{tmp_path}/index")
    index.refresh(spark.createDataFrame(list(chunks.items()), "chunk_id bigint, text string"))
    chunks |= {2: "beta alpha mu", 5: "mu mu"}
    index.refresh(spark.createDataFrame(list(chunks.items()), "chunk_id bigint, text string"))
    index.merge()
    assert len(index.segments()) == 1 and hits(index, spark) == wanted(chunks)


def test_scores_shuffle_no_postings(spark):
    from quillspark.operators import retrieval as ops

    chunks = corpus(random.Random(3), 40)
    del chunks["e"]  # a text that is null has no length, here and in SQL
    q = spark.createDataFrame([(1, "alpha mu alpha"), (2, "unknown"), (3, "")], "question_id int, question string")
    out = ops.bm25(q, frame(spark, chunks))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(1, c): s for c, s in plain_bm25(chunks, "alpha mu").items() if s}
    got = {(r["question_id"], r["chunk_id"]): round(r["bm25_score"], 6) for r in out.collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_relevance_is_judged_once(spark, tmp_path):
    chunks = {k: f"alpha {w}" for k, w in enumerate(WORDS)}
    index = ix.ChunkIndex(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame(list(chunks.items()), "chunk_id bigint, text string")
    index.refresh(rows)
    judged = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def mu(text):
        judged.add(1)
        return "mu" in text

    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in chunks], "chunk_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, "alpha mu", [0.0, 1.0])], "question_id int, question string, vector array<double>")
    first = topk.Searcher(index, v, q).first_relevant(rows.where(mu("text")).select(F.lit(1).alias("question_id"), "chunk_id"))
    assert {r["mode"]: r["first"] for r in first.collect()} == {"vector": 1, "hybrid": 1, "bm25": 1}
    assert judged.value == len(chunks)
