"""Queries of the retrieval, evaluation and semantic-cache operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import retrieval as ops
from ..operators import semantic_cache as cache
from ..operators import topk
from ..operators.index import ChunkIndex
from ..session import shared_folder, spread, stored
from ..sources import tables as t
from .texts import STRIPPED, TOKENS, S, W


def _chunks(spark, d):
    return spread(t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def _vectors(spark, d):
    return t.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _probes(spark, d):
    """Every vector whose id is divisible by 50 as a question."""
    return _vectors(spark, d).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("question_id"), "vector", F.col("label").alias("q_label"))


def d6_postings(spark, d):
    return ops.postings(_chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def d8_corpus_stats(spark, d):
    s = ops.corpus_stats(_chunks(spark, d))
    return s.select("n", F.round("avg_length", 6).alias("avg_length"))


def i3_unstable_vectors(spark, d):
    """Stored vectors against a second encoding that moves every seventh one."""
    v = _vectors(spark, d)
    again = v.withColumn("vector", F.when(F.col("chunk_id") % 7 == 0, F.transform("vector", lambda x: x + F.lit(0.5).cast("float"))).otherwise(F.col("vector")))
    return ops.unstable_vectors(v, again).select("chunk_id", F.round("difference", 3).alias("difference"))


def g7_indexed_versions(spark, d):
    docs = t.registry(spark, d).select("document_id", F.col("filename").alias("document_name"), F.col("version").alias("document_version"))
    return ops.indexed_versions(t.blocks(spark, d).join(docs, "document_id"))


def l1_bm25(spark, d):
    s = ops.bm25(t.questions(spark, d), _chunks(spark, d))
    return s.select("question_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"))


def c10_similarities(spark, d):
    s = topk.similarities(_probes(spark, d), _vectors(spark, d))
    return s.select("question_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


def l2_vector_search(spark, d):
    return topk.vector_top(_probes(spark, d).withColumn("depth", F.lit(5)).drop("q_label"), _vectors(spark, d)).withColumnRenamed("vector_rank", "rank")


def _index(spark, d, name="documents"):
    """The index of a session's tables: made by the first query that asks for it, and brought up to date by others."""
    where = hashlib.sha256(d.encode()).hexdigest()[:16]
    return ChunkIndex(spark, f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{where}-{name}")


def _searcher(spark, d, scope=None):
    index, chunks, asked = _index(spark, d), _chunks(spark, d), t.questions(spark, d)
    index.refresh(chunks)
    vectors = stored(ops.hashed_vectors(chunks, "chunk_id", "text"), "vectors")  # made once, as a vector store would have them
    return topk.Searcher(index, vectors, asked.join(ops.hashed_vectors(asked, "question_id", "question"), "question_id"), scope)


def l2_hybrid_search(spark, d):
    out = _searcher(spark, d).search()
    return out.select("question_id", "chunk_id", F.round("score", 6).alias("score"), "similarity", "bm25_score", "vector_rank", "bm25_rank", "rank")


def l2_bm25_search(spark, d):
    return _searcher(spark, d).search(mode="bm25").select("question_id", "chunk_id", "bm25_score", "rank")


def l3_session_search(spark, d):
    """Hybrid search in the documents of one session, with the statistics of these."""
    scope = t.links(spark, d).where("session_id = 's10'").select(F.col("document_id").alias("chunk_id"))
    return _searcher(spark, d, scope).search().select("question_id", "chunk_id", F.round("score", 6).alias("score"), "vector_rank", "bm25_rank", "rank")


def l3_refreshed_index(spark, d):
    """Keyword hits of an index that knew other texts, rows that are gone, and not all rows, before it was refreshed."""
    index, now = _index(spark, d, "refreshed"), _chunks(spark, d)
    old = now.where("chunk_id % 10 <> 3").withColumn("text", F.when(F.col("chunk_id") % 7 == 0, F.concat(F.lit("stale words "), F.reverse("text"))).otherwise(F.col("text")))
    index.refresh(old.unionByName(now.where("chunk_id % 5 = 0").withColumn("chunk_id", -1 - F.col("chunk_id"))))
    index.refresh(now)
    asked = t.questions(spark, d)
    return index.view(asked).top(asked.select("question_id", F.lit(10).alias("depth")))


def first_of_label(spark, d):
    """(question_id, chunk_id, similarity, vector_rank): the nearest row of each probe's label but itself, with its
    rank among all rows."""
    q, v = _probes(spark, d).withColumnRenamed("q_label", "label"), _vectors(spark, d)
    near = topk.vector_top(q.withColumn("depth", F.lit(1)), v).select("question_id", "chunk_id", "similarity")
    return topk.vector_ranks(near, q, v)


def l5_evaluation(spark, d):
    """Vector ranking of all rows for each probe; rows with the probe's label are relevant."""
    first = first_of_label(spark, d).select("question_id", F.col("vector_rank").alias("first"))
    return ops.hit_metrics(first, _probes(spark, d))


def l5_modes(spark, d):
    """Rank of the first relevant document over all of them, for each benchmark item in the three modes; a
    document is relevant if it has the item's first two words."""
    w = F.split("question", " ")
    groups = F.array(F.array(F.get(w, F.lit(0)), F.get(w, F.lit(1))))
    cases = ops.small(t.questions(spark, d).select("question_id", groups.alias("groups")))
    relevant = _chunks(spark, d).join(cases, text.is_relevant(F.col("text"), F.col("groups"))).select("question_id", "chunk_id")
    return _searcher(spark, d).first_relevant(relevant)


def l4_stale_vectors(spark, d):
    chunks = _chunks(spark, d)
    stored = chunks.where("chunk_id % 4 <> 0").select("chunk_id", F.lit("m").alias("model"), F.sha2(F.when(F.col("chunk_id") % 5 == 0, F.lit("old")).otherwise(F.col("text")), 256).alias("text_sha256"))
    return ops.stale_vectors(chunks, stored, "m").select("chunk_id")


def l7_vector_health(spark, d):
    v = _vectors(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 9 == 0, F.transform("vector", lambda x: x * 2)).otherwise(F.col("vector")).alias("v"))
    return v.select("chunk_id", F.round(vector.norm(F.col("v")), 4).alias("norm"), F.array_join(vector.problems(F.col("v"), 64), ",").alias("problems"))


def l7_check_vectors(spark, d):
    """Vectors of documents, every 9th twice as long and every 17th missing, against a second encoding of every 50th that moves every
    100th."""
    docs = _chunks(spark, d)
    v = stored(ops.hashed_vectors(docs, "chunk_id", "text"), "vectors")
    held = v.where("chunk_id % 17 <> 0").withColumn("vector", F.when(F.col("chunk_id") % 9 == 0, F.transform("vector", lambda x: x * 2)).otherwise(F.col("vector")))
    again = held.where("chunk_id % 50 = 0").withColumn("vector", F.when(F.col("chunk_id") % 100 == 0, F.transform("vector", lambda x: x + 0.5)).otherwise(F.col("vector")))
    return ops.check_vectors(docs, held, again, 512, 64)


def a16_hashed_vectors(spark, d):
    v = ops.hashed_vectors(_chunks(spark, d), "chunk_id", "text").withColumnRenamed("vector", "v")
    return v.select("chunk_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.array_max("v"), 6).alias("largest"))


def a17_tfidf(spark, d):
    w = ops.tfidf(t.table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), "text"))
    return w.select("chunk_id", "term", F.round("weight", 6).alias("weight"))


def _cache(spark, d):
    """Vectors as stored queries (parameters by id), and every one whose id is divisible by 50 as a query."""
    e = t.table(spark, d, "embeddings")
    loc = F.array(F.concat(F.lit("city"), (F.col("label") % 3).cast("string")))
    stored = e.select(F.col("vec_id").alias("cache_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 2 == 0, "2021").otherwise("latest").alias("timeframe"), loc.alias("locations"), F.array(F.lit("gdp"), F.lit("cpi")).alias("indicators"), (F.col("vec_id") % 2 == 0).alias("is_historical"), (F.col("vec_id") * 1000.0).alias("created_at"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 3 == 0, "2021").alias("q_timeframe"), loc.alias("q_locations"), F.array(F.lit("gdp")).alias("q_indicators"))
    return stored, asked


def a19_nearest_documents(spark, d):
    """The three nearest documents at 0.9 or above of every document whose id is divisible by 50, itself included."""
    chunks = _chunks(spark, d)
    v = stored(ops.hashed_vectors(chunks, "chunk_id", "text"), "vectors").select(F.col("chunk_id").alias("cache_id"), "vector", F.lit(None).cast("string").alias("timeframe"))
    asked = v.where("cache_id % 50 = 0").select(F.col("cache_id").alias("query_id"), "vector")
    return cache.candidates(v, asked, False).select("query_id", "cache_id", "score", "rank")


def m1_raw_lookup(spark, d):
    return cache.lookup(*_cache(spark, d), F.lit(90_000.0), scoped=False)


def m2_scoped_lookup(spark, d):
    stored, asked = _cache(spark, d)
    asked = asked.withColumn("q_timeframe", F.coalesce("q_timeframe", F.when(F.col("query_id") % 2 == 0, "2021").otherwise("latest")))
    return cache.lookup(stored, asked, F.lit(90_000.0))


def b11_historical_flags(spark, d):
    e = t.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "Latest").when(F.col("event_id") % 3 == 1, "2021").alias("timeframe"))
    return cache.store(e).select("event_id", F.coalesce("is_historical", F.lit(False)).alias("is_historical"))


QUERIES = {f.__name__: f for f in (i3_unstable_vectors, g7_indexed_versions, d6_postings, d8_corpus_stats, l1_bm25, c10_similarities, l2_vector_search, l2_hybrid_search, l2_bm25_search, l3_session_search, l3_refreshed_index, l5_evaluation, l5_modes, l4_stale_vectors, l7_vector_health, l7_check_vectors, a16_hashed_vectors, a17_tfidf, a19_nearest_documents, m1_raw_lookup, m2_scoped_lookup, b11_historical_flags)}

DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
TOK = f"tok AS (SELECT doc_id AS chunk_id, {TOKENS.format('text')} AS t FROM documents), post AS (SELECT chunk_id, len(t) AS length, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM tok) GROUP BY ALL)"
BM = f"""{t.QUESTIONS_SQL}, {TOK}, stats AS (SELECT count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1) AS a FROM tok),
    qt AS (SELECT DISTINCT question_id, unnest({TOKENS.format('question')}) AS term FROM questions),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    kw AS (SELECT question_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS bm25_score
           FROM qt JOIN post USING (term) JOIN df USING (term), stats GROUP BY question_id, chunk_id)"""
def _slots(name: str, key: str, rows: str) -> str:
    """Unit vectors of (key, t array of tokens) rows as sparse (key, slot, v)."""
    return f"""{name}_c AS (SELECT {key}, slot, count(*) AS c FROM (SELECT {key}, list_sum(list_transform(string_split(w, ''), lambda x: ord(x))) % 64 AS slot FROM (SELECT {key}, unnest(t) AS w FROM {rows})) GROUP BY ALL),
    {name} AS (SELECT {key}, slot, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS v FROM {name}_c)"""


RANKED = f"""qtok AS (SELECT question_id, {TOKENS.format('question')} AS t FROM questions WHERE trim(question) <> ''), {_slots('dv', 'chunk_id', 'tok')}, {_slots('qv', 'question_id', 'qtok')},
    s AS (SELECT q.question_id, k.chunk_id, round(coalesce(sum(qv.v * dv.v), 0), 6) AS similarity FROM qtok q CROSS JOIN tok k LEFT JOIN qv ON qv.question_id = q.question_id LEFT JOIN dv ON dv.chunk_id = k.chunk_id AND dv.slot = qv.slot GROUP BY ALL),
    j AS (SELECT s.*, coalesce(bm25_score, 0) AS bm25_score FROM s LEFT JOIN kw USING (question_id, chunk_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS vector_rank,
          CASE WHEN bm25_score > 0 THEN row_number() OVER (PARTITION BY question_id ORDER BY bm25_score DESC, chunk_id) END AS bm25_rank FROM j)"""
HYBRID = f"WITH {BM}, {RANKED}"
#: The same over the documents of one session.
SESSION = f"""WITH {BM.replace("FROM documents)", "FROM documents WHERE doc_id % 30 = 10)", 1)}, {RANKED}"""
TOP = """f AS (SELECT *, 1 / (60 + vector_rank) + coalesce(1 / (60 + bm25_rank), 0) AS score FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, similarity DESC, chunk_id) AS rank FROM f)"""
PROBE = f"""v AS (SELECT vec_id AS chunk_id, embedding AS e, label FROM embeddings), q AS (SELECT chunk_id AS question_id, e AS qe, label AS ql FROM v WHERE chunk_id % 50 = 0),
    s AS (SELECT question_id, chunk_id, label, ql, round({DOT.format('qe', 'e')}, 6) AS similarity FROM v, q)"""
CACHE = f"""e AS (SELECT vec_id AS id, embedding AS v, 'city' || CAST(label % 3 AS VARCHAR) AS loc, CASE WHEN vec_id % 2 = 0 THEN '2021' ELSE 'latest' END AS tf FROM embeddings),
    p AS (SELECT q.id AS query_id, c.id AS cache_id, c.loc AS cloc, q.loc AS qloc, c.tf AS ctf, q.tf AS qdef, round({DOT.format('q.v', 'c.v')}, 6) AS score FROM e q, e c WHERE q.id % 50 = 0)"""
ORACLES = {
    "i3_unstable_vectors": "SELECT vec_id AS chunk_id, 0.5::DOUBLE AS difference FROM embeddings WHERE vec_id % 7 = 0",
    "g7_indexed_versions": f"WITH {t.REGISTRY_SQL} SELECT DISTINCT filename AS document_name, version AS document_version FROM registry",
    "d6_postings": f"WITH {TOK} SELECT term, count(*) AS df, sum(tf) AS tf FROM post GROUP BY term",
    "d8_corpus_stats": f"WITH {TOK} SELECT count(*) AS n, round(coalesce(nullif(avg(len(t)), 0), 1), 6) AS avg_length FROM tok",
    "l1_bm25": f"WITH {BM} SELECT question_id, chunk_id, bm25_score FROM kw",
    "c10_similarities": f"WITH {PROBE} SELECT question_id, chunk_id, similarity FROM s",
    "l2_vector_search": f"WITH {PROBE}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) SELECT question_id, chunk_id, similarity, rank FROM r WHERE rank <= 5",
    "l2_hybrid_search": f"""{HYBRID}, {TOP}
        SELECT question_id, chunk_id, round(score, 6) AS score, similarity, bm25_score, vector_rank, bm25_rank, rank FROM k WHERE rank <= 5""",
    "l2_bm25_search": f"""{HYBRID}, k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25_score DESC, similarity DESC, chunk_id) AS rank FROM r)
        SELECT question_id, chunk_id, bm25_score, rank FROM k WHERE rank <= 5""",
    "l3_session_search": f"{SESSION}, {TOP} SELECT question_id, chunk_id, round(score, 6) AS score, vector_rank, bm25_rank, rank FROM k WHERE rank <= 5",
    "l3_refreshed_index": f"WITH {BM}, k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25_score DESC, chunk_id) AS bm25_rank FROM kw WHERE bm25_score > 0) SELECT * FROM k WHERE bm25_rank <= 10",
    "l5_modes": f"""{HYBRID}, f AS (SELECT *, 1 / (60 + vector_rank) + coalesce(1 / (60 + bm25_rank), 0) AS score FROM r),
        k AS (SELECT question_id, chunk_id, vector_rank AS "vector", row_number() OVER (PARTITION BY question_id ORDER BY score DESC, similarity DESC, chunk_id) AS hybrid,
                row_number() OVER (PARTITION BY question_id ORDER BY bm25_score DESC, similarity DESC, chunk_id) AS bm25 FROM f),
        rel AS (SELECT q.question_id, d.doc_id AS chunk_id FROM (SELECT question_id, string_split(question, ' ') AS w FROM questions) q JOIN documents d ON contains(d.text, w[1]) AND contains(d.text, w[2])),
        m AS (SELECT question_id, min("vector") AS "vector", min(hybrid) AS hybrid, min(bm25) AS bm25 FROM k JOIN rel USING (question_id, chunk_id) GROUP BY question_id)
        SELECT q.question_id, x.mode, CAST(CASE x.mode WHEN 'vector' THEN m."vector" WHEN 'hybrid' THEN m.hybrid ELSE m.bm25 END AS INTEGER) AS first
        FROM qtok q CROSS JOIN (VALUES ('vector'), ('hybrid'), ('bm25')) x(mode) LEFT JOIN m USING (question_id)""",
    "l5_evaluation": f"""WITH {PROBE}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank FROM s),
        f AS (SELECT question_id, min(rank) FILTER (label = ql AND chunk_id <> question_id) AS first FROM r GROUP BY question_id)
        SELECT count(*) FILTER (first = 1) AS hit_1, count(*) FILTER (first <= 3) AS hit_k, round(sum(coalesce(1 / first, 0)) / count(*), 6) AS mrr, count(*) AS questions FROM f""",
    "l4_stale_vectors": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0",
    "l7_vector_health": f"""WITH v AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding, lambda x: x * 2) ELSE embedding END AS v FROM embeddings)
        SELECT chunk_id, round(sqrt({DOT.format('v', 'v')}), 4) AS norm, CASE WHEN chunk_id % 9 = 0 THEN 'norm' ELSE '' END AS problems FROM v""",
    "l7_check_vectors": rf"""WITH {TOK}, x AS (SELECT doc_id AS chunk_id, text, CAST(ceil(1.3 * len(regexp_extract_all(text, '[{W}]+|[^{W}{S}]'))) + 2 AS INTEGER) AS n FROM documents),
        g AS (SELECT chunk_id, min(chunk_id) OVER w AS first, count(*) OVER w AS k FROM x WINDOW w AS (PARTITION BY {STRIPPED}))
        SELECT chunk_id, 'oversized' AS problem, CAST(n AS VARCHAR) AS detail FROM x WHERE n > 512
        UNION ALL SELECT chunk_id, 'missing', '' FROM x WHERE chunk_id % 17 = 0
        UNION ALL SELECT chunk_id, 'norm', '' FROM tok WHERE chunk_id % 17 <> 0 AND (chunk_id % 9 = 0 OR len(t) = 0)
        UNION ALL SELECT chunk_id, 'unstable', '' FROM x WHERE chunk_id % 17 <> 0 AND chunk_id % 100 = 0
        UNION ALL SELECT chunk_id, 'duplicate text', CAST(first AS VARCHAR) FROM g WHERE k > 1""",
    "a16_hashed_vectors": f"WITH {TOK}, {_slots('dv', 'chunk_id', 'tok')} SELECT tok.chunk_id, round(coalesce(max(v) FILTER (slot = 0), 0), 6) AS first, round(coalesce(max(v), 0), 6) AS largest FROM tok LEFT JOIN dv USING (chunk_id) GROUP BY tok.chunk_id",
    "a17_tfidf": r"""WITH w AS (SELECT item_id AS chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark),
        x AS (SELECT chunk_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
        c AS (SELECT chunk_id, term, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM benchmark),
        r AS (SELECT chunk_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df USING (term), n)
        SELECT chunk_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)), 6) AS weight FROM r""",
    "a19_nearest_documents": f"""WITH {TOK}, {_slots('dv', 'chunk_id', 'tok')},
        s AS (SELECT q.chunk_id AS query_id, c.chunk_id AS cache_id, round(sum(q.v * c.v), 6) AS score FROM dv q JOIN dv c USING (slot) WHERE q.chunk_id % 50 = 0 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cache_id) AS rank FROM s WHERE score >= 0.9)
        SELECT * FROM k WHERE rank <= 3""",
    "m1_raw_lookup": f"""WITH {CACHE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cache_id) AS rank FROM p WHERE score >= 0.9)
        SELECT query_id, arg_min(cache_id, rank) AS cache_id, arg_min(score, rank) AS score FROM k WHERE rank <= 3 AND NOT (ctf = 'latest' AND 90000 - cache_id * 1000 > 86400) GROUP BY query_id""",
    "m2_scoped_lookup": f"""WITH {CACHE}, z AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN '2021' ELSE qdef END AS qtf FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cache_id) AS rank FROM z WHERE score >= 0.9 AND ctf = qtf)
        SELECT query_id, arg_min(cache_id, rank) AS cache_id, arg_min(score, rank) AS score FROM k WHERE rank <= 3 AND cloc = qloc AND NOT (ctf = 'latest' AND 90000 - cache_id * 1000 > 86400) GROUP BY query_id""",
    "b11_historical_flags": "SELECT event_id, event_id % 3 = 1 AS is_historical FROM events",
}
