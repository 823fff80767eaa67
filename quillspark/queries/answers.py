"""Queries of answer checking, evaluation by category, prompts and validated chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, topk
from ..plans import pipelines
from ..sources import tables as t
from .layouts import FURNITURE, LIMIT, SOLID, _tables
from .retrieval import _probes, _vectors, first_of_label


def _cases(spark, d):
    """Benchmark items as cases: expected phrases are the item's first two words; every fifth has none."""
    b = t.table(spark, d, "benchmark")
    w = F.split("text", " ")
    want = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.get(w, F.lit(0)), F.get(w, F.lit(1)))))
    return b.select(F.col("item_id").alias("case_id"), want.alias("expect_any"))


def _results(spark, d):
    b = t.table(spark, d, "benchmark").where("item_id % 7 <> 0")
    status = F.when(F.col("item_id") % 5 == 0, F.when(F.col("item_id") % 2 == 0, "not_found").otherwise("answered")).when(F.col("item_id") % 3 == 0, "unsupported").otherwise("answered")
    return b.select(F.col("item_id").alias("case_id"), status.alias("status"))


def _cited(spark, d):
    """A case cites its own item, or the one before it where its id is a multiple of 4."""
    b = t.table(spark, d, "benchmark")
    own = b.where("item_id % 4 <> 0").select(F.col("item_id").alias("case_id"), "text")
    return own.unionByName(b.select((F.col("item_id") + 1).alias("case_id"), "text").where("case_id % 4 = 0"))


def l8_judge(spark, d):
    return citations.judge(_cases(spark, d), _results(spark, d), _cited(spark, d))


def d18_qa_counts(spark, d):
    judged = l8_judge(spark, d)
    return judged.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("case_id")))), ",").alias("redo"))


def g5_missing_cases(spark, d):
    return _cases(spark, d).select("case_id").join(_results(spark, d), "case_id", "left_anti")


def p2_answer_status(spark, d):
    b = t.table(spark, d, "benchmark")
    replies = b.select(F.col("item_id").alias("question_id"), (F.col("item_id") % 6 != 0).alias("answerable"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"))
    checked = b.where("item_id % 2 = 0").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 4 == 0).alias("verified"))
    return citations.answer_status(replies, checked)


def h26_prompts(spark, d):
    """The four items of a question's block of ids as its sources, in their order."""
    b = t.table(spark, d, "benchmark").select((F.floor(F.col("item_id") / 4) * 4).alias("first"), "item_id", "text")
    s = b.select("first", (F.col("item_id") - F.col("first") + 1).cast("int").alias("rank"), F.lit("bench").alias("document_name"), F.col("item_id").alias("page_number"), F.lit("text").alias("content_type"), "text")
    return citations.render_sources(s.join(t.questions(spark, d).withColumn("first", F.floor(F.col("question_id") / 4) * 4), "first"))


def l6_category_hits(spark, d):
    """Vector hits of the probes by label as category: rank of the first other row of that label."""
    first = first_of_label(spark, d).join(_probes(spark, d).select("question_id", F.col("q_label").alias("category")), "question_id")
    return first.groupBy("category").agg(F.count_if(F.col("vector_rank") <= 4).alias("hit_3"), F.count("*").alias("questions"))


def d17_score_gap(spark, d):
    """The best score of any wrong row, and the lowest top score of a right one."""
    top = topk.label_extremes(_probes(spark, d).withColumnRenamed("q_label", "label"), _vectors(spark, d))
    return top.agg(F.min("good").alias("lowest_right"), F.max("bad").alias("best_wrong"))


def k3_validated_chunks(spark, d):
    """Documents with a partial overlap keep no chunks; the others are covered."""
    blocks = t.blocks(spark, d).withColumn("version", F.lit(1))
    boxes = _tables(spark, d).withColumn("x1", F.when(F.col("document_id") % 8 == 0, 100.0).otherwise(F.col("x1")))
    chunks, problems = pipelines.chunk_documents(blocks, boxes, LIMIT)
    kept = chunks.select("document_id").distinct().withColumn("outcome", F.lit("chunked"))
    return kept.unionByName(problems.select("document_id").distinct().withColumn("outcome", F.lit("rejected")))


QUERIES = {f.__name__: f for f in (l8_judge, d18_qa_counts, g5_missing_cases, p2_answer_status, h26_prompts, l6_category_hits, d17_score_gap, k3_validated_chunks)}

JUDGED = """c AS (SELECT item_id AS id, text, string_split(text, ' ') AS w FROM benchmark),
    r AS (SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN CASE WHEN item_id % 2 = 0 THEN 'not_found' ELSE 'answered' END WHEN item_id % 3 = 0 THEN 'unsupported' ELSE 'answered' END AS status FROM benchmark WHERE item_id % 7 <> 0),
    cited AS (SELECT id, text FROM c WHERE id % 4 <> 0 UNION ALL SELECT id + 1, text FROM c WHERE (id + 1) % 4 = 0),
    g AS (SELECT DISTINCT c.id FROM c JOIN cited x ON x.id = c.id WHERE c.id % 5 <> 0 AND contains(x.text, w[1]) AND contains(x.text, w[2])),
    judged AS (SELECT c.id AS case_id, CASE WHEN status IS NULL THEN 'no result' WHEN c.id % 5 = 0 AND status <> 'not_found' THEN 'answered without evidence'
        WHEN c.id % 5 <> 0 AND status <> 'answered' THEN status WHEN c.id % 5 <> 0 AND g.id IS NULL THEN 'wrong chunk' END AS why FROM c LEFT JOIN r ON r.id = c.id LEFT JOIN g ON g.id = c.id)"""
SIM = """v AS (SELECT vec_id AS id, embedding AS e, label FROM embeddings),
    s AS (SELECT q.id AS question_id, q.label AS ql, v.id AS chunk_id, v.label, round(list_sum(list_transform(list_zip(q.e, v.e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS similarity FROM v q, v WHERE q.id % 50 = 0)"""
ORACLES = {
    "l8_judge": f"WITH {JUDGED} SELECT case_id, why IS NULL AS passed, why FROM judged",
    "d18_qa_counts": f"WITH {JUDGED} SELECT count(*) FILTER (why IS NULL) AS passed, count(*) FILTER (why IS NOT NULL) AS failed, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) FILTER (why IS NOT NULL) AS redo FROM judged",
    "g5_missing_cases": "SELECT item_id AS case_id FROM benchmark WHERE item_id % 7 = 0",
    "p2_answer_status": """SELECT item_id AS question_id, CASE WHEN item_id % 6 = 0 THEN 'not_found' WHEN item_id % 4 = 0 THEN 'answered' ELSE 'unsupported' END AS status,
        CASE WHEN item_id % 6 = 0 THEN '' ELSE 'answer ' || item_id END AS answer FROM benchmark""",
    "h26_prompts": f"""WITH {t.QUESTIONS_SQL}, s AS (SELECT item_id // 4 AS block, item_id % 4 + 1 AS k, item_id, text FROM benchmark)
        SELECT question_id, 'Sources:' || chr(10) || chr(10) || string_agg('[' || k || '] bench, page ' || item_id || ' (text)' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY k) || chr(10) || chr(10) || 'Question: ' || question AS prompt
        FROM s JOIN questions ON question_id // 4 = block GROUP BY question_id, question""",
    "l6_category_hits": f"""WITH {SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank FROM s),
        f AS (SELECT question_id, ql, min(rank) AS first FROM r WHERE label = ql AND chunk_id <> question_id GROUP BY ALL)
        SELECT ql AS category, count(*) FILTER (first <= 4) AS hit_3, count(*) AS questions FROM f GROUP BY ql""",
    "d17_score_gap": f"""WITH {SIM}, f AS (SELECT question_id, max(similarity) FILTER (label = ql) AS good, max(similarity) FILTER (label <> ql) AS bad FROM s WHERE chunk_id <> question_id GROUP BY question_id)
        SELECT min(good) AS lowest_right, max(bad) AS best_wrong FROM f""",
    "k3_validated_chunks": f"""WITH {FURNITURE}, bad AS (SELECT DISTINCT document_id FROM classed WHERE document_id % 8 = 0 AND (block_number - 1) % 20 BETWEEN 3 AND 5 AND x1 > 100)
        SELECT document_id, 'rejected' AS outcome FROM bad UNION ALL
        SELECT DISTINCT document_id, 'chunked' FROM classed c WHERE document_id NOT IN (FROM bad) AND (classification = 'OUTSIDE_TABLE') AND {SOLID}
            AND NOT EXISTS (FROM furn f WHERE f.document_id = c.document_id AND f.page_number = c.page_number AND f.block_number = c.block_number)""",
}
