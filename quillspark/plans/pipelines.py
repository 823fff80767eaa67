"""End-to-end plans: documents to chunks, questions to verified answers, research queries to reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, citations, layout, planning, topk
from ..session import stored, written
from ..sources.models import LLM, LLMError, QuotaError, generate

ANSWER_SYSTEM = "Answer from the numbered sources only and quote them word for word."
ANSWER_SCHEMA = {
    "type": "object",
    "required": ["answerable", "answer", "citations"],
    "properties": {
        "answerable": {"type": "boolean"},
        "answer": {"type": "string"},
        "citations": {"type": "array", "items": {"type": "object", "required": ["source", "quote"], "properties": {"source": {"type": "integer"}, "quote": {"type": "string"}}}},
    },
}
#: Earlier messages that a rewrite sees.
HISTORY = 6
ANSWER_TYPE = "answerable boolean, answer string, citations array<struct<source:int,quote:string>>"


def chunk_documents(blocks: DataFrame, tables: DataFrame, limit: int, count: chunking.Counter = chunking.approximate_tokens) -> tuple[DataFrame, DataFrame]:
    """(chunks, problems) of raw blocks (document_id, version, page_number, block_number, box, text) (K3, G1):
    classified, furniture marked, packed. Where tables (document_id, page_number, table_number, box) bring
    ``rows`` and ``external`` names, their parts follow, with the title and notes found beside them.
    Documents with a problem keep no chunks."""
    # Rules look at what is known of the texts; the texts themselves are read again where they are packed and checked.
    known = stored(layout.traits(blocks), "traits")
    marked = stored(layout.mark_furniture(layout.classify_blocks(known, tables)), "marked")
    unknown = chunking.block_problems(marked)
    sound = marked.join(unknown.select("document_id").distinct(), "document_id", "left_anti")
    texts = stored(chunking.text_chunks(sound, limit, count, blocks), "chunks")
    problems = unknown.unionByName(chunking.text_problems(texts, sound, limit, blocks))
    shown = ["document_id", "version", "page_number", "chunk_id", "content_type", "section", "text", "token_count"]
    chunks = texts.withColumn("content_type", F.lit("text")).select(*shown)
    if "rows" in tables.columns:
        key = ["document_id", "page_number", "table_number"]
        sound = sound.join(blocks.select("document_id", "version", "page_number", "block_number", "text"), ["document_id", "version", "page_number", "block_number"])
        named = tables.join(layout.find_titles(sound, tables).select(*key, "title"), key, "left").join(layout.find_notes(sound, tables), key, "left")
        named = named.join(sound.select("document_id", "version").distinct(), "document_id")
        name = F.concat_ws("", F.col("document_id"), F.lit(":v"), F.col("version"), F.lit(":p"), F.col("page_number"), F.lit(":t"), F.col("table_number"))
        rendered = written(chunking.rendered_tables(named.withColumn("table_id", name)))
        parts = written(chunking.table_chunks(rendered, limit, count=count).select("document_id", "version", "page_number", "chunk_id", "text", "token_count", *chunking.CHECKED))
        bad = chunking.table_problems(parts, rendered).join(rendered.select("table_id", "document_id", "version", "page_number"), "table_id")
        problems = problems.unionByName(bad.select("document_id", "version", "page_number", F.lit(None).cast("int").alias("block_number"), "problem"))
        chunks = chunks.unionByName(parts.withColumn("content_type", F.lit("table")).withColumn("section", F.lit(None).cast("string")).select(*shown))
    problems = written(problems)
    return chunks.join(problems.select("document_id").distinct(), "document_id", "left_anti"), problems


def answer(questions: DataFrame, chunks: DataFrame, encoder, make_llm: Callable[[], LLM], top_k: int = 5) -> DataFrame:
    """(question_id, status, answer, citations): hybrid search, one call per question that has hits,
    quotes checked against their sources (P2, P3)."""
    vectors = encoder.encode(chunks, "text").select("chunk_id", "vector")
    hits = topk.search(encoder.encode(questions, "question"), chunks, vectors, top_k)
    sources = written(hits.join(chunks, "chunk_id").join(questions.select("question_id", "question"), "question_id"))
    replies = written(generate(citations.render_sources(sources), make_llm, ANSWER_SYSTEM, ANSWER_SCHEMA, ANSWER_TYPE))
    quoted = replies.select("question_id", F.posexplode("reply.citations").alias("pos", "c")).select("question_id", "pos", F.col("c.source").alias("source"), F.col("c.quote").alias("quote"))
    checked = citations.check_citations(quoted, sources.select("question_id", F.col("rank").alias("number"), "document_name", "page_number", "chunk_id", "content_type", "text"))
    every = questions.select("question_id").join(replies.select("question_id", "reply.answerable", "reply.answer"), "question_id", "left")
    status = citations.answer_status(every, checked)
    listed = checked.where("verified").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "chunk_id", "quote"))).alias("citations"))
    return status.join(listed, "question_id", "left")


def rewrite_question(question: str, history: str, llm: LLM) -> str:
    """The standalone form of a follow-up question."""
    if not history:
        return question
    reply = llm.generate_json("Rewrite the last question so that it stands alone.", f"{history}\nUser: {question}", {"type": "object", "required": ["question"]})
    return (reply.get("question") or "").strip() or question


def chat_turn(spark, question: str, messages: list[dict], scope: Callable[[str], DataFrame], encoder, make_llm: Callable[[], LLM], top_k: int = 5, rewrite: bool = True) -> dict:
    """The answer to one chat message (P5): rewritten by the earlier messages (role, content), answered
    from the chunks in scope, which ``scope`` gives for the question to be searched for."""
    lines = [f"{'User' if m['role'] == 'user' else 'Assistant'}: {m['content']}" for m in messages[-HISTORY:]]
    standalone = rewrite_question(question, "\n".join(lines), make_llm()) if rewrite else question
    asked = spark.createDataFrame([(1, standalone)], "question_id bigint, question string")
    found = answer(asked, scope(standalone), encoder, make_llm, top_k).first()
    return {**found.asDict(recursive=True), "asked": question, "searched_for": standalone}


def evaluate_answers(cases: list[dict], ask: Callable[[str], dict]) -> tuple[list[dict], list[str]]:
    """Results of the cases, and the ids to run again: the loop stops at the first quota error, other
    errors count as errors (P6)."""
    out = []
    for i, case in enumerate(cases):
        try:
            out.append({"case_id": case["id"], **ask(case["question"])})
        except QuotaError:
            return out, [c["id"] for c in cases[i:]]
        except LLMError as e:
            out.append({"case_id": case["id"], "status": "error", "error": str(e)})
    return out, [r["case_id"] for r in out if r.get("status") == "error"]


def decompose(query: str, llm: LLM) -> list[dict]:
    """Sub-tasks of a research query."""
    reply = llm.generate_json("Split the query into sub-tasks with dependencies.", query, {"type": "object", "required": ["sub_tasks"]})
    return [{"plan_id": "PLAN_001", "task_id": t["task_id"], "pos": i, "sub_query": t["sub_query"], "task_type": t.get("task_type", "DATA_RETRIEVAL"), "depends_on": list(t.get("depends_on") or [])} for i, t in enumerate(reply["sub_tasks"])]


def research(spark, query: str, llm: LLM, run_task: Callable[[str, str], str], cached: Callable[[str], str | None] = lambda q: None, save: Callable[[str, dict], None] = lambda q, r: None) -> Iterator[tuple[str, dict]]:
    """Progress events of one research query (N6): cache, sub-tasks, waves, results, report."""
    if not query.strip():
        raise ValueError("blank query")
    yield "init", {"query": query}
    try:
        hit = cached(query)
        if hit is not None:
            yield "cache_hit", {"response": hit}
            yield "close", {}
            return
        yield "cache_miss", {}
        tasks = decompose(query, llm)
        yield "decomposition_complete", {"tasks": [t["task_id"] for t in tasks]}
        frame = spark.createDataFrame(tasks, "plan_id string, task_id string, pos int, sub_query string, task_type string, depends_on array<string>")
        errors = planning.plan_failures(frame).collect()
        if errors:
            raise ValueError(errors[0]["error"])
        plan = planning.waves(frame).collect()
        yield "plan_complete", {"waves": {r["task_id"]: r["wave"] for r in plan}}
        done = planning.execute(frame, run_task)
        results = frame.join(done, ["plan_id", "task_id"], "left")
        yield "execution_complete", {r["task_id"]: r["status"] for r in done.collect()}
        prompt = planning.render_results(results).first()["prompt"]
        report = llm.generate_json("Write a report.", prompt, {"type": "object"})
        save(query, report)
        yield "report_complete", report
        yield "close", {}
    except (LLMError, ValueError) as e:
        yield "error", {"message": str(e)}
