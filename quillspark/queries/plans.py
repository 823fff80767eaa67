"""Queries of the planning, event and token-usage operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import planning
from ..plans import agents, flows
from ..session import shared_folder, stored
from ..sources import tables as t
from ..sources.models import HashedEncoder, LLMError, QuotaError
from ..streaming import files, registration, watching
from . import registry, retrieval


def _tasks(spark, d):
    """Orders of a customer as a plan: order n depends on its halves, so depths grow with the logarithm."""
    from pyspark.sql import Window

    o = t.table(spark, d, "orders").withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("int"))
    half = (F.col("pos") / 2).cast("int").cast("string")
    deps = F.when(F.col("pos") == 1, F.array().cast("array<string>")).when(F.col("pos") % 3 == 0, F.array(half, F.lit("1"))).otherwise(F.array(half))
    return o.select(F.col("o_custkey").cast("string").alias("plan_id"), F.col("pos").cast("string").alias("task_id"), "pos", F.col("o_orderpriority").alias("sub_query"), F.col("o_orderstatus").alias("task_type"), deps.alias("depends_on"))


def _results(spark, d):
    return _tasks(spark, d).where("pos % 4 <> 0").select("plan_id", "task_id", F.concat(F.lit("result of "), "task_id").alias("result"))


def n1_waves(spark, d):
    return planning.waves(_tasks(spark, d))


def c8_unknown_dependencies(spark, d):
    tasks = _tasks(spark, d).withColumn("depends_on", F.when(F.col("pos") == 5, F.array(F.lit("999"))).otherwise(F.col("depends_on")))
    return planning.plan_errors(tasks)


def n4_contexts(spark, d):
    return planning.contexts(_tasks(spark, d), _results(spark, d))


def h29_synthesis_prompts(spark, d):
    rows = _tasks(spark, d).join(_results(spark, d), ["plan_id", "task_id"], "left").withColumn("status", F.when(F.col("pos") % 5 == 0, "failed"))
    return planning.render_results(rows)


def n3_execute(spark, d):
    """All plans wave by wave; tasks of one priority fail."""

    def run(query: str, context: str) -> str:
        if query == "5-LOW":
            raise RuntimeError("task failed")
        return f"{query} after {context.count('--- Prior')} with {context.count('task failed')} failed"

    return planning.execute(_tasks(spark, d), run)


def n1_plan_failures(spark, d):
    """Plans of which some have an unknown dependency, some a cycle through a leaf and the root, some both."""
    tasks, n = _tasks(spark, d), F.col("plan_id").cast("bigint")
    deps = F.when((n % 3 == 1) & (F.col("pos") % 4 == 0), F.concat("depends_on", F.array(F.lit("x"), F.lit("y")))).when((n % 2 == 0) & (F.col("pos") == 1), F.array(F.lit("2"))).otherwise(F.col("depends_on"))
    return planning.plan_failures(tasks.withColumn("depends_on", deps))


def e13_chain_waves(spark, d):
    """All events of a user as one chain, each depending on the one before it."""
    from pyspark.sql import Window

    e = t.table(spark, d, "events").select(F.col("user_id").cast("string").alias("plan_id"), F.col("event_id").cast("string").alias("task_id"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("string").alias("before"))
    deps = F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array("before"))
    return planning.waves(e.select("plan_id", "task_id", deps.alias("depends_on"))).select("plan_id", "task_id", "wave")


def p6_evaluation(spark, d):
    """Benchmark items as cases, the last ones first. The model fails on some and is out of quota on others, the first of which ends
    the evaluation."""

    def ask(question: str) -> tuple[str, str]:
        n = len(question)
        if n % 37 == 36:
            raise QuotaError("quota")
        if n % 5 == 0:
            raise LLMError(f"error at {n}")
        return ("answered", f"{n} characters") if n % 2 else ("not_found", "")

    cases = t.table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), (-F.col("item_id")).alias("pos"), F.col("text").alias("question"))
    results = flows.evaluate(cases, ask, first=2)
    again = flows.redo(cases, results).withColumn("redo", F.lit(True))
    return results.join(again, "case_id", "full_outer").select("case_id", "nth", "status", "answer", F.coalesce("redo", F.lit(False)).alias("redo"))


def a13_listing_changes(spark, d):
    """Documents as files, before and after every 7th went, every 11th changed, every 13th moved, and every 5th was new."""
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))
    before = docs.where("i % 5 <> 0").drop("i")
    moved = F.when((F.col("i") % 13 == 0) & (F.col("i") % 5 != 0), F.concat(F.lit("m"), "path")).otherwise(F.col("path"))
    after = docs.where("i % 7 <> 0").select(moved.alias("path"), "size", F.when((F.col("i") % 11 == 0) & (F.col("i") % 13 != 0), -F.col("i")).otherwise(F.col("modified")).alias("modified"))
    return watching.listing_changes(before, after)


def s2_register_stream(spark, d):
    """The arrivals of ``b3_register`` as a stream with state, stopped and started again between three parts of them."""
    docs = stored(t.registry(spark, d).select(F.col("document_id").alias("seq"), "filename", "checksum", F.lit(None).cast("string").alias("session_id")), "arrivals")
    where = f"{shared_folder(spark)}/registered-{uuid.uuid4().hex}"
    cuts = docs.agg(F.percentile_approx("seq", [0.3, 0.7]).alias("c")).first()["c"] or [0, 0]
    for part in (docs.where(F.col("seq") <= cuts[0]), docs.where((F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1])), docs.where(F.col("seq") > cuts[1])):
        part.write.mode("append").parquet(f"{where}/in")
        rows = registration.register_stream(spark.readStream.schema(registration.ARRIVAL).parquet(f"{where}/in"))
        run = rows.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/at").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{where}/out").select("seq", "filename", "outcome", "version")


def l4_incremental_vectors(spark, d):
    """A store that had the documents of two thirds of all ids, a quarter with other texts, brought up to date; by which batch each
    document's current vector was made."""
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    store = flows.VectorStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    encoder = HashedEncoder()
    store.update(docs.where("chunk_id % 3 <> 0").withColumn("text", F.when(F.col("chunk_id") % 4 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))), encoder, 0)
    for epoch in (1, 1, 2):  # a replay, and a run that finds nothing to do
        store.update(docs, encoder, epoch)
    made = store.current(docs, encoder.name).join(store.read(encoder.name).select("chunk_id", "epoch", "dims"), "chunk_id")
    return made.select("chunk_id", "epoch", "dims", F.size(F.filter("vector", lambda x: x > 0)).alias("slots"))


class _Clerk:
    """A scripted model: looks a document up, then counts its source, then answers; some tasks fail, ask for a tool that isn't
    there, or never end. It doesn't take the option ``think``."""

    def reply(self, system, messages, options):
        if "think" in options:
            raise agents.UnsupportedOption("think")
        n = int(messages[0]["content"].split()[-1])
        last = messages[-1]
        if n % 13 == 5:
            raise LLMError(f"no answer to {n}")
        call = lambda tool, **arguments: {"text": None, "calls": [{"id": f"c{len(messages)}", "name": tool, "arguments": arguments}]}
        if last["role"] == "user" or n % 7 == 3:
            return call("missing" if n % 11 == 4 else "document", id=n * 3)
        if last["content"] == agents.NO_TOOL:
            return {"text": last["content"]}
        found = json.loads(last["content"])
        return call("source", name=found["source"]) if "doc_id" in found else {"text": f"{found['source']} has {found['n']} documents"}


def a23_agents(spark, d):
    """An agent's answer to each benchmark item, over documents and their sources as tools."""
    docs = t.table(spark, d, "documents")
    tools = {"document": agents.table_tool(docs.select("doc_id", "source"), "doc_id", "id"), "source": agents.table_tool(docs.groupBy("source").agg(F.count("*").alias("n")), "source", "name")}
    tasks = t.table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("description"))
    return agents.run_agents(tasks, _Clerk, tools, f"{shared_folder(spark)}/agents-{uuid.uuid4().hex}", {"think": True})


def d19_token_usage(spark, d):
    u = t.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.floor("value").alias("prompt"), (F.col("event_id") % 13).alias("completion"))
    return planning.token_usage(u)


def b12_sse_events(spark, d):
    e = t.table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 17 == 0, "close").otherwise(F.col("event_type")).alias("event"))
    out = planning.until_terminal(e)
    return out.select("stream_id", "seq", text.sse_event(F.col("event"), F.to_json(F.struct("seq"))).alias("message"))


def s1_debounce(spark, d):
    out = files.debounced(t.table(spark, d, "events"), key="user_id", quiet="1 hour")
    return out.select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("fires_at", "yyyy-MM-dd HH:mm:ss").alias("fires_at"), "events")


def s7_last_activity(spark, d):
    out = files.last_activity(t.table(spark, d, "events"), key="user_id")
    return out.select("user_id", F.date_format("last_active_at", "yyyy-MM-dd HH:mm:ss").alias("last_active_at"))


def d20_status_summary(spark, d):
    return t.registry(spark, d).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (n1_waves, c8_unknown_dependencies, n4_contexts, h29_synthesis_prompts, n3_execute, n1_plan_failures, e13_chain_waves, p6_evaluation, a13_listing_changes, s2_register_stream, l4_incremental_vectors, a23_agents, d19_token_usage, b12_sse_events, s1_debounce, s7_last_activity, d20_status_summary)}

TASKS = """tasks AS (SELECT CAST(o_custkey AS VARCHAR) AS plan_id, CAST(pos AS INTEGER) AS pos, CAST(pos AS VARCHAR) AS task_id, o_orderpriority AS sub_query,
      CASE WHEN pos = 1 THEN [] WHEN pos % 3 = 0 THEN [CAST(pos // 2 AS VARCHAR), '1'] ELSE [CAST(pos // 2 AS VARCHAR)] END AS deps
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders))"""
ORACLES = {
    "n1_waves": f"""WITH {TASKS}, w AS (SELECT plan_id, task_id, pos, CAST(floor(log2(pos) + 1e-9) AS INTEGER) AS wave FROM tasks)
        SELECT plan_id, task_id, wave, pos = 1 AND count(*) OVER (PARTITION BY plan_id, wave) > 1 AS is_parallelizable FROM w""",
    "c8_unknown_dependencies": f"WITH {TASKS} SELECT plan_id, '5 depends on unknown 999' AS error FROM tasks WHERE pos = 5",
    "n4_contexts": f"""WITH {TASKS}, x AS (SELECT plan_id, task_id, unnest(deps) AS dep, unnest(range(len(deps))) AS k FROM tasks)
        SELECT x.plan_id, x.task_id, string_agg('--- Prior Findings from Dependency Task [' || dep || '] ---' || chr(10) || CASE WHEN p.pos % 4 <> 0 THEN 'result of ' || dep ELSE 'No output returned.' END, chr(10) || chr(10) ORDER BY k) AS context
        FROM x JOIN tasks p ON p.plan_id = x.plan_id AND p.task_id = x.dep GROUP BY ALL""",
    "h29_synthesis_prompts": f"""WITH {TASKS} SELECT plan_id, string_agg('### Node [' || task_id || ']' || chr(10) || '**Task Target:** ' || sub_query || chr(10) || '**Status:** ' || CASE WHEN pos % 5 = 0 THEN 'failed' ELSE 'completed' END || chr(10)
            || '**Findings & Sources:**' || chr(10) || CASE WHEN pos % 4 <> 0 THEN 'result of ' || task_id ELSE 'No findings recorded.' END || chr(10), chr(10) || chr(10) ORDER BY pos) AS prompt FROM tasks GROUP BY plan_id""",
    "n3_execute": f"""WITH {TASKS}, x AS (SELECT plan_id, task_id, unnest(deps) AS dep FROM tasks),
        f AS (SELECT x.plan_id, x.task_id, count(*) FILTER (p.sub_query = '5-LOW') AS failed FROM x JOIN tasks p ON p.plan_id = x.plan_id AND p.task_id = x.dep GROUP BY ALL)
        SELECT plan_id, task_id, CASE WHEN sub_query = '5-LOW' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN sub_query = '5-LOW' THEN 'task failed' ELSE sub_query || ' after ' || len(deps) || ' with ' || coalesce(failed, 0) || ' failed' END AS result FROM tasks LEFT JOIN f USING (plan_id, task_id)""",
    "n1_plan_failures": f"""WITH {TASKS}, c AS (SELECT plan_id, CAST(plan_id AS BIGINT) AS n, max(pos) AS m FROM tasks GROUP BY plan_id)
        SELECT plan_id, CASE WHEN n % 2 = 0 AND m = 1 THEN 'Task ''1'' depends on non-existent task ''2''.' WHEN n % 3 = 1 AND m >= 4 THEN 'Task ''4'' depends on non-existent task ''x''.'
               ELSE 'Circular dependency detected in execution plan sub-tasks.' END AS error FROM c WHERE n % 2 = 0 OR (n % 3 = 1 AND m >= 4)""",
    "e13_chain_waves": "SELECT CAST(user_id AS VARCHAR) AS plan_id, CAST(event_id AS VARCHAR) AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) - 1 AS INTEGER) AS wave FROM events",
    "p6_evaluation": """WITH c AS (SELECT item_id AS case_id, length(text) AS n, row_number() OVER (ORDER BY -item_id) - 1 AS k FROM benchmark), q AS (SELECT coalesce(min(k) FILTER (n % 37 = 36), 1 << 40) AS e FROM c)
        SELECT case_id, CASE WHEN k < e THEN k END AS nth, CASE WHEN k >= e THEN NULL WHEN n % 5 = 0 THEN 'error' WHEN n % 2 = 1 THEN 'answered' ELSE 'not_found' END AS status,
               CASE WHEN k >= e THEN NULL WHEN n % 5 = 0 THEN 'error at ' || n WHEN n % 2 = 1 THEN n || ' characters' ELSE '' END AS answer, k >= e OR n % 5 = 0 AS redo FROM c, q""",
    "a13_listing_changes": """WITH d AS (SELECT doc_id AS i, 'f' || doc_id AS path FROM documents)
        SELECT CASE WHEN i % 5 = 0 THEN 'created' WHEN i % 7 = 0 THEN 'deleted' WHEN i % 13 = 0 THEN 'moved' ELSE 'modified' END AS kind, path, CASE WHEN i % 5 <> 0 AND i % 7 <> 0 AND i % 13 = 0 THEN 'm' || path END AS moved_to
        FROM d WHERE (i % 5 = 0 AND i % 7 <> 0) OR (i % 5 <> 0 AND (i % 7 = 0 OR i % 13 = 0 OR i % 11 = 0))""",
    "s2_register_stream": registry.ORACLES["b3_register"],
    "l4_incremental_vectors": f"""WITH {retrieval.TOK}, {retrieval._slots('dv', 'chunk_id', 'tok')}
        SELECT tok.chunk_id, CAST(CASE WHEN tok.chunk_id % 3 <> 0 AND tok.chunk_id % 4 <> 0 THEN 0 ELSE 1 END AS BIGINT) AS epoch, 64 AS dims, CAST(count(dv.slot) AS INTEGER) AS slots FROM tok LEFT JOIN dv USING (chunk_id) GROUP BY tok.chunk_id""",
    "a23_agents": """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT item_id AS i FROM benchmark),
        r AS (SELECT b.i, d.doc_id, s.source, s.n, CASE WHEN b.i % 13 = 5 THEN 'error' WHEN b.i % 7 = 3 THEN 'max_iterations_reached' ELSE 'completed' END AS status, (b.i % 11 = 4 OR d.doc_id IS NULL) AS none
            FROM b LEFT JOIN documents d ON d.doc_id = b.i * 3 LEFT JOIN s ON s.source = d.source)
        SELECT i AS task_id, status, CAST(CASE WHEN status = 'completed' THEN CASE WHEN none THEN 2 ELSE 3 END END AS INTEGER) AS iterations,
               CASE WHEN status = 'completed' THEN CASE WHEN none THEN 'Tool not found' ELSE source || ' has ' || n || ' documents' END END AS result, CASE WHEN status = 'error' THEN 'no answer to ' || i END AS error FROM r""",
    "d19_token_usage": """SELECT coalesce(event_type, 'all') AS stage, CAST(sum(floor(value)) AS BIGINT) AS prompt, CAST(sum(event_id % 13) AS BIGINT) AS completion, CAST(sum(floor(value)) + sum(event_id % 13) AS BIGINT) AS total FROM events GROUP BY ROLLUP (event_type)""",
    "b12_sse_events": """WITH e AS (SELECT user_id AS stream_id, event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'close' ELSE event_type END AS event FROM events),
        m AS (SELECT stream_id, min(seq) AS last FROM e WHERE event IN ('close', 'error') GROUP BY stream_id)
        SELECT stream_id, seq, 'event: ' || event || chr(10) || 'data: {"seq":' || seq || '}' || chr(10) || chr(10) AS message FROM e LEFT JOIN m USING (stream_id) WHERE last IS NULL OR seq <= last""",
    "s1_debounce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS n FROM events),
        s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS fires_at, count(*) AS events FROM s GROUP BY user_id, k""",
    "s7_last_activity": "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_active_at FROM events GROUP BY user_id",
    "d20_status_summary": f"WITH {t.REGISTRY_SQL} SELECT status, count(*) AS n FROM registry GROUP BY status",
}
