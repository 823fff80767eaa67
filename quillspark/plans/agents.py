"""Agents that answer tasks in rounds of model calls and tool calls, for many tasks at once.

In each round the model sees the messages of every open task, by tasks in parallel; the calls it asks for are rows,
and each tool answers all of its calls as one join. Messages are a table in a folder, one part for each
round, so a run that broke off goes on after its last whole round. What a model has turned out not to
take is part of that table too: the call is repeated without it once, and later rounds leave it out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.models import LLMError

MAX_ROUNDS = 6
# The prompts of an agent, and what an unknown tool answers.
SYSTEM = "You are an expert Research Agent. Gather accurate facts for the sub-task using web search and scraper tools. Summarize findings clearly with sources."
TASK, CONTEXT, NO_TOOL = "SubTask: %s", "\nContext:\n%s", "Tool not found"

#: A turn: a message of a role, or (role ``call``) a tool call that the model asks for. ``off`` names an option that it doesn't take.
TURN = "seq int, role string, content string, call_id string, name string, arguments string, off string"


class UnsupportedOption(LLMError):
    """The model doesn't take an option that was sent along."""

    def __init__(self, option: str):
        super().__init__(f"unsupported option {option}")
        self.option = option


class Model(Protocol):
    def reply(self, system: str, messages: list[dict], options: dict) -> dict:
        """text, and calls as dicts with id, name and arguments (a dict); messages have role, content and call_id."""


def _committed(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def run_agents(
    tasks: DataFrame,
    make: Callable[[], Model],
    tools: dict[str, Callable[[DataFrame], DataFrame]],
    path: str,
    options: dict | None = None,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """(task_id, status, iterations, result, error) of tasks (task_id, description, context or null).

    Status is ``completed`` with the first reply without calls, ``error`` where the model failed, and
    ``max_iterations_reached`` after so many rounds. A tool gets its calls (call_key, arguments: JSON) and gives
    (call_key, output); a call without an answer, or of a tool that isn't there, has the output of ``NO_TOOL``.
    ``path`` is a folder that all executors share; the same path goes on with the run that it holds."""
    spark = tasks.sparkSession
    ship(spark)
    id_type = dict(tasks.dtypes)["task_id"]
    schema = f"task_id {id_type}, {TURN}"

    def part(n: int) -> str:
        return f"{path}/round={n}"

    def turns(before: int) -> DataFrame:
        return spark.read.schema(f"{schema}, round int").option("basePath", path).parquet(*(part(n) for n in range(before)))

    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in TURN.split(", ")}
    if not _committed(spark, part(0)):
        prompt = F.format_string(TASK, "description")
        if "context" in tasks.columns:
            prompt = F.when(F.coalesce("context", F.lit("")) == "", prompt).otherwise(F.concat(prompt, F.format_string(CONTEXT, "context")))
        first = {**empty, "seq": F.lit(0), "role": F.lit("user"), "content": prompt}
        tasks.select("task_id", *(c.alias(n) for n, c in first.items())).write.mode("overwrite").parquet(part(0))

    for n in range(1, max_rounds + 1):
        if _committed(spark, part(n)):
            continue
        known = turns(n)
        off = [r["off"] for r in known.where("off is not null").select("off").distinct().collect()]  # options have few names
        sent = {k: v for k, v in (options or {}).items() if k not in off}
        ended = known.where("role in ('final', 'error')").select("task_id").distinct()
        message = F.struct("round", "seq", "role", "content", "call_id", "name", "arguments")
        open_ = known.join(ended, "task_id", "left_anti").where("role <> 'option'").groupBy("task_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
        if open_.isEmpty():
            break

        def ask(batches, sent=sent):
            model = make()
            for df in batches:
                rows = []
                for t in df.itertuples(index=False):
                    messages = [{k: m[k] for k in ("role", "content", "call_id", "name", "arguments")} for m in t.messages]
                    try:
                        try:
                            reply = model.reply(SYSTEM, messages, dict(sent))
                        except UnsupportedOption as e:  # once more without it, and remembered
                            sent.pop(e.option, None)
                            rows.append((t.task_id, 0, "option", None, None, None, None, e.option))
                            reply = model.reply(SYSTEM, messages, dict(sent))
                    except LLMError as e:
                        rows.append((t.task_id, 1, "error", str(e), None, None, None, None))
                        continue
                    calls = reply.get("calls") or []
                    rows.append((t.task_id, 1, "assistant" if calls else "final", reply.get("text"), None, None, None, None))
                    rows += [(t.task_id, 2 + k, "call", None, c["id"], c["name"], json.dumps(c["arguments"], sort_keys=True, ensure_ascii=False), None) for k, c in enumerate(calls)]
                yield pd.DataFrame(rows, columns=["task_id", *(c.split()[0] for c in TURN.split(", "))])

        # The model's turns are written before tools see them: no model is asked twice for one round.
        asked = f"{path}/asked={n}"
        if not _committed(spark, asked):
            open_.mapInPandas(ask, schema).write.mode("overwrite").parquet(asked)
        said = spark.read.schema(schema).parquet(asked)
        calls = said.where("role = 'call'").withColumn("call_key", F.concat_ws("\n", F.col("task_id").cast("string"), F.col("seq").cast("string")))
        answers = spark.createDataFrame([], "call_key string, output string")
        for name, tool in tools.items():
            answers = answers.unionByName(tool(calls.where(F.col("name") == name).select("call_key", "arguments")).select("call_key", "output"))
        results = calls.join(answers, "call_key", "left")
        answered = {**empty, "seq": F.col("seq") + 100_000, "role": F.lit("tool"), "content": F.coalesce("output", F.lit(NO_TOOL)), "call_id": F.col("call_id"), "name": F.col("name")}
        said.unionByName(results.select("task_id", *(c.alias(k) for k, c in answered.items()))).write.mode("overwrite").parquet(part(n))

    last = 0
    while _committed(spark, part(last + 1)):
        last += 1
    ends = turns(last + 1).where("role in ('final', 'error')").select("task_id", "role", "content", "round")
    rows = tasks.select("task_id").distinct().join(ends, "task_id", "left")
    status = F.when(F.col("role") == "final", "completed").when(F.col("role") == "error", "error").otherwise("max_iterations_reached")
    return rows.select("task_id", status.alias("status"), F.when(F.col("role") == "final", F.col("round")).alias("iterations"), F.when(F.col("role") == "final", F.coalesce("content", F.lit(""))).alias("result"), F.when(F.col("role") == "error", F.col("content")).alias("error"))


def table_tool(table: DataFrame, key: str, argument: str) -> Callable[[DataFrame], DataFrame]:
    """A tool that looks an argument up in the column of a table with unique keys, and gives the row as JSON."""

    def answer(calls: DataFrame) -> DataFrame:
        asked = calls.select("call_key", F.get_json_object("arguments", f"$.{argument}").cast(dict(table.dtypes)[key]).alias(key))
        return asked.join(table, key).select("call_key", F.to_json(F.struct(*table.columns)).alias("output"))

    return answer
