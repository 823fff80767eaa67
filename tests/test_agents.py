"""Agents in rounds over tables, against a plain loop."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.plans import agents
from quillspark.sources.models import LLMError


class Scripted:
    """Each task's description says what its replies are: tool names, ``!`` for a failure, ``.`` for an answer."""

    crash = None

    def reply(self, system, messages, options):
        if "think" in options and "odd" in messages[0]["content"]:
            raise agents.UnsupportedOption("think")
        script = messages[0]["content"].split("\n")[0].split()[2:]
        n = sum(m["role"] == "assistant" for m in messages)
        step = script[n] if n < len(script) else "."
        seen = [(m["role"], m["content"], m["call_id"]) for m in messages]
        if self.crash is not None and n == self.crash:
            raise RuntimeError("the worker was lost")
        if step == "!":
            raise LLMError(f"failed after {n}")
        if step == ".":
            return {"text": json.dumps([seen, sorted(options)])}
        return {"text": f"asks {step}", "calls": [{"id": f"{n}.{k}", "name": name, "arguments": {"key": f"k{n}"}} for k, name in enumerate(step.split("+"))]}


def plain(tasks, tools, options):
    out, off = {}, {}
    for task, description, context in tasks:
        messages = [{"role": "user", "content": f"SubTask: {description}" + (f"\nContext:\n{context}" if context else ""), "call_id": None}]
        out[task] = ("max_iterations_reached", None, None, None)
        for n in range(1, 7):
            sent = {k: v for k, v in options.items() if off.get(k, n + 1) >= n and not (k == "think" and "odd" in description)}
            try:
                reply = Scripted().reply("", messages, sent)
            except LLMError as e:
                out[task] = ("error", None, None, str(e))
                break
            if not reply.get("calls"):
                out[task] = ("completed", n, reply["text"], None)
                break
            calls = [{"role": "call", "content": None, "call_id": c["id"]} for c in reply["calls"]]
            results = [{"role": "tool", "content": tools.get(c["name"], {}).get(c["arguments"]["key"], "Tool not found"), "call_id": c["id"]} for c in reply["calls"]]
            messages += [{"role": "assistant", "content": reply["text"], "call_id": None}, *calls, *results]
    return out


TASKS = [(1, "do .", None), (2, "do a a+b .", "before"), (3, "do a !", ""), (4, "do c .", None), (5, "do a b a b a b a", None), (6, "do b+b+a a .", "x"), (7, "odd a .", None)]
TOOLS = {"a": {f"k{n}": json.dumps({"key": f"k{n}", "v": n}, separators=(",", ":")) for n in range(9)}, "b": {"k1": '{"key":"k1","w":"x"}'}}


def frames(spark):
    a = spark.createDataFrame([(f"k{n}", n) for n in range(9)], "key string, v int")
    b = spark.createDataFrame([("k1", "x")], "key string, w string")
    return spark.createDataFrame(TASKS, "task_id int, description string, context string").repartition(3), {"a": agents.table_tool(a, "key", "key"), "b": agents.table_tool(b, "key", "key")}


def outcome(df):
    return {r["task_id"]: (r["status"], r["iterations"], r["result"], r["error"]) for r in df.collect()}


def test_many_tasks_equal_the_loop(spark, tmp_path):
    tasks, tools = frames(spark)
    got = outcome(agents.run_agents(tasks, Scripted, tools, f"file://{tmp_path}/run"))
    assert got == plain(TASKS, TOOLS, {})


def test_a_refused_option_is_remembered(spark, tmp_path):
    tasks, tools = frames(spark)
    got = outcome(agents.run_agents(tasks, Scripted, tools, f"file://{tmp_path}/run", {"think": True, "other": 1}))
    # One task refused it in the first round: the later rounds of all leave it out.
    assert json.loads(got[7][2])[1] == ["other"] and json.loads(got[2][2])[1] == ["other"]
    rows = spark.read.option("basePath", f"{tmp_path}/run").parquet(*(f"{tmp_path}/run/round={n}" for n in (1, 2)))
    assert {(r["task_id"], r["off"], r["round"]) for r in rows.where("off is not null").collect()} == {(7, "think", 1)}


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    tasks, tools = frames(spark)

    class Crashing(Scripted):
        crash = 2

    with pytest.raises(Exception, match="worker was lost"):
        agents.run_agents(tasks, Crashing, tools, f"file://{tmp_path}/run")

    class Late(Scripted):
        def reply(self, system, messages, options):
            if sum(m["role"] == "assistant" for m in messages) < 2:
                raise RuntimeError("asked again")
            return super().reply(system, messages, options)

    assert outcome(agents.run_agents(tasks, Late, tools, f"file://{tmp_path}/run")) == plain(TASKS, TOOLS, {})


def test_no_tasks(spark, tmp_path):
    tasks, tools = frames(spark)
    assert agents.run_agents(tasks.where(F.lit(False)), Scripted, tools, f"file://{tmp_path}/run").count() == 0
