"""Task graphs: waves, contexts, execution and reports.

tasks: plan_id, task_id, pos, sub_query, task_type, depends_on array<string>.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship, shared_folder, stored

# The errors of a plan that can't be run.
UNKNOWN = "Task '%s' depends on non-existent task '%s'."
CIRCULAR = "Circular dependency detected in execution plan sub-tasks."

#: Tasks of the plans that a task solves by itself; longer plans are solved in rounds over all of them.
MOST_TASKS = 10_000


def plan_errors(tasks: DataFrame) -> DataFrame:
    """(plan_id, error): dependencies on unknown tasks (C8) and repeated task ids."""
    deps = tasks.select("plan_id", "task_id", F.explode("depends_on").alias("dep"))
    unknown = deps.join(tasks.select("plan_id", F.col("task_id").alias("dep")), ["plan_id", "dep"], "left_anti")
    unknown = unknown.select("plan_id", F.concat(F.col("task_id"), F.lit(" depends on unknown "), F.col("dep")).alias("error"))
    twice = tasks.groupBy("plan_id", "task_id").count().where("count > 1").select("plan_id", F.concat(F.lit("circular dependency: "), F.col("task_id")).alias("error"))
    return unknown.unionByName(twice)


def plan_failures(tasks: DataFrame) -> DataFrame:
    """(plan_id, error) of the plans that can't be run, one error each: the first dependency on an unknown task
    in the order of tasks and of their dependencies, else a circular dependency (N1)."""
    few, many = _by_size(tasks.select("plan_id", "task_id", "pos", "depends_on"))
    rows = _solved(few).groupBy("plan_id").agg(F.min(F.when(F.col("nth").isNotNull(), F.struct("pos", "nth", "task_id", "missing"))).alias("x"), F.bool_or(F.col("wave").isNull()).alias("stuck"))
    error = F.when(F.col("x").isNotNull(), F.format_string(UNKNOWN, "x.task_id", "x.missing")).otherwise(CIRCULAR)
    found = rows.where(F.col("x").isNotNull() | F.col("stuck")).select("plan_id", error.alias("error"))
    if many is None:
        return found
    deps = many.select("plan_id", "task_id", "pos", F.posexplode("depends_on").alias("nth", "dep"))
    unknown = deps.join(many.select("plan_id", F.col("task_id").alias("dep")), ["plan_id", "dep"], "left_anti")
    first = unknown.groupBy("plan_id").agg(F.min(F.struct("pos", "nth", "task_id", "dep")).alias("x"))
    first = first.select("plan_id", F.format_string(UNKNOWN, "x.task_id", "x.dep").alias("error"))
    stuck = _waves_in_rounds(many).where("wave is null").select("plan_id").distinct().join(first, "plan_id", "left_anti")
    return found.unionByName(first).unionByName(stuck.withColumn("error", F.lit(CIRCULAR)))


def _by_size(tasks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The tasks of plans that fit into a task, and those of longer plans, if there are any."""
    long = stored(tasks.groupBy("plan_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_TASKS).select(F.col("plan_id").alias("long")), "long-plans")
    if long.isEmpty():
        return tasks, None
    same = F.col("plan_id").eqNullSafe(F.col("long"))
    return tasks.join(long, same, "left_anti"), tasks.join(long, same, "left_semi")


def _levels(t: pa.Table) -> list[pa.Array]:
    """wave, is_parallelizable, nth and missing of the tasks of whole plans: waves as in ``waves``, the place and name of the
    first unknown dependency of each."""
    n, deps = t.num_rows, t["depends_on"].combine_chunks()
    plan = t["plan_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    named = pc.is_valid(t["plan_id"]).to_numpy()
    owner, flat = pc.list_parent_indices(deps).to_numpy(), deps.flatten()
    names = pa.concat_arrays([t["task_id"].combine_chunks(), flat]).dictionary_encode()
    none = len(names.dictionary)
    code = names.indices.fill_null(none).to_numpy().astype(np.int64)
    nodes, node = np.unique(plan * (none + 1) + code[:n], return_inverse=True)
    wanted = plan[owner] * (none + 1) + code[n:]
    at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
    known = (nodes[at] == wanted) & (code[n:] < none) & named[owner]
    # Kahn's levels of all plans together: each round follows the edges of the tasks that it settles.
    order = np.argsort(at[known], kind="stable")
    to, ends = node[owner[known]][order], np.searchsorted(at[known][order], np.arange(len(nodes) + 1))
    open_, level = np.bincount(to, minlength=len(nodes)), np.full(len(nodes), -1)
    front, k = np.flatnonzero(open_ == 0), 0
    while len(front):
        level[front] = k
        size = ends[front + 1] - ends[front]
        edges = np.repeat(ends[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
        hit, times = np.unique(to[edges], return_counts=True)
        open_[hit] -= times
        front, k = hit[open_[hit] == 0], k + 1
    _, group, width = np.unique(nodes // (none + 1) * (k + 2) + level, return_inverse=True, return_counts=True)
    free = pc.equal(pc.list_value_length(deps), 0).fill_null(False).to_numpy(zero_copy_only=False)
    wave = level[node]
    who, first = np.unique(owner[~known], return_index=True)
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    place, name = np.full(n, -1), np.full(n, -1)
    place[who], name[who] = nth[~known][first], np.flatnonzero(~known)[first]
    return [pa.array(wave, pa.int32(), mask=wave < 0), pa.array((width[group][node] > 1) & free & (wave >= 0)), pa.array(place, pa.int32(), mask=place < 0), flat.take(pa.array(name, mask=name < 0))]


def _solved(tasks: DataFrame) -> DataFrame:
    """tasks, whose plans each fit into a task, with the columns of ``_levels``: one shuffle by plan, and batches of whole plans."""
    ship(tasks.sparkSession)
    schema = StructType([*tasks.schema.fields, *StructType.fromDDL("wave int, is_parallelizable boolean, nth int, missing string").fields])
    names = [f.name for f in schema.fields]

    def done(t: pa.Table, kinds: list):
        if t.num_rows:
            t = t.combine_chunks()
            yield from pa.table([*t.columns, *(c.cast(k) for c, k in zip(_levels(t), kinds, strict=True))], names=names).combine_chunks().to_batches()

    def run(batches):
        kinds, held = [pa.int32(), pa.bool_(), pa.int32(), pa.string()], []
        for b in batches:
            # A plan may go on in the next batch: what the last one has is held back.
            plans = b.column(names.index("plan_id")).dictionary_encode(null_encoding="encode").indices.to_numpy()
            if not len(plans):
                continue
            if held and held[-1].column(names.index("plan_id"))[-1] != b.column(names.index("plan_id"))[0]:
                yield from done(pa.Table.from_batches(held), kinds)
                held = []
            cut = int(np.flatnonzero(np.diff(plans, prepend=-1))[-1])
            if cut:
                yield from done(pa.Table.from_batches([*held, b.slice(0, cut)]), kinds)
                held = []
            held.append(b.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held), kinds)

    return tasks.repartition("plan_id").sortWithinPartitions("plan_id").mapInArrow(run, schema)


def waves(tasks: DataFrame) -> DataFrame:
    """(plan_id, task_id, wave, is_parallelizable); the wave is null on or behind a cycle (N1, E13). Plans of at most
    ``MOST_TASKS`` are solved whole, many in one task; longer ones in rounds."""
    few, many = _by_size(tasks.select("plan_id", "task_id", "depends_on"))
    cols = ["plan_id", "task_id", "wave", "is_parallelizable"]
    rows = _solved(few).where("plan_id is not null and task_id is not null").select(*cols)
    return rows if many is None else rows.unionByName(_waves_in_rounds(many).select(*cols))


def _waves_in_rounds(tasks: DataFrame) -> DataFrame:
    """``waves`` of plans of any size.

    A task's wave is the greatest of ``base`` and of dep's wave + w over its open edges (dep, w). In each round
    edges to tasks whose wave is known go into the base, and a task without open edges is known. Edges to a task with
    one open edge skip it, which makes chains half as long: so the rounds of a chain or tree grow with the
    logarithm of its depth, and no graph takes more than one for each wave. Dependencies on unknown tasks are ignored.
    A round that finds no wave has cycles alone before it."""
    key = ["plan_id", "task_id"]
    ids = tasks.select(*key).distinct()
    edges = tasks.select(*key, F.explode("depends_on").alias("dep"), F.lit(1).cast("bigint").alias("w")).distinct()
    edges = stored(edges.join(ids.select("plan_id", F.col("task_id").alias("dep")), ["plan_id", "dep"], "left_semi").select(*key, "dep", "w"), "edges")
    base = stored(edges.select(*key).distinct().withColumn("base", F.lit(0).cast("bigint")), "base")
    most = base.count() + 1  # no path without a cycle is longer
    fresh = stored(ids.join(base, key, "left_anti").withColumn("wave", F.lit(0).cast("bigint")), "wave")
    found = [fresh]
    while True:
        known = fresh.select("plan_id", F.col("task_id").alias("dep"), "wave")
        edges = stored(edges.join(known, ["plan_id", "dep"], "left"), "edges")
        settled = edges.where("wave is not null").groupBy(*key).agg(F.max(F.col("wave") + F.col("w")).alias("least"))
        open_ = edges.where("wave is null").select(*key, "dep", "w")
        ends = open_.groupBy(*key).agg(F.count("*").alias("n"), F.first("dep").alias("to"), F.first("w").alias("by"))
        base = stored(base.join(settled, key, "left").join(ends, key, "left").select(*key, F.greatest("base", F.coalesce("least", "base")).alias("base"), "n", "to", "by"), "base")
        fresh = base.where("n is null").select(*key, F.col("base").alias("wave"))
        if fresh.isEmpty():
            break
        found.append(fresh)
        base = base.where("n is not null")
        links = base.where("n = 1 and to <> task_id").select("plan_id", F.col("task_id").alias("dep"), "to", "by", F.col("base").alias("floor"))
        edges = stored(open_.join(links, ["plan_id", "dep"], "left"), "edges")
        over = edges.where("to is not null").groupBy(*key).agg(F.max(F.col("floor") + F.col("w")).alias("least"))
        base = base.join(over, key, "left").select(*key, F.least(F.greatest("base", F.coalesce("least", "base")), F.lit(most)).alias("base"))
        edges = edges.groupBy(*key, F.coalesce("to", "dep").alias("dep")).agg(F.least(F.max(F.col("w") + F.coalesce("by", F.lit(0))), F.lit(most)).alias("w"))
    stuck = base.select(*key, F.lit(None).cast("bigint").alias("wave"))
    rows = reduce(DataFrame.unionByName, [*found, stuck]).withColumn("wave", F.col("wave").cast("int"))
    wide = rows.groupBy("plan_id", "wave").agg(F.count("*").alias("width"))
    free = tasks.select("plan_id", "task_id", (F.size("depends_on") == 0).alias("free"))
    rows = rows.join(wide, ["plan_id", "wave"], "left").join(free, key)
    return rows.select(*key, "wave", F.coalesce((F.col("width") > 1) & F.col("free"), F.lit(False)).alias("is_parallelizable"))


# The formats of a task's context and of the results in the report's prompt.
CONTEXT = "--- Prior Findings from Dependency Task [%s] ---\n%s"
RESULT = "### Node [%s]\n**Task Target:** %s\n**Status:** %s\n**Findings & Sources:**\n%s\n"
NO_OUTPUT, NO_TARGET, NO_STATUS, NO_FINDINGS = "No output returned.", "N/A", "completed", "No findings recorded."


def _in_order(part: Column) -> Column:
    """The parts of a group by ``pos``, an empty line between them."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "\n\n")


def contexts(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, task_id, context): the results of a task's dependencies in their order.
    Tasks without dependencies have no row."""
    deps = tasks.select("plan_id", "task_id", F.posexplode("depends_on").alias("pos", "dep"))
    rows = deps.join(results.select("plan_id", F.col("task_id").alias("dep"), "result"), ["plan_id", "dep"], "left")
    part = F.format_string(CONTEXT, F.col("dep"), F.coalesce("result", F.lit(NO_OUTPUT)))
    return rows.groupBy("plan_id", "task_id").agg(_in_order(part).alias("context"))


def render_results(results: DataFrame) -> DataFrame:
    """(plan_id, prompt): all results in plan order with their defaults."""
    part = F.format_string(RESULT, F.col("task_id"), F.coalesce("sub_query", F.lit(NO_TARGET)), F.coalesce("status", F.lit(NO_STATUS)), F.coalesce("result", F.lit(NO_FINDINGS)))
    return results.groupBy("plan_id").agg(_in_order(part).alias("prompt"))


def execute(tasks: DataFrame, run_task: Callable[[str, str], str]) -> DataFrame:
    """(plan_id, task_id, status, result): waves one after another, the tasks of a wave in parallel.

    A task that raises is ``failed`` with its message and does not stop the others. Each wave's results are appended to
    a table in the shared folder, where the next one finds its contexts."""
    spark = tasks.sparkSession
    ship(spark)
    schema, path = "plan_id string, task_id string, status string, result string", f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    few, many = _by_size(tasks.select("plan_id", "task_id", "sub_query", "depends_on"))
    rows = _solved(few).where("plan_id is not null and task_id is not null").select(*few.columns, "wave")
    if many is not None:
        rows = rows.unionByName(many.join(_waves_in_rounds(many).select("plan_id", "task_id", "wave"), ["plan_id", "task_id"]).select(*rows.columns))
    planned = stored(rows, "planned")

    def run(batches):
        for df in batches:
            rows = []
            for t in df.itertuples(index=False):
                try:
                    rows.append((t.plan_id, t.task_id, "completed", run_task(t.sub_query, t.context or "")))
                except Exception as e:  # one task's failure is its own result
                    rows.append((t.plan_id, t.task_id, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["plan_id", "task_id", "status", "result"])

    for wave in range((planned.agg(F.max("wave")).first()[0] or 0) + 1):
        now = planned.where(F.col("wave") == wave)
        done = spark.read.schema(schema).parquet(path) if wave else spark.createDataFrame([], schema)
        ready = now.select("plan_id", "task_id", "sub_query").join(contexts(now, done), ["plan_id", "task_id"], "left")
        ready.mapInPandas(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def token_usage(usage: DataFrame) -> DataFrame:
    """(stage, prompt, completion, total), with the totals under the stage ``all``."""
    sums = usage.rollup("stage").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    return sums.select(F.coalesce("stage", F.lit("all")).alias("stage"), "prompt", "completion", (F.col("prompt") + F.col("completion")).alias("total"))


def until_terminal(events: DataFrame) -> DataFrame:
    """Progress events up to the first ``close`` or ``error`` of each stream."""
    end = events.where(F.col("event").isin("close", "error")).groupBy("stream_id").agg(F.min("seq").alias("end"))
    return events.join(end, "stream_id", "left").where("end is null or seq <= end").drop("end")
