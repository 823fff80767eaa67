"""Task graphs, evaluation and vector stores against plain walks."""

import random

import pytest

from quillspark.operators import planning
from quillspark.plans import flows
from quillspark.sources.models import HashedEncoder, LLMError, QuotaError
from quillspark.streaming import files

TASK = "plan_id string, task_id string, pos int, sub_query string, depends_on array<string>"


def plain_waves(tasks):
    deps = {(p, t): {(p, d) for d in ds if (p, d) in {x[:2] for x in tasks}} for p, t, ds in tasks}
    wave = {}
    while True:
        now = [k for k, ds in deps.items() if k not in wave and all(d in wave for d in ds)]
        if not now:
            return {k: wave.get(k) for k in deps}
        wave |= {k: 1 + max((wave[d] for d in deps[k]), default=-1) for k in now}


@pytest.fixture
def rounds(monkeypatch):
    """The tables that were written, three for each round and three before the first."""
    tags, plain = [], planning.stored
    monkeypatch.setattr(planning, "stored", lambda df, tag: tags.append(tag) or plain(df, tag))
    return tags


def test_waves_of_any_graph_equal_a_plain_walk(spark, rounds):
    rng = random.Random(9)
    tasks = []
    for p in range(40):  # graphs of all kinds, some with cycles, repeated and unknown dependencies
        n = rng.randrange(1, 14)
        for t in range(n):
            before = range(t) if p % 3 else range(n)
            deps = [str(d) for d in before if rng.random() < rng.choice([0.1, 0.3, 0.8])] + ["?"] * (rng.random() < 0.1)
            tasks.append((str(p), str(t), deps + deps[:1]))
    df = spark.createDataFrame([(p, t, 0, "q", d) for p, t, d in tasks], TASK)
    assert {(r["plan_id"], r["task_id"]): r["wave"] for r in planning.waves(df).collect()} == plain_waves(tasks)


def test_a_long_chain_takes_few_rounds(spark, rounds):
    n = 10_000
    chain = [("chain", str(i), 0, "q", [str(i - 1)] if i else []) for i in range(n)]
    # A chain whose every hundredth task also waits for the first, one behind a cycle, and a cycle of three.
    side = [("side", str(i), 0, "q", ["0"] * (i % 100 == 0) + [str(i - 1)] if i else []) for i in range(500)]
    loop = [("loop", "a", 0, "q", ["c"]), ("loop", "b", 0, "q", ["a"]), ("loop", "c", 0, "q", ["b"]), ("loop", "d", 0, "q", ["a"]), ("loop", "e", 0, "q", [])]
    got = {(r["plan_id"], r["task_id"]): r["wave"] for r in planning.waves(spark.createDataFrame(chain + side + loop, TASK)).collect()}
    assert all(got["chain", str(i)] == i for i in range(n)) and all(got["side", str(i)] == i for i in range(500))
    assert [got["loop", x] for x in "abcde"] == [None, None, None, None, 0]
    assert rounds.count("base") - 1 <= 16


def test_failures_of_plans(spark):
    rows = [("a", "1", 0, "q", ["2"]), ("a", "2", 1, "q", ["1"]), ("b", "1", 1, "q", ["x"]), ("b", "2", 0, "q", ["1", "z", "y"]), ("c", "1", 0, "q", []), ("d", "1", 0, "q", ["1"])]
    got = {r["plan_id"]: r["error"] for r in planning.plan_failures(spark.createDataFrame(rows, TASK)).collect()}
    circular = "Circular dependency detected in execution plan sub-tasks."
    assert got == {"a": circular, "b": "Task '2' depends on non-existent task 'z'.", "d": circular}


def test_execution_passes_results_on(spark):
    def run(query, context):
        if query == "bad":
            raise RuntimeError("task failed")
        return f"{query} after {context.count('--- Prior')}"

    rows = [("p", "1", 0, "a", []), ("p", "2", 1, "bad", []), ("p", "3", 2, "c", ["1", "2"]), ("q", "1", 0, "d", ["2"]), ("q", "2", 1, "e", ["1"])]
    got = {(r["plan_id"], r["task_id"]): (r["status"], r["result"]) for r in planning.execute(spark.createDataFrame(rows, TASK), run).collect()}
    assert got == {("p", "1"): ("completed", "a after 0"), ("p", "2"): ("failed", "task failed"), ("p", "3"): ("completed", "c after 2")}


def plain_evaluation(cases, ask):
    out = []
    for i, _, q in sorted(cases, key=lambda c: c[1]):
        try:
            out.append((i, *ask(q)))
        except QuotaError:
            break
        except LLMError as e:
            out.append((i, "error", str(e)))
    return out


@pytest.mark.parametrize("quota", [None, 0, 7, 49])
def test_evaluation_equals_the_loop_and_goes_on(spark, quota):
    def ask(q):
        if quota is not None and q == f"q{quota}" or q == "q49":
            raise QuotaError("no more")
        if int(q[1:]) % 6 == 5:
            raise LLMError("bad reply")
        return "answered", q.upper()

    cases = [(i, 1000 - i * 17 % 53, f"q{i}") for i in range(50)]
    df = spark.createDataFrame(cases, "case_id bigint, pos bigint, question string").repartition(4)
    got = flows.evaluate(df, ask, first=3)
    rows = [(r["case_id"], r["status"], r["answer"]) for r in sorted(got.collect(), key=lambda r: r["nth"])]
    want = plain_evaluation(cases, ask)
    assert rows == want
    again = {r["case_id"] for r in flows.redo(df, got).collect()}
    assert again == {c[0] for c in cases} - {i for i, s, _ in want if s != "error"}
    # The next run asks for these alone.
    asked = flows.evaluate(df, lambda q: ("answered", "now"), done=got)
    assert {r["case_id"] for r in asked.collect()} == again


def test_vectors_are_made_once(spark, tmp_path):
    made = []

    class Counting(HashedEncoder):
        def encode(self, rows, text_col="text"):
            made.append(sorted(r[0] for r in rows.select("chunk_id").collect()))
            return super().encode(rows, text_col)

    schema = "chunk_id string, document_name string, page_number int, text string"
    chunks = [("c", "b.pdf", 1, "gamma"), ("a", "b.pdf", 2, "alpha beta"), ("b", "a.pdf", 1, ""), ("a2", "b.pdf", 2, "alpha beta")]
    store = flows.VectorStore(spark, f"file://{tmp_path}/vectors", "string")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        flows.embed_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, Counting(), f"{tmp_path}/at").awaitTermination(90)

    arrive(chunks)
    arrive(chunks)  # known texts
    changed = [(*chunks[0][:3], "delta"), chunks[1]]
    arrive(changed)
    assert made == [["a", "a2", "b", "c"], [], ["c"]]
    before = sorted(map(tuple, store.read("hashed-64").collect()))
    store.update(spark.createDataFrame(changed, schema), Counting(), 2)  # the batch runs again
    assert sorted(map(tuple, store.read("hashed-64").collect())) == before and made[-1] == ["c"]
    now = spark.createDataFrame([changed[0], *chunks[1:]], schema)
    assert [r["chunk_id"] for r in store.current(now, "hashed-64").collect()] == ["b", "c", "a", "a2"]
    assert store.current(spark.createDataFrame(chunks[:1], schema), "hashed-64").count() == 0  # its vector is of another text
    assert store.read("other").count() == 0


def test_upper_case_suffixes_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.PDF").write_bytes(b"one")
    seen = []
    files.ingest(files.watch(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r["path"] for r in df.select("path").collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert len(seen) == 1


@pytest.mark.parametrize("most", [10_000, 6, 0])
def test_short_plans_are_solved_without_rounds(spark, rounds, monkeypatch, most):
    """Waves, failures and runs are the same whether a plan is solved whole or in rounds, also where plans are cut by batches."""
    monkeypatch.setattr(planning, "MOST_TASKS", most)
    rng = random.Random(8)
    tasks = [(str(p), str(t), [str(d) for d in range(t if p % 4 else 9) if d != t and rng.random() < 0.3] + ["?"] * (p % 7 == 3 and t == 2)) for p in range(40) for t in range(1 + p % 9)]
    df = spark.createDataFrame([(p, t, int(t), "q", d) for p, t, d in tasks], TASK)
    plain = plain_waves(tasks)
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r["plan_id"], r["task_id"]): r["wave"] for r in planning.waves(df).collect()} == plain
        assert ("edges" in rounds) == (most < 10_000)
        unknown = {}
        for p, t, ds in tasks:
            for d in ds:
                if (p, d) not in plain:
                    unknown.setdefault(p, planning.UNKNOWN % (t, d))
        errors = {p: planning.CIRCULAR for (p, _), w in plain.items() if w is None} | unknown
        assert {r["plan_id"]: r["error"] for r in planning.plan_failures(df).collect()} == errors and len(set(errors.values())) > 1
        run = planning.execute(df, lambda query, context: str(context.count("--- Prior")))
        assert {(r["plan_id"], r["task_id"]): r["result"] for r in run.collect()} == {(p, t): str(len(ds)) for p, t, ds in tasks if plain[p, t] is not None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)


def test_encoding_shuffles_no_text(spark):
    df = spark.createDataFrame([(1, "beta alpha beta The"), (2, None), (3, "\U0001d54f é")], "chunk_id long, text string")
    made = HashedEncoder().encode(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["chunk_id"]: {k: round(x, 6) for k, x in enumerate(r["vector"]) if x} for r in made.collect()}
    slot = lambda w: sum(map(ord, w)) % 64
    assert got == {1: {slot("beta"): round(2 / 5**0.5, 6), slot("alpha"): round(1 / 5**0.5, 6)}, 2: {}, 3: {slot("\U0001d54f"): round(0.5**0.5, 6), slot("é"): round(0.5**0.5, 6)}}
