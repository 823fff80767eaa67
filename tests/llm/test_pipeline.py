"""The pipeline against a plain walk through its stages."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in left.collect()}
        out = stage(spark, left, DIR)
        assert out.columns == names
        left = spark.createDataFrame(out.collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in left.collect()}
        assert after.items() <= before.items() and len(after) > 0.5 * len(before)
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in after.values()]
            assert len(norm) == len(set(norm)) and set(norm) == {re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in before.values()}
        if name == "near_dedup":
            from .test_corpus_ops import brute_near

            rows = sorted(before.items())
            assert set(after) == {r[2] for r in brute_near(rows)}
        if name == "decontamination":
            from .test_text_ops import brute_leaks

            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            gone = brute_leaks(sorted(before.items()), items)
            assert set(before) - set(after) == {i for i, _ in gone}
    mix = corpus_pipeline.STAGES[-1][1](spark, left, DIR).collect()
    assert sorted(r["doc_id"] for r in mix) == sorted(r["doc_id"] for r in left.collect())


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    item = max((r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()), key=len)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (None, d + " end"), (7, d), (7, d + " more"), (None, None), (None, ""), (8, item), (8, "clean words"), (None, item)]

    def run(stage):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        lost = [x for x in docs.columns if x not in df.columns]
        df = df.select(*(F.col(x) if x not in lost else F.lit(None).cast(docs.schema[x].dataType).alias(x) for x in docs.columns))
        return sorted(((r["doc_id"], r["text"] if "text" in r else None) for r in stage(spark, df, DIR).collect()), key=repr)

    stages = dict(corpus_pipeline.STAGES)
    least = [(1, a), (5, b), (None, c), (8, item), (8, "clean words")]
    got = run(stages["exact_dedup"])
    assert len([x for x in got if not x[1]]) == 1  # null counts as empty
    assert [x for x in got if x[1]] == sorted([*least, (None, d + " end"), (7, d), (7, d + " more")], key=repr)
    got = run(stages["near_dedup"])
    assert len([x for x in got if x[0] == 7]) == 1  # either
    assert [x for x in got if x[0] != 7] == sorted([*least, (None, None), (None, "")], key=repr)
    assert run(stages["toxicity"]) == sorted(rows, key=repr)  # no document has a label's id and enough words to learn from
    assert run(stages["decontamination"]) == sorted((x for x in rows if x[1] != item), key=repr)
    assert [x[0] for x in run(stages["mixing"])] == sorted((x[0] for x in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_tables(spark, name):
    """Columns with names that stages use, very long and empty texts, and tables without rows."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, long, "keep me"), (2, long, "me too"), (3, None, ""), (3, "", None), (4, "one two three", "x")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    odd = odd.select("*", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in odd.columns), *(F.col("row").alias(c) for c in ("class", "member", "Row_", "quill_row", "size", "kept", "component_id", "h")))
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = stage(spark, odd.limit(0), DIR)
    assert empty.count() == 0
    out = stage(spark, odd, DIR).collect()
    if name == "mixing":
        assert sorted(r["doc_id"] for r in out) == [1, 2, 3, 3, 4]
        return
    assert empty.columns == odd.columns and out[0].__fields__ == odd.columns
    kept = [(r["doc_id"], r["row"]) for r in out]
    assert all(r["class"] == r["row"] == r["quill_row"] == r["Row_"] for r in out)
    want = {"exact_dedup": 3, "near_dedup": 4}.get(name, 5)
    assert len(kept) == want and (1, "keep me") in kept and (4, "x") in kept and ((2, "me too") in kept) == (want == 5)


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and corpus_pipeline.ORACLE_SQL is None
