import json

import pytest

from quillspark.plans import pipelines
from quillspark.sources import readers
from quillspark.sources.models import HashedEncoder, QuotaError, ScriptedLLM, get_ocr_engine
from quillspark.streaming import files


def test_debounce_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:02'), ('a', timestamp'2024-01-01 00:00:09'), ('b', timestamp'2024-01-01 01:00:00') t(path, ts)")
    df.write.parquet(str(tmp_path / "in"))
    q = files.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["path"], r["events"]) for r in spark.sql("SELECT * FROM bursts").collect()}
    assert got >= {("a", 2), ("a", 1)}
    assert {(r["path"], r["events"]) for r in files.debounced(df).collect()} == {("a", 2), ("a", 1), ("b", 1)}


def test_ingest_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"one")
    (tmp_path / "in/b.txt").write_bytes(b"two")
    seen = []
    for _ in range(2):
        files.ingest(files.watch(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r["checksum"] for r in df.select("checksum").collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert len(seen) == 1


def test_readers(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"description": "d", "cases": [{"id": "1", "category": "c", "question": "q", "expect_any": [["a", "b"]]}]}))
    assert readers.eval_cases(spark, str(tmp_path / "cases.json")).first()["expect_any"] == [["a", "b"]]
    (tmp_path / "p").mkdir()
    page = {"page_number": 1, "text": "t", "text_blocks": [{"block_number": 1, "bbox": [0, 0, 1, 1], "text": "x", "classification": "OUTSIDE_TABLE"}], "tables": [], "warnings": []}
    (tmp_path / "p/a.json").write_text(json.dumps({"document_id": "d", "document_version": 1, "pages": [page]}))
    blocks = readers.flat_blocks(readers.parse_results(spark, str(tmp_path / "p"))).collect()
    assert [(b["document_id"], b["x1"], b["text"]) for b in blocks] == [("d", 1.0, "x")]
    chunks = spark.createDataFrame([("c1", "d", 1, "t"), ("c2", "e", 1, "u")], "chunk_id string, document_id string, document_version int, text string")
    for one in ("d", "e", "d"):
        readers.save_chunks(chunks.where(f"document_id = '{one}'"), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    for bad in (chunks.limit(0), chunks, chunks.where("document_id = 'd'").union(chunks.where("document_id = 'd'"))):
        with pytest.raises(ValueError):
            readers.save_chunks(bad, str(tmp_path / "chunks"))
    assert readers.with_columns(chunks, "text string, section string").columns[-1] == "section"
    assert get_ocr_engine("none") is None
    with pytest.raises(ValueError):
        get_ocr_engine("no such engine")


def test_answers_are_verified(spark):
    chunks = spark.createDataFrame([("c1", "doc", 1, "text", "The fee is 85 dollars."), ("c2", "doc", 2, "text", "Nothing else.")], "chunk_id string, document_name string, page_number int, content_type string, text string")
    q = spark.createDataFrame([(1, "fee"), (2, "dollars")], "question_id int, question string")
    make = lambda: ScriptedLLM({"Question: fee": {"answerable": True, "answer": "85", "citations": [{"source": 1, "quote": "The fee is 85"}]}, "Question: dollars": {"answerable": True, "answer": "?", "citations": [{"source": 1, "quote": "fee is 8"}]}})
    got = {r["question_id"]: r["status"] for r in pipelines.answer(q, chunks, HashedEncoder(), make).collect()}
    assert got == {1: "answered", 2: "unsupported"}


def test_chat_turn(spark):
    chunks = spark.createDataFrame([("c1", "doc", 1, "text", "The fee is 85 dollars.")], "chunk_id string, document_name string, page_number int, content_type string, text string")
    make = lambda: ScriptedLLM({"Question: fee": {"answerable": True, "answer": "85", "citations": [{"source": 1, "quote": "The fee is 85"}]}, "User: how much?": {"question": "fee"}})
    got = pipelines.chat_turn(spark, "how much?", [{"role": "user", "content": "hello"}], lambda q: chunks, HashedEncoder(), make)
    assert (got["status"], got["answer"], got["asked"], got["searched_for"]) == ("answered", "85", "how much?", "fee")


def test_chunks_of_text_and_tables(spark):
    rows = [("d", 1, 1, 1, 0.0, 0.0, 10.0, 5.0, "Some text."), ("d", 1, 1, 2, 0.0, 6.0, 10.0, 8.0, "Table 1. Fees"), ("d", 1, 1, 3, 0.0, 10.0, 10.0, 20.0, "in the table")]
    blocks = spark.createDataFrame(rows, "document_id string, version int, page_number int, block_number int, x0 double, y0 double, x1 double, y1 double, text string")
    table = [("d", 1, 1, 0.0, 9.0, 10.0, 30.0, [["Name", "Fee"], ["One", "85"]], None)]
    tables = spark.createDataFrame(table, "document_id string, page_number int, table_number int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>, external array<string>")
    chunks, problems = pipelines.chunk_documents(blocks, tables, 100)
    got = {r["content_type"]: (r["chunk_id"], r["text"]) for r in chunks.collect()}
    assert got == {"text": ("d:v1:p1:g1", "Some text.\nTable 1. Fees"), "table": ("d:v1:p1:t1:part1", "Table 1. Fees\nName: One | Fee: 85")}
    assert problems.count() == 0


def test_research_events(spark):
    llm = ScriptedLLM([{"sub_tasks": [{"task_id": "A", "sub_query": "a"}, {"task_id": "B", "sub_query": "b", "depends_on": ["A"]}]}, {"title": "r"}])
    kinds = [k for k, _ in pipelines.research(spark, "query", llm, lambda q, c: f"{q}:{len(c) > 0}")]
    assert kinds == ["init", "cache_miss", "decomposition_complete", "plan_complete", "execution_complete", "report_complete", "close"]
    assert [k for k, _ in pipelines.research(spark, "q", llm, None, cached=lambda q: "x")] == ["init", "cache_hit", "close"]
    out, redo = pipelines.evaluate_answers([{"id": "1", "question": "q"}, {"id": "2", "question": "q"}], lambda q: (_ for _ in ()).throw(QuotaError("stop")))
    assert (out, redo) == ([], ["1", "2"])


def test_a_corrupt_parse_result_is_a_row_of_nulls(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"document_id": "d", "document_version": 1, "pages": []}))
    (tmp_path / "bad.json").write_text("{ no json")
    rows = readers.parse_results(spark, str(tmp_path))
    assert sorted(((r["document_id"], r["pages"]) for r in rows.collect()), key=repr) == [("d", []), (None, None)]
    assert readers.flat_blocks(rows).count() == 0
