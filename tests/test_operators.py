import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import citations, layout, ocr_layout, planning, registry, retrieval, semantic_cache, topk, web
from quillspark.queries import answers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_register_outcomes(spark):
    a = spark.createDataFrame([(1, "f", "A", None), (2, "f", "A", None), (3, "g", "A", None), (4, "f", "B", None), (5, "f", "A", None), (6, "f", "A", "s")], "seq int, filename string, checksum string, session_id string")
    assert rows(registry.register(a), "seq", "outcome", "version") == [(1, "registered", 1), (2, "already_registered", 1), (3, "duplicate_content", None), (4, "registered", 2), (5, "duplicate_content", None), (6, "registered", 1)]


def test_newest_version_must_be_chunked(spark):
    r = spark.createDataFrame([("a1", "a", 1, "CHUNKED", None, "x"), ("a2", "a", 2, "FAILED", None, "y"), ("b1", "b", 1, "CHUNKED", None, "z"), ("c1", "c", 1, "CHUNKED", "s", "z")], "document_id string, filename string, version int, status string, session_id string, checksum string")
    assert rows(registry.searchable(r), "document_id") == [("b1",)]
    links = spark.createDataFrame([("s", "c1"), ("s", "a1")], "session_id string, document_id string")
    assert rows(registry.searchable(r, links, "s"), "document_id") == [("c1",)]
    assert rows(registry.missing_files(r, spark.createDataFrame([("a",)], "filename string")), "document_id") == [("b1",)]
    assert rows(registry.missing_files(r, spark.createDataFrame([], "filename string")), "document_id") == [("a1",), ("a2",), ("b1",)]
    assert registry.missing_files(r, None).count() == 0


def test_archive_names(spark):
    r = spark.createDataFrame([("dir/report.final.pdf", 3)], "filename string, version int")
    assert r.select(registry.archive_name("filename", "version").alias("n")).first()["n"] == "dir/report.final.v3.pdf"


def test_classification_and_furniture(spark):
    b = [("d", p, n, t, 50.0, y, 200.0, y + 10) for p in (1, 2) for n, (t, y) in enumerate([("Report 2024", 0.0), ("body one", 100.0), ("body two", 200.0), ("body three", 300.0), (f"page {p} of 2", 700.0)], 1)]
    blocks = spark.createDataFrame(b, "document_id string, page_number int, block_number int, text string, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([("d", 1, 1, 0.0, 195.0, 300.0, 215.0), ("d", 1, 2, 100.0, 305.0, 300.0, 320.0)], "document_id string, page_number int, table_number int, x0 double, y0 double, x1 double, y1 double")
    c = layout.classify_blocks(blocks, tables)
    assert rows(c.where("page_number = 1"), "block_number", "classification") == [(1, "OUTSIDE_TABLE"), (2, "OUTSIDE_TABLE"), (3, "INSIDE_TABLE"), (4, "PARTIAL_OVERLAP"), (5, "OUTSIDE_TABLE")]
    m = layout.mark_furniture(c).where("classification = 'PAGE_FURNITURE'")
    found = rows(m, "page_number", "block_number")
    assert (1, 1) in found and (2, 1) in found and (1, 5) in found and (2, 5) in found


def test_ocr_table_and_prose(spark):
    seg = lambda t, x, y, w: ("d", 1, float(x), float(y), float(x + w), float(y + 10), t, 0.9)
    cells = [("Program", 0), ("Place", 200), ("Count", 400)], [("Skills", 0), ("East", 200), ("85", 400)], [("Arts", 0), ("West", 200), ("120", 400)]
    s = [seg(t, x, 100 + 15 * i, 50) for i, line in enumerate(cells) for t, x in line] + [seg("A sentence of the page above", 0, 20, 300), seg("that goes on below it.", 0, 32, 280), ("d", 1, 0.0, 500.0, 9.0, 510.0, "noise", 0.1)]
    df = spark.createDataFrame(s, "document_id string, page_number int, x0 double, y0 double, x1 double, y1 double, text string, confidence double")
    got = ocr_layout.ocr_layout(df).collect()
    assert [r["rows"] for r in got if r["kind"] == "table"] == [[["Program", "Place", "Count"], ["Skills", "East", "85"], ["Arts", "West", "120"]]]
    assert [r["text"] for r in got if r["kind"] == "block"] == ["A sentence of the page above\nthat goes on below it.\n"]
    chart = spark.createDataFrame([seg(str(i), 30 * i, 7 * i % 90, 10) for i in range(6)], df.schema)
    assert [r["kind"] for r in ocr_layout.ocr_layout(chart).collect()] == ["figure"]


def test_citations(spark):
    src = spark.createDataFrame([(1, 1, "doc", 1, "c1", "table", "Table 1\nLocation: East | Participants: 85 | Rate: 76%"), (1, 2, "doc", 1, "c2", "text", "Source: Fictional\nprepared by it’s team")], "question_id int, number int, document_name string, page_number int, chunk_id string, content_type string, text string")
    q = ["Location: East | Participants: 85", "Location: East | Rate: 76%", "Participants: 8", "x", "“Source: Fictional prepared by it's team”", "Source: Fictional | prepared", "Location: East | Participants: 85"]
    n = [1, 1, 1, 7, 2, 2, 1]
    df = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(zip(n, q, strict=True))], "question_id int, pos int, source int, quote string")
    got = {r["pos"]: r for r in citations.check_citations(df, src).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert [got[i]["verified"] for i in range(6)] == [True, True, False, False, True, False]
    assert got[1]["quote"] == "Location: East | Participants: 85 | Rate: 76%" and got[3]["reason"] == "no such source"
    replies = spark.createDataFrame([(1, True, "yes"), (2, False, "no")], "question_id int, answerable boolean, answer string")
    assert rows(citations.answer_status(replies, citations.check_citations(df, src)), "question_id", "status", "answer") == [(1, "answered", "yes"), (2, "not_found", "")]


def test_hybrid_fusion_prefers_the_keyword_hit(spark):
    chunks = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma"), ("c", "zeta")], "chunk_id string, text string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(1, "zeta", [1.0, 0.0]), (2, "  ", [1.0, 0.0])], "question_id int, question string, vector array<double>")
    hits = topk.search(q, chunks, v).collect()
    assert {h["question_id"] for h in hits} == {1}
    top = min(hits, key=lambda h: h["rank"])
    assert (top["chunk_id"], top["vector_rank"], top["bm25_rank"]) == ("c", 3, 1)


def test_cache_takes_three_before_it_validates(spark):
    s = [(i, [1.0, 0.001 * i], "latest", ["x"], ["gdp"], False, 0.0 if i < 3 else 1e5) for i in range(5)]
    stored = spark.createDataFrame(s, "cache_id int, vector array<double>, timeframe string, locations array<string>, indicators array<string>, is_historical boolean, created_at double")
    q = spark.createDataFrame([(1, [1.0, -0.001])], "query_id int, vector array<double>")
    assert semantic_cache.candidates(stored, q, False).count() == 3
    now = F.lit(1e5)
    assert semantic_cache.lookup(stored.where("cache_id > 2"), q, now, scoped=False).count() == 1


def test_waves_and_cycles(spark):
    t = [("p", "1", 0, "q", []), ("p", "2", 1, "q", []), ("p", "3", 2, "q", ["1", "2"]), ("r", "a", 0, "q", ["b"]), ("r", "b", 1, "q", ["a"]), ("r", "c", 2, "q", [])]
    tasks = spark.createDataFrame([(*x[:4], "DATA", x[4]) for x in t], "plan_id string, task_id string, pos int, sub_query string, task_type string, depends_on array<string>")
    got = {(r["plan_id"], r["task_id"]): (r["wave"], r["is_parallelizable"]) for r in planning.waves(tasks).collect()}
    assert got[("p", "1")] == (0, True) and got[("p", "3")] == (1, False) and got[("r", "c")] == (0, False)


def test_visible_text():
    page = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><p>One <b>two</b></p><script>s</script><footer>f</footer></body></html>"
    assert web.visible_text(page) == ("T", "T\nOne\ntwo")
    assert web.visible_text(None) == ("No Title", "")


def test_waves_keep_one_row_for_each_task(spark):
    # 2 ** 21 paths, more than the rows that Spark allows a recursive query.
    rows = [("p", f"{i}{x}", i, [f"{i - 1}a", f"{i - 1}b"] if i else []) for i in range(21) for x in "ab"]
    rows += [("p", "loop", 50, ["loop", "0a"]), ("p", "behind", 51, ["loop"]), ("q", "x", 0, ["unknown"])]
    tasks = spark.createDataFrame(rows, "plan_id string, task_id string, pos int, depends_on array<string>")
    got = {(r["plan_id"], r["task_id"]): (r["wave"], r["is_parallelizable"]) for r in planning.waves(tasks).collect()}
    want = {("p", f"{i}{x}"): (i, i == 0) for i in range(21) for x in "ab"}
    assert got == want | {("p", "loop"): (None, False), ("p", "behind"): (None, False), ("q", "x"): (0, False)}


def test_ocr_numbers_follow_a_pages_own(spark):
    own = spark.createDataFrame([("d", 1, 0, "OUTSIDE_TABLE"), ("d", 1, 3, "OUTSIDE_TABLE")], "document_id string, page_number int, block_number int, classification string")
    ocr = spark.createDataFrame([("d", 1, 0, "PARTIAL_OVERLAP"), ("d", 2, 5, "OUTSIDE_TABLE"), ("d", 2, 7, "INSIDE_TABLE")], own.schema)
    got = sorted((r["page_number"], r["block_number"], r["classification"]) for r in layout.merge_ocr(own, ocr).where("source = 'ocr'").collect())
    assert got == [(1, 4, "OUTSIDE_TABLE"), (2, 0, "OUTSIDE_TABLE"), (2, 1, "INSIDE_TABLE")]
    kinds = spark.createDataFrame([("a", "text"), ("a", "blank"), ("b", "blank"), ("c", "scanned"), ("c", "blank"), ("e", "mixed"), ("f", "text"), ("f", "scanned")], "document_id string, page_type string")
    assert dict(map(tuple, layout.document_type(kinds).collect())) == {"a": "digital", "b": "digital", "c": "scanned", "e": "mixed", "f": "mixed"}


def test_every_prompt_has_four_sources(spark):
    """As many as before the query was cut to an item and the one after it."""
    rows = answers.h26_prompts(spark, "/root/testdata/sf0.001").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert len(rows) == items and items % 4 == 0
    assert all(r["prompt"].count(" bench, page ") == 4 for r in rows)


def test_pages_are_placed_without_a_table_of_their_own():
    """A batch of pages: pieces of one column are blocks, two columns below words are a table, NaN and null boxes join nothing."""
    page = lambda *rows: [dict(zip(ocr_layout.Piece._fields, r, strict=True)) for r in rows]
    table = page((1, 50.0, 0.0, 80.0, 10.0, "Name", True), (1, 200.0, 0.0, 230.0, 10.0, "Year", True), (2, 50.0, 12.0, 80.0, 22.0, "a", True), (2, 200.0, 12.0, 230.0, 22.0, "2020", True), (3, 50.0, 90.0, 300.0, 100.0, "below", True))
    prose = page((1, 50.0, 0.0, 300.0, 10.0, "one", True), (2, 50.0, 12.0, 300.0, 22.0, "two", True), (3, None, 24.0, 300.0, 34.0, "lost", True), (4, 50.0, 36.0, 300.0, 46.0, "3. Head", True))
    kind = pa.list_(pa.struct([("line", pa.int32()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("text", pa.string()), ("header", pa.bool_())]))
    out = ocr_layout._places(pa.array([[], table, prose], kind).slice(1)).to_pylist()
    assert [(x["table_number"], x["block"]) for x in out[0]] == [(1, 0)] * 4 + [(0, 1)] and out[0][0]["columns"] == [50.0, 200.0]
    assert [(x["table_number"], x["block"]) for x in out[1]] == [(0, 1), (0, 1), (0, 2), (0, 3)]
