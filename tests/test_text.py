import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import chunking, layout


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in zip(cols, (_type(v) for v in cols.values()), strict=True)))
    return df.select(expr.alias("x")).first()["x"]


def _type(v):
    return "string" if v is None or isinstance(v, str) else "array<string>" if v and isinstance(v[0], str) else "array<array<string>>"


def test_tokenize_drops_stop_words(spark):
    assert one(spark, text.tokenize(F.col("t")), t="What IS the Fee of café_2?") == ["fee", "café_2"]


@pytest.mark.parametrize(("value", "want"), [("page 3 of 12", True), ("7", True), ("page", False), ("3 cats", False), (" 4 / 9 ", True)])
def test_page_numbers(spark, value, want):
    assert one(spark, text.is_page_number(F.col("t")), t=value) is want


@pytest.mark.parametrize(("value", "want"), [("S185,000", "$185,000"), ("S6.3M", "$6.3M"), ("S1.2bn", "$1.2bn"), ("S3", "S3"), ("USS185,000", "USS185,000")])
def test_currency(spark, value, want):
    assert one(spark, text.fix_currency(F.col("t")), t=value) == want


def test_quote_normalisation(spark):
    assert one(spark, text.normalize_quote(F.col("t")), t="“It’s\n  fine...”") == "It's fine"
    assert one(spark, text.normalize_quote(F.col("t")), t="a … b…") == "a … b"


@pytest.mark.parametrize(("quote", "want"), [("Participants: 85", True), ("Participants: 8", False), ("a.b", False), ("(85)", True), ("\\E.*", False)])
def test_contains_words(spark, quote, want):
    assert one(spark, text.contains_words(F.col("t"), F.col("q")), t="Participants: 85 (85) axb", q=quote) is want


def test_headers_and_rows(spark):
    rows = [["Category", "2024", "2025"], ["Capital", "1.2", None]]
    h = one(spark, text.detect_header(F.col("r"), F.lit(None).cast("array<string>")), r=rows)
    assert (h["names"], h["consumed"]) == (["Category", "2024", "2025"], 1)
    line = one(spark, text.render_row(F.get("r", F.lit(1)), F.get("r", F.lit(0))), r=rows)
    assert line == "Category: Capital | 2024: 1.2"
    h = one(spark, text.detect_header(F.col("r"), F.lit(None).cast("array<string>")), r=[["1", "2"], ["3", "4"]])
    assert (h["names"], h["consumed"]) == (None, 0)


@pytest.mark.parametrize("limit", [25, 40, 80, 200])
def test_split_covers_exactly(limit):
    body = "First sentence here. " * 20 + "x" * 500 + " tail without end"
    spans = chunking.split_block(body, limit)
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(chunking.approximate_tokens(body[a:b]) <= limit for a, b in spans)


def test_packing_flushes_at_headings_tables_and_pages(spark):
    rows = [(1, 1, "OUTSIDE_TABLE", "intro"), (1, 2, "OUTSIDE_TABLE", "1. Scope"), (1, 3, "INSIDE_TABLE", "x"), (1, 4, "OUTSIDE_TABLE", "after"), (1, 5, "PAGE_FURNITURE", "9"), (2, 6, "OUTSIDE_TABLE", "next")]
    blocks = spark.createDataFrame([("d", 1, p, n, 0.0, float(n), kind, body) for p, n, kind, body in rows], "document_id string, version int, page_number int, block_number int, x0 double, y0 double, classification string, text string")
    got = [(c["page_number"], c["text"], c["section"]) for c in chunking.text_chunks(blocks, 100).orderBy("chunk_number").collect()]
    assert got == [(1, "intro", None), (1, "1. Scope", "1. Scope"), (1, "after", "1. Scope"), (2, "next", "1. Scope")]
    partial = blocks.withColumn("classification", F.lit("PARTIAL_OVERLAP"))
    assert chunking.text_chunks(partial, 10).count() == 0 and chunking.block_problems(partial).count() == 6


def test_row_groups_keep_notes_only_for_free():
    lines = [f"Name: value {i}" for i in range(30)]
    parts = chunking.part_rows(lines, "Table 1", ["Note: n"], 10_000)
    assert [(a, b) for a, b, _, _ in parts] == [(0, 25), (25, 30)] and all(x.endswith("Note: n") for _, _, x, _ in parts)
    parts = chunking.part_rows(["one two three"], None, ["Note: n"], 12)
    assert [(a, b) for a, b, _, _ in parts] == [(0, 1)] and parts[0][2] == "Table\none two three\nNote: n"
    parts = chunking.part_rows(["one two three", "four five six"], None, ["Note: " + "n " * 4], 25)
    assert [(a, b) for a, b, _, _ in parts] == [(0, 2)] and "Note" not in parts[0][2]


def test_long_blocks_are_measured_in_stretches():
    """A text of n characters is not counted anew from each cut to its end."""
    seen = []

    def count(x):
        seen.append(len(x))
        return chunking.approximate_tokens(x)

    body = "Some words of a sentence go on. " * 2000
    spans = chunking.split_block(body, 60, count)
    assert spans == chunking.split_block(body, 60) and "".join(body[a:b] for a, b in spans) == body
    assert sum(seen) < 60 * len(body)


def test_packing_counts_cut_words_and_neighbours():
    blocks = [(1, "ab cd. " * 30), (1, "joined to it"), (2, ""), (3, "é_x" * 400), (4, " \n ")]
    for limit in (5, 30, 90):
        found = chunking.pack(blocks, limit)
        assert all(tokens == chunking.approximate_tokens(x) <= limit for x, _, tokens in found)
        assert "".join(dict(blocks[1:] if n > 1 else [(1, blocks[0][1])])[n][a:b] for _, spans, _ in chunking.pack(blocks[:1] + blocks[2:], limit) for n, a, b, *_ in spans) == blocks[0][1] + blocks[3][1] + blocks[4][1]


def test_parts_of_a_table_do_not_carry_it(spark):
    rows = [["Key", "Name"], *([str(k), f"part {k}"] for k in range(60))]
    t = spark.createDataFrame([("t", None, None, rows, None)], "table_id string, title string, notes array<string>, rows array<array<string>>, external array<string>")
    tables = chunking.rendered_tables(t)
    parts = chunking.table_chunks(tables, 60).select(*chunking.CHECKED)
    made = [x for x in parts._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate posexplode" in x]
    assert len(made) == 1 and "rows#" not in made[0] and "parts#" not in made[0]
    assert parts.count() > 2 and chunking.table_problems(parts, tables).count() == 0
    second = F.col("part_number") == 2
    for name, value in (("cells", F.slice("cells", 2, 99)), ("cells", F.reverse("cells")), ("cells", F.lit(None).cast("array<array<string>>"))):
        wrong = parts.withColumn(name, F.when(second, value).otherwise(F.col(name)))
        assert [tuple(r) for r in chunking.table_problems(wrong, tables).collect()] == [("t", "other cells")]
    assert [r["problem"] for r in chunking.table_problems(parts.where(~second), tables).collect()] == ["part numbers"]


BLOCKS = "document_id string, version int, page_number int, block_number int, x0 double, y0 double, classification string, text string"


def _blocks(spark):
    bodies = [(1, "1. Scope"), (1, "Ein Satz mit Umlauten: äöü. " * 12), (1, " \n"), (2, "short"), (2, "x y " * 75)]
    return spark.createDataFrame([(d, 1, p, n, 0.0, float(n), "OUTSIDE_TABLE", body) for d in "ab" for n, (p, body) in enumerate(bodies, 1)], BLOCKS)


def _shuffled(plan, found):
    """The columns of each exchange of a plan."""
    if "Exchange" in plan.nodeName():
        found.append([plan.output().apply(i).name() for i in range(plan.output().size())])
    for i in range(plan.children().size()):
        _shuffled(plan.children().apply(i), found)
    return found


def test_texts_are_moved_once(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        found = _shuffled(chunking.text_chunks(_blocks(spark), 40)._jdf.queryExecution().executedPlan(), [])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len([x for x in found if {"text", "texts", "parts", "buf"} & {*x}]) == 1 and len(found) > 1


def test_problems_of_coverage_are_told_apart(spark):
    blocks = _blocks(spark)
    chunks = chunking.text_chunks(blocks, 40).persist()
    assert chunking.text_problems(chunks, blocks, 40).count() == 0
    of = [(r["chunk_id"], [(s["block_number"], s["source_end"]) for s in r["spans"]]) for r in chunks.where("document_id = 'a'").orderBy("chunk_number").collect()]
    middle = next(c for c, spans in of if [n for n, _ in spans] == [2])
    last, a_part = of[-1][0], F.element_at("spans", -1)
    longer = F.concat(F.slice("spans", 1, F.size("spans") - 1), F.array(a_part.withField("source_end", a_part["source_end"] + 5)))
    other = F.translate("text", "xS", "yT")

    def problems(x):
        return [(r["block_number"], r["problem"]) for r in chunking.text_problems(x, blocks, 40).where("document_id = 'a'").orderBy("block_number").collect()]

    def only(chunk, **columns):
        return chunks.withColumns({k: F.when(F.col("chunk_id") == chunk, v).otherwise(F.col(k)) for k, v in columns.items()})

    assert problems(chunks.where(F.col("chunk_id") != middle)) == [(2, "gap or overlap")]
    assert problems(only(last, text=other)) == [(5, "other text")]
    assert problems(chunks.where(F.col("chunk_id") != last)) == [(5, "incomplete")]
    assert problems(chunks.where(F.col("chunk_id") != last).withColumn("text", F.translate("text", "x", "y"))) == [(5, "other text")]
    assert problems(only(last, spans=longer)) == [(5, "incomplete")]
    assert problems(only(last, spans=longer, text=other)) == [(5, "other text")]
    assert problems(only(last, spans=F.transform("spans", lambda s: s.withField("end", s["end"] + 1)))) == [(5, "gap or overlap")]
    assert problems(only(last, spans=F.transform("spans", lambda s: s.withField("block_number", F.lit(9))))) == [(5, "incomplete"), (9, "unknown block")]
    assert problems(chunks.where("page_number = 1")) == [(4, "missing"), (5, "missing")]
    assert {r["problem"] for r in chunking.text_problems(chunks, blocks, 10).collect()} == {"over the limit"}
    chunks.unpersist()


def test_traits_stand_for_texts(spark):
    blocks = _blocks(spark)
    known, texts = layout.traits(blocks), blocks.select("document_id", "page_number", "block_number", "text")
    rows = lambda x: sorted(map(str, x.select("chunk_id", "text", "section", "token_count", "spans").collect()))
    chunks = chunking.text_chunks(known, 40, texts=texts)
    assert rows(chunks) == rows(chunking.text_chunks(blocks, 40))
    assert chunking.text_problems(chunks, known, 40, texts).count() == 0
    assert {r["problem"] for r in chunking.text_problems(chunks.where("page_number = 1"), known, 40, texts).collect()} == {"missing"}
    assert {r["problem"] for r in chunking.text_problems(chunks.where("chunk_number < 4"), known, 40, texts).collect()} >= {"incomplete"}
    with pytest.raises(ValueError, match="texts apart"):
        chunking.text_chunks(known, 40)


def test_strip_knows_every_space(spark):
    points = [*range(1, 0x3100), 0x180E, 0xFEFF, 0x200B]
    d = spark.createDataFrame([(chr(i) + "a" + chr(i) + "b" + chr(i) * 2,) for i in points], "t string")
    old = F.regexp_replace("t", rf"^[{text.S}]+|[{text.S}]+\z", "")
    assert d.where(old != text.strip(F.col("t"))).count() == 0 and d.where(old != F.col("t")).count() == len(text.SPACES)
