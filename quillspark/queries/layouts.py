"""Queries of the page, block, OCR and chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import chunking, layout, ocr_layout
from ..session import stored, written
from ..sources import tables as t
from .texts import COLLAPSE, ND, STRIPPED, S, W

LIMIT = 120


def _tables(spark, d):
    """A box over lines 3 to 5 of every page whose document number is a multiple of 4."""
    b = t.blocks(spark, d).where("document_id % 4 = 0 and (block_number - 1) % 20 between 3 and 5")
    return b.groupBy("document_id", "page_number").agg(F.lit(1).alias("table_number"), F.lit(40.0).alias("x0"), F.min(F.col("y0") - 1).alias("y0"), F.lit(560.0).alias("x1"), F.max("y1").alias("y1"))


def _classified(spark, d):
    return layout.classify_blocks(t.blocks(spark, d), _tables(spark, d))


def _pages(spark, d):
    """Events as pages: kinds follow from ids and values."""
    e = t.table(spark, d, "events")
    pages = e.select(F.col("user_id").alias("document_id"), F.col("event_id").cast("int").alias("page_number"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), (F.col("event_id") % 50).cast("int").alias("text_chars"), (F.col("event_id") % 101).cast("int").alias("drawings"))
    images = e.where("event_id % 3 = 0").select(F.col("user_id").alias("document_id"), F.col("event_id").cast("int").alias("page_number"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), (F.col("event_id") % 10 * 60.0).alias("y1"), (F.col("event_id") % 40).cast("int").alias("chars_over"))
    return pages, images


def j1_page_kinds(spark, d):
    return layout.page_kinds(*_pages(spark, d))


def j2_document_types(spark, d):
    return layout.document_type(layout.page_kinds(*_pages(spark, d)))


def d15_quality(spark, d):
    q = layout.quality(layout.page_kinds(*_pages(spark, d)))
    return q.select("document_id", "total_pages", F.array_join(F.map_keys("page_types"), ",").alias("kinds"), F.size(F.flatten(F.map_values("page_types"))).alias("pages"))


def j3_classify_blocks(spark, d):
    return _classified(spark, d).select("document_id", "page_number", "block_number", "classification", "table_number")


def j9_furniture(spark, d):
    return layout.mark_furniture(_classified(spark, d)).where("classification = 'PAGE_FURNITURE'").select("document_id", "page_number", "block_number")


def k6_titles(spark, d):
    """Lines 1 to 3 of a page as titles of the box below them."""
    b = _classified(spark, d).withColumn("text", F.when((F.col("block_number") - 1) % 20 < 3, F.concat(F.lit("Table "), (F.col("block_number") % 7).cast("string"), F.lit(" of figures"))).otherwise(F.col("text")))
    return layout.find_titles(b, _tables(spark, d))


def k6_notes(spark, d):
    b = _classified(spark, d)
    nth = (F.col("block_number") - 1) % 20
    b = b.withColumn("text", F.when(nth.isin(7, 9), "Note:  a remark").when(nth == 8, "plain").when(nth == 10, "4. Next section").when(nth == 12, "Source: not reached").otherwise(F.col("text")))
    return layout.find_notes(b, _tables(spark, d)).select("document_id", "page_number", F.array_join("notes", "/").alias("notes"))


def d12_confidence(spark, d):
    rows = t.blocks(spark, d).withColumn("confidence", (F.col("block_number") % 7) / 10.0)
    return layout.mean_confidence(rows, ["document_id"]).select("document_id", F.round("confidence", 3).alias("confidence"))


def j5_merge_ocr(spark, d):
    b = _classified(spark, d)
    ocr = b.where("document_id % 3 = 0")
    out = layout.merge_ocr(b, ocr)
    return out.groupBy("document_id", "page_number", "source").agg(F.max("block_number").alias("last"), F.count("*").alias("n"), F.count_if(F.col("classification") == "PARTIAL_OVERLAP").alias("partial"))


def j5_merge_tables(spark, d):
    """Two tables found by OCR on each page of every sixth document."""
    pages = t.blocks(spark, d).where("document_id % 6 = 0").select("document_id", "page_number").distinct()
    found = pages.withColumn("table_number", F.explode(F.array(F.lit(4), F.lit(9))))
    return layout.merge_ocr_tables(_tables(spark, d).select("document_id", "page_number", "table_number"), found)


def j6_page_text(spark, d):
    """Even blocks from OCR; the kind of a page follows from its document."""
    n = F.col("document_id") % 4
    b = t.blocks(spark, d).withColumn("source", F.when((n == 0) | ((n == 1) & (F.col("block_number") % 2 == 0)), "ocr").otherwise("text_layer"))
    kinds = b.select("document_id", "page_number", F.when(n == 0, "scanned").when(n == 1, "mixed").otherwise("text").alias("page_type")).distinct()
    out = layout.page_text(b, kinds)
    return out.select("document_id", "page_number", F.md5("text").alias("text"), "method", "character_count")


def j7_reading_warnings(spark, d):
    """Events as pages, of which some have tables, failures, or no engine for OCR."""
    n = F.col("event_id")
    e = t.table(spark, d, "events").withColumn("document_id", F.col("user_id")).withColumn("page_number", n.cast("int"))
    kind = F.when(n % 3 == 0, "scanned").when(n % 3 == 1, "mixed").otherwise("text")
    pages = e.select("document_id", "page_number", kind.alias("page_type"), F.when(n % 31 == 0, F.concat(F.lit("no lines at "), n.cast("string"))).alias("table_error"), F.when(n % 7 > 0, "engine").alias("ocr_engine"), F.when(n % 11 == 0, "no model").alias("ocr_error"), (n % 4).alias("ocr_items"), F.when(n % 5 > 0, n % 5 / 8).alias("ocr_confidence"))
    cells = lambda *rows: F.array(*(F.array(*(F.lit(x).cast("string") for x in r)) for r in rows))
    found = F.when(n % 10 == 0, F.array().cast("array<array<string>>")).when(n % 15 == 0, cells(["a", None], [" ", None])).otherwise(cells(["x", None]))
    tables = e.where(n % 5 == 0).select("document_id", "page_number", F.explode(F.array(F.lit(1), F.lit(2))).alias("table_number"), found.alias("rows"))
    out = layout.reading_warnings(pages, tables)
    return out.select("document_id", "page_number", F.array_join("warnings", "; ").alias("warnings"))


def j8_review_gate(spark, d):
    e = t.table(spark, d, "events")
    pages = e.select(F.col("user_id").alias("document_id"), F.col("event_id").cast("int").alias("page_number"), F.when(F.col("event_id") % 4 == 0, "scanned").otherwise("text").alias("page_type"), (F.col("event_id") % 500).cast("int").alias("character_count"), F.when(F.col("event_id") % 8 == 0, F.col("event_id") % 10 / 10.0).alias("ocr_confidence"), (F.col("event_id") % 97 == 0).alias("ocr_failed"), F.when(F.col("event_id") % 53 == 0, 1).otherwise(0).alias("empty_tables"))
    return layout.review_gate(layout.page_warnings(pages)).select("document_id", "status", F.size("pages_needing_review").alias("pages"))


def a9_ocr_points(spark, d):
    """Supplier values as pixels of a rendered clip: scaled, shifted, and kept if the centre is inside."""
    s = t.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40 * 50.0).alias("px"))
    x = geometry.to_points(F.col("px"), F.lit(200.0), F.lit(36.0))
    s = s.select("s_suppkey", F.round(x, 6).alias("x0"), F.round(x + 20, 6).alias("x1"))
    box = (F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(10.0))
    return s.where(geometry.centre_inside(box, (F.lit(100.0), F.lit(0.0), F.lit(400.0), F.lit(10.0))))


def e11_pieces(spark, d):
    """Suppliers of a nation as segments of one line, 10 points wide and high: a gap of over 2.5 heights begins a new piece."""
    x = (F.col("s_suppkey") * 7 % 400).cast("double")
    line = t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit(1).alias("line"), F.lit(5.0).alias("mid"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 10).alias("x1"), F.lit(10.0).alias("y1"), F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("text"), F.lit(0.5).alias("confidence"))
    out = ocr_layout.pieces(line)
    return out.select("document_id", "piece", "x0", "x1", F.size("segments").alias("segments"), "weight", "chars")


def j10_ocr_layout(spark, d):
    """Lines as OCR segments of one page each."""
    b = t.blocks(spark, d)
    part = b.select("document_id", "page_number", "x0", "y0", "x1", (F.col("y0") + 12.0).alias("y1"), "text", F.lit(0.9).alias("confidence"))
    return ocr_layout.ocr_layout(part).select("document_id", "page_number", "item_number", "kind", "text", "confidence")


def _versioned(spark, d):
    """Marked blocks, without partial overlaps, that have traits, and the blocks with their texts."""
    blocks = t.blocks(spark, d)
    known = stored(layout.traits(blocks), "traits")
    marked = layout.mark_furniture(layout.classify_blocks(known, _tables(spark, d)))
    return marked.where("classification <> 'PARTIAL_OVERLAP'").withColumn("version", F.lit(1)), blocks


def k1_text_chunks(spark, d):
    marked, blocks = _versioned(spark, d)
    return chunking.text_chunks(marked, LIMIT, texts=blocks).select("chunk_id", "document_id", "page_number", "chunk_number", "token_count", "section", "text")


def k4_text_coverage(spark, d):
    """Characters and blocks covered by each document's chunks; must be those of its usable blocks."""
    marked, texts = _versioned(spark, d)
    blocks = stored(marked, "marked")
    chunks = stored(chunking.text_chunks(blocks, LIMIT, texts=texts), "chunks")
    spans = chunks.select("document_id", F.explode("spans").alias("s"))
    problems = chunking.text_problems(chunks, blocks, LIMIT, texts).groupBy("document_id").agg(F.count("*").alias("problems"))
    out = spans.groupBy("document_id").agg(F.sum(F.col("s.source_end") - F.col("s.source_start")).alias("characters"), F.countDistinct("s.block_number").alias("blocks"))
    return out.join(problems, "document_id", "left").select("document_id", "characters", "blocks", F.coalesce("problems", F.lit(0)).alias("problems"))


def _part_tables(spark, d):
    """Parts by brand as tables: a row of names and one row a part."""
    p = t.table(spark, d, "part")
    row = F.struct("p_partkey", F.array(F.col("p_partkey").cast("string"), "p_name", "p_type").alias("r"))
    body = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    rows = p.groupBy("p_brand").agg(F.concat(F.array(F.array(F.lit("Key"), F.lit("Name"), F.lit("Type"))), body).alias("rows"))
    rows = rows.select(F.concat(F.lit("doc:v1:p1:"), "p_brand").alias("table_id"), F.concat(F.lit("Table 1. "), "p_brand").alias("title"), F.array(F.lit("Note: all parts")).alias("notes"), "rows", F.lit(None).cast("array<string>").alias("external"))
    return chunking.rendered_tables(rows)


def k2_table_chunks(spark, d):
    return chunking.table_chunks(_part_tables(spark, d), LIMIT).select("table_id", "part_number", "part_count", "row_start", "row_end", "text", "token_count", "oversized")


def k5_table_coverage(spark, d):
    tables = written(_part_tables(spark, d))
    parts = written(chunking.table_chunks(tables, LIMIT).select(*chunking.CHECKED))
    bad = chunking.table_problems(parts, tables).groupBy("table_id").agg(F.count("*").alias("problems"))
    out = parts.groupBy("table_id").agg(F.sum(F.col("row_end") - F.col("row_start")).alias("rows"))
    return out.join(bad, "table_id", "left").select("table_id", "rows", F.coalesce("problems", F.lit(0)).alias("problems"))


def e7_sections(spark, d):
    """Sections and segments of the blocks outside of tables; short lines stand for headings, every ninth is in a table."""
    n = F.col("block_number")
    kind = F.when(n % 31 == 0, "PAGE_FURNITURE").when(n % 9 == 0, "INSIDE_TABLE").otherwise("OUTSIDE_TABLE")
    short = (F.length("text") < 30) & (text.strip(F.col("text")) != "")
    b = t.blocks(spark, d).withColumn("classification", kind).withColumn("version", F.lit(1)).withColumn("text", F.when(short, F.concat(F.lit("1. "), "text")).otherwise(F.col("text")))
    return chunking.segments(b).select("document_id", "block_number", "section", "segment", "place")


def d22_oversized(spark, d):
    """Lines as chunks of at most 40 tokens."""
    return chunking.oversized_counts(t.blocks(spark, d), 40)


def d13_plain_confidence(spark, d):
    b = t.blocks(spark, d).select("document_id", F.when(F.col("block_number") % 5 > 0, F.col("block_number") % 7 / 8).alias("confidence"))
    tables = _tables(spark, d).select("document_id", F.lit(0.5).alias("confidence"))
    return layout.plain_confidence(b, tables, ["document_id"]).select("document_id", F.round("confidence", 3).alias("confidence"))


def d21_table_extents(spark, d):
    return layout.table_extents(_part_tables(spark, d)).select("table_id", "row_count", "column_count")


QUERIES = {f.__name__: f for f in (j1_page_kinds, j2_document_types, d15_quality, j3_classify_blocks, j9_furniture, k6_titles, k6_notes, d12_confidence, j5_merge_ocr, j5_merge_tables, j6_page_text, j7_reading_warnings, j8_review_gate, a9_ocr_points, e11_pieces, j10_ocr_layout, k1_text_chunks, k4_text_coverage, k2_table_chunks, k5_table_coverage, e7_sections, d13_plain_confidence, d22_oversized, d21_table_extents)}

TABLES = "tabs AS (SELECT document_id, page_number, 40.0::DOUBLE AS tx0, min(y0 - 1) AS ty0, 560.0::DOUBLE AS tx1, max(y1) AS ty1 FROM blocks WHERE document_id % 4 = 0 AND (block_number - 1) % 20 BETWEEN 3 AND 5 GROUP BY document_id, page_number)"
CLASSED = f"""{t.BLOCKS_SQL}, {TABLES}, classed AS (SELECT b.*, CASE WHEN tx0 IS NULL THEN 'OUTSIDE_TABLE' WHEN x0 >= tx0 AND y0 >= ty0 AND x1 <= tx1 AND y1 <= ty1 THEN 'INSIDE_TABLE'
    WHEN greatest(least(x1, tx1) - greatest(x0, tx0), 0) * greatest(least(y1, ty1) - greatest(y0, ty0), 0) > 0 THEN 'PARTIAL_OVERLAP' ELSE 'OUTSIDE_TABLE' END AS classification
    FROM blocks b LEFT JOIN tabs USING (document_id, page_number))"""
SOLID = rf"regexp_matches(text, '[^{S}]')"
KEY = COLLAPSE.format(rf"regexp_replace(lower(text), '{ND}+', '#', 'g')")
FURNITURE = rf"""{CLASSED}, u AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y0, x0, block_number) AS a, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y0 DESC, x0 DESC, block_number DESC) AS b
      FROM classed WHERE classification = 'OUTSIDE_TABLE' AND {SOLID}),
    ed AS (SELECT document_id, page_number, block_number, {STRIPPED} AS s, {KEY} AS norm FROM u WHERE a <= 2 OR b <= 2),
    seen AS (SELECT document_id, norm, count(DISTINCT page_number) AS k FROM ed GROUP BY ALL), np AS (SELECT document_id, count(DISTINCT page_number) AS n FROM blocks GROUP BY document_id),
    furn AS (SELECT document_id, page_number, block_number FROM ed JOIN seen USING (document_id, norm) JOIN np USING (document_id)
      WHERE length(s) <= 200 AND (regexp_matches(s, '(?i)^(page[{S}]*)?{ND}+([{S}]*(of|/)[{S}]*{ND}+)?$') OR k >= greatest(2, ceil(n / 2))))"""
KINDS = """kinds AS (SELECT user_id AS document_id, CAST(event_id AS INTEGER) AS page_number,
      CASE WHEN event_id % 50 < 20 AND (event_id % 3 = 0 OR event_id % 101 >= 50) THEN 'scanned' WHEN event_id % 50 < 20 THEN 'blank'
           WHEN event_id % 3 = 0 AND event_id % 10 * 60 * 600 >= 48000 AND event_id % 40 < 20 THEN 'mixed' ELSE 'text' END AS page_type,
      round(CASE WHEN event_id % 3 = 0 THEN event_id % 10 * 60 / 800 ELSE 0 END, 3) AS image_coverage FROM events)"""
ORACLES = {
    "j1_page_kinds": f"WITH {KINDS} SELECT * FROM kinds",
    "j2_document_types": f"""WITH {KINDS} SELECT document_id, CASE WHEN count(*) FILTER (page_type NOT IN ('text', 'blank')) = 0 THEN 'digital'
        WHEN count(*) FILTER (page_type NOT IN ('scanned', 'blank')) = 0 THEN 'scanned' ELSE 'mixed' END AS document_type FROM kinds GROUP BY document_id""",
    "d15_quality": f"WITH {KINDS} SELECT document_id, count(*) AS total_pages, string_agg(DISTINCT page_type, ',' ORDER BY page_type) AS kinds, CAST(count(*) AS INTEGER) AS pages FROM kinds GROUP BY document_id",
    "j3_classify_blocks": f"WITH {CLASSED} SELECT document_id, page_number, block_number, classification, CASE WHEN classification <> 'OUTSIDE_TABLE' THEN 1 END AS table_number FROM classed",
    "j9_furniture": f"WITH {FURNITURE} SELECT * FROM furn",
    "k6_titles": f"""WITH {CLASSED}, c AS (SELECT * FROM classed WHERE (block_number - 1) % 20 < 3 AND classification = 'OUTSIDE_TABLE'),
        m AS (SELECT document_id, page_number, max(block_number) AS b FROM c JOIN tabs USING (document_id, page_number) WHERE y1 <= ty0 GROUP BY ALL)
        SELECT document_id, page_number, 1 AS table_number, 'Table ' || CAST(b % 7 AS VARCHAR) || ' of figures' AS title, b AS title_block_number FROM m""",
    "k6_notes": f"""WITH {CLASSED}, x AS (SELECT document_id, page_number, count(*) FILTER ((block_number - 1) % 20 IN (7, 9) AND classification = 'OUTSIDE_TABLE') AS n,
            count(*) FILTER ((block_number - 1) % 20 = 6 AND y0 >= ty1 AND (regexp_matches({STRIPPED}, '^{ND}+\\.[{S}]+[^{S}]') OR regexp_matches({STRIPPED}, '(?i)^Table[{S}]+{ND}+($|[^{W}])'))) AS stop,
            count(*) FILTER ((block_number - 1) % 20 = 6 AND regexp_matches({STRIPPED}, '(?i)^(Notes?|Footnotes?|Source)[{S}]*:')) AS extra FROM classed JOIN tabs USING (document_id, page_number) GROUP BY ALL)
        SELECT document_id, page_number, CASE n WHEN 1 THEN 'Note: a remark' ELSE 'Note: a remark/Note: a remark' END AS notes FROM x WHERE n > 0 AND stop = 0 AND extra = 0""",
    "d12_confidence": f"WITH {t.BLOCKS_SQL} SELECT document_id, round(round(sum(block_number % 7 / 10 * greatest(1, length(text))) / sum(greatest(1, length(text))), 4), 3) AS confidence FROM blocks GROUP BY document_id",
    "j5_merge_ocr": f"""WITH {CLASSED} SELECT document_id, page_number, 'text_layer' AS source, max(block_number) AS last, count(*) AS n, count(*) FILTER (classification = 'PARTIAL_OVERLAP') AS partial FROM classed GROUP BY ALL
        UNION ALL SELECT document_id, page_number, 'ocr', max(block_number) + CAST(count(*) AS INTEGER), count(*), 0 FROM classed WHERE document_id % 3 = 0 GROUP BY ALL""",
    "j5_merge_tables": f"""WITH {t.BLOCKS_SQL}, {TABLES}, p AS (SELECT DISTINCT document_id, page_number FROM blocks WHERE document_id % 6 = 0)
        SELECT document_id, page_number, 1 AS table_number, 'text_layer' AS source FROM tabs
        UNION ALL SELECT document_id, page_number, CAST(CASE WHEN tx0 IS NULL THEN 0 ELSE 1 END + k AS INTEGER), 'ocr' FROM p LEFT JOIN tabs USING (document_id, page_number), (VALUES (1), (2)) n(k)""",
    "j6_page_text": f"""WITH {t.BLOCKS_SQL}, b AS (SELECT *, {STRIPPED} AS s, document_id % 4 = 0 OR (document_id % 4 = 1 AND block_number % 2 = 0) AS ocr FROM blocks),
        j AS (SELECT document_id, page_number, string_agg(s, chr(10) || chr(10) ORDER BY y0, x0, block_number) FILTER (ocr) AS o, string_agg(text, chr(10) ORDER BY y0, x0, block_number) FILTER (NOT ocr) AS l FROM b GROUP BY ALL),
        k AS (SELECT document_id, page_number, o, {STRIPPED.replace("text", "coalesce(l, '')")} AS l, {STRIPPED.replace("text", "o")} AS os FROM j),
        x AS (SELECT *, coalesce(CASE document_id % 4 WHEN 0 THEN os WHEN 1 THEN l || coalesce(chr(10) || chr(10) || o, '') ELSE l END, '') AS x FROM k)
        SELECT document_id, page_number, md5(x) AS text, CASE document_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'embedded_text+ocr' ELSE 'embedded_text' END AS method, CAST(length(x) AS INTEGER) AS character_count FROM x""",
    "j7_reading_warnings": """WITH e AS (SELECT user_id AS document_id, event_id AS n, CASE event_id % 3 WHEN 0 THEN 'scanned' WHEN 1 THEN 'mixed' ELSE 'text' END AS kind FROM events),
        w AS (SELECT *, CASE WHEN n % 31 = 0 AND kind <> 'scanned' THEN 'table_extraction_failed: no lines at ' || n END AS a,
                CASE WHEN n % 10 = 0 THEN 'table_1_has_no_extracted_rows; table_2_has_no_extracted_rows' WHEN n % 15 = 0 THEN 'table_1_has_empty_row; table_2_has_empty_row' END AS b,
                CASE WHEN kind = 'text' THEN NULL WHEN n % 7 = 0 THEN 'ocr_disabled: page needs OCR (set DOCINTEL_OCR_ENGINE)' WHEN n % 11 = 0 THEN 'ocr_failed (engine): no model'
                     WHEN kind = 'scanned' AND n % 4 = 0 THEN 'ocr_found_no_text' WHEN kind = 'scanned' AND n % 5 > 0 AND n % 5 / 8 < 0.5 THEN 'low_ocr_confidence: ' || printf('%.2f', n % 5 / 8) END AS c FROM e)
        SELECT document_id, CAST(n AS INTEGER) AS page_number, concat_ws('; ', a, b, c) AS warnings FROM w""",
    "j8_review_gate": """WITH w AS (SELECT user_id, event_id % 53 = 0 OR event_id % 97 = 0 OR (event_id % 4 = 0 AND event_id % 8 <> 0) OR (event_id % 8 = 0 AND event_id % 10 / 10 < 0.5) OR (event_id % 4 <> 0 AND event_id % 500 < 20)
              OR (max(event_id % 500) OVER (PARTITION BY user_id) = 0 AND event_id = min(event_id) OVER (PARTITION BY user_id)) AS bad FROM events)
        SELECT user_id AS document_id, CASE WHEN bool_or(bad) THEN 'NEEDS_REVIEW' ELSE 'PROCESSING' END AS status, CAST(count(*) FILTER (bad) AS INTEGER) AS pages FROM w GROUP BY user_id""",
    "a9_ocr_points": "SELECT s_suppkey, round(s_suppkey % 40 * 50 * 72 / 200 + 36, 6) AS x0, round(s_suppkey % 40 * 50 * 72 / 200 + 56, 6) AS x1 FROM supplier WHERE s_suppkey % 40 * 50 * 72 / 200 + 46 BETWEEN 100 AND 400",
    "e11_pieces": """WITH s AS (SELECT s_nationkey AS document_id, s_suppkey AS k, (s_suppkey * 7 % 400)::DOUBLE AS x0 FROM supplier),
        g AS (SELECT *, CASE WHEN x0 - lag(x0 + 10) OVER w > 25 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY document_id ORDER BY x0, ' ' || k)),
        p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY document_id ORDER BY x0, ' ' || k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS piece FROM g)
        SELECT document_id, piece, min(x0) AS x0, max(x0 + 10) AS x1, CAST(count(*) AS INTEGER) AS segments, CAST(sum(length(' ' || k)) AS BIGINT) AS weight, CAST(sum(length(' ' || k)) AS BIGINT) AS chars FROM p GROUP BY document_id, piece""",
    "k4_text_coverage": f"""WITH {FURNITURE} SELECT document_id, sum(length(text))::BIGINT AS characters, count(*) AS blocks, 0::BIGINT AS problems FROM classed c
        WHERE classification = 'OUTSIDE_TABLE' AND {SOLID} AND NOT EXISTS (FROM furn f WHERE f.document_id = c.document_id AND f.page_number = c.page_number AND f.block_number = c.block_number) GROUP BY document_id""",
    "k5_table_coverage": "SELECT 'doc:v1:p1:' || p_brand AS table_id, count(*) AS rows, 0::BIGINT AS problems FROM part GROUP BY p_brand",
    "e7_sections": rf"""WITH {t.BLOCKS_SQL}, b AS (SELECT *, CASE WHEN block_number % 9 = 0 THEN 'IN' ELSE 'OUT' END AS kind, CASE WHEN length(text) < 30 AND {SOLID} THEN '1. ' || text ELSE text END AS t
            FROM blocks WHERE block_number % 31 <> 0),
        h AS (SELECT document_id, page_number, block_number, kind, regexp_matches(t, '[^{S}]') AS solid, regexp_replace(t, '^[{S}]+|[{S}]+$', '', 'g') AS s FROM b),
        k AS (SELECT *, kind = 'OUT' AND regexp_matches(s, '^{ND}+\.[{S}]+[^{S}]') AS head, row_number() OVER w AS place, lag(page_number) OVER w AS last FROM h WINDOW w AS (PARTITION BY document_id ORDER BY block_number)),
        r AS (SELECT document_id, block_number, place, solid, kind, last_value(CASE WHEN head THEN s END IGNORE NULLS) OVER w AS section,
                CAST(sum(CASE WHEN head OR kind = 'IN' OR last IS DISTINCT FROM page_number THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment
            FROM k WINDOW w AS (PARTITION BY document_id ORDER BY block_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT document_id, block_number, section, segment, place FROM r WHERE kind = 'OUT' AND solid""",
    "d22_oversized": rf"WITH {t.BLOCKS_SQL} SELECT document_id, count(*) AS chunks, count(*) FILTER (ceil(1.3 * len(regexp_extract_all(text, '[{W}]+|[^{W}{S}]'))) + 2 > 40) AS oversized FROM blocks GROUP BY document_id",
    "d13_plain_confidence": f"""WITH {CLASSED}, c AS (SELECT document_id, CASE WHEN block_number % 5 > 0 THEN block_number % 7 / 8 END AS c FROM blocks UNION ALL SELECT document_id, 0.5 FROM tabs)
        SELECT document_id, round(round(avg(c), 4), 3) AS confidence FROM c GROUP BY document_id""",
    "d21_table_extents": "SELECT 'doc:v1:p1:' || p_brand AS table_id, CAST(count(*) + 1 AS INTEGER) AS row_count, 3 AS column_count FROM part GROUP BY p_brand",
}
