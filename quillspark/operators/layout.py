"""Page and block rules over flat relations: pages, images, blocks, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

EDGE, MAX_FURNITURE = 2, 200


def _box(prefix: str = "") -> tuple:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def page_kinds(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(page key, page_type, image_coverage) (J1, I8). pages: document_id, page_number, width, height,
    text_chars, drawings; images: document_id, page_number, x0..y1, chars_over."""
    key = ["document_id", "page_number"]
    sized = images.join(pages.select(*key, (F.col("width") * F.col("height")).alias("page_area")), key)
    part = geometry.area(*_box())
    stats = sized.groupBy(*key).agg(
        F.least(F.lit(1.0), F.sum(part / F.col("page_area"))).alias("coverage"),
        F.count("*").alias("images"),
        F.max((part >= 0.1 * F.col("page_area")) & (F.col("chars_over") < 20)).alias("bare_image"),
    )
    rows = pages.join(stats, key, "left")
    found = F.coalesce("images", F.lit(0))
    kind = (
        F.when((F.col("text_chars") < 20) & ((found > 0) | (F.col("drawings") >= 50)), "scanned")
        .when(F.col("text_chars") < 20, "blank")
        .when(F.coalesce("bare_image", F.lit(False)), "mixed")
        .otherwise("text")
    )
    return rows.select(*key, kind.alias("page_type"), F.round(F.coalesce("coverage", F.lit(0.0)), 3).alias("image_coverage"))


def document_type(kinds: DataFrame) -> DataFrame:
    """(document_id, document_type) from page kinds, blank pages ignored (J2, D14): digital where all pages with
    content have a text layer, or none has content; scanned where all are scans; else mixed."""
    other, scans = F.count_if(~F.col("page_type").isin("text", "blank")), F.count_if(F.col("page_type") == "scanned")
    texts = F.count_if(F.col("page_type") == "text")
    per = kinds.groupBy("document_id").agg(other.alias("other"), scans.alias("scans"), texts.alias("texts"))
    kind = F.when(F.col("other") == 0, "digital").when((F.col("scans") == F.col("other")) & (F.col("texts") == 0), "scanned").otherwise("mixed")
    return per.select("document_id", kind.alias("document_type"))


def classify_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks with ``classification`` and ``table_number`` (J3, C11): containment wins over overlap, and
    within each the first table; tables: document_id, page_number, table_number, x0..y1."""
    key = ["document_id", "page_number"]
    t = tables.select(*key, "table_number", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = blocks.select(*key, "block_number", "x0", "y0", "x1", "y1").join(t, key)
    within = geometry.inside(_box(), _box("t_"))
    touch = geometry.intersection(_box(), _box("t_")) > 0
    best = pairs.where(within | touch).groupBy(*key, "block_number").agg(F.min(F.struct((~within).alias("partial"), "table_number")).alias("best"))
    rows = blocks.join(best, [*key, "block_number"], "left")
    kind = F.when(F.col("best").isNull(), "OUTSIDE_TABLE").when(F.col("best.partial"), "PARTIAL_OVERLAP").otherwise("INSIDE_TABLE")
    return rows.withColumn("classification", kind).withColumn("table_number", F.col("best.table_number")).drop("best")


def traits(blocks: DataFrame) -> DataFrame:
    """blocks with what the rules need to know of ``text`` in its place, so that no join or window moves texts:
    ``blank``, ``heading`` (its text, else null), ``bare`` (a page number alone), ``short`` and ``norm`` (the
    digest of the text with digits aside). Blocks that have them are left as they are."""
    if "blank" in blocks.columns:
        return blocks
    c, body = F.col("text"), text.strip(F.col("text"))
    found = {"blank": body == "", "heading": F.when(text.is_heading(c), body), "bare": text.is_page_number(c), "short": F.length(body) <= MAX_FURNITURE, "norm": F.unhex(F.md5(text.furniture_key(c)))}
    return blocks.withColumns(found).drop("text")


def mark_furniture(blocks: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """blocks with headers and footers marked PAGE_FURNITURE (J9, E6, D10): among the first or last two
    text blocks of the page, at most 200 characters, and a bare page number or, digits aside, on at
    least half of the pages and two. blocks have ``text`` or its ``traits``. ``page_counts`` (document_id, pages) counts blank pages too; without
    it the pages are those that have blocks."""
    key = ["document_id", "page_number"]
    page = Window.partitionBy(*key)
    usable = traits(blocks).where((F.col("classification") == "OUTSIDE_TABLE") & ~F.col("blank"))
    order = [F.asc("y0"), F.asc("x0"), F.asc("block_number")]
    back = [F.desc("y0"), F.desc("x0"), F.desc("block_number")]
    edges = usable.withColumn("a", F.row_number().over(page.orderBy(*order))).withColumn("b", F.row_number().over(page.orderBy(*back))).where((F.col("a") <= EDGE) | (F.col("b") <= EDGE))
    edges = edges.select(*key, "block_number", "norm", "short", "bare")
    seen = edges.groupBy("document_id", "norm").agg(F.countDistinct("page_number").alias("on_pages"))
    pages = page_counts if page_counts is not None else blocks.groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"))
    rows = edges.join(seen, ["document_id", "norm"]).join(pages, "document_id")
    repeated = F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2))
    rows = rows.where(F.col("short") & (F.col("bare") | repeated))
    marked = rows.select(*key, "block_number", F.lit(True).alias("furniture"))
    out = blocks.join(marked, [*key, "block_number"], "left")
    return out.withColumn("classification", F.when(F.col("furniture"), "PAGE_FURNITURE").otherwise(F.col("classification"))).drop("furniture")


def find_titles(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(table key, title, title_block_number): the title block closest above each table."""
    key = ["document_id", "page_number"]
    t = tables.select(*key, "table_number", F.col("y0").alias("top"))
    titles = blocks.where((F.col("classification") == "OUTSIDE_TABLE") & text.strip(F.col("text")).rlike(text.TABLE_TITLE))
    pairs = t.join(titles.select(*key, "block_number", "text", "y1"), key).where("y1 <= top")
    best = pairs.groupBy(*key, "table_number").agg(F.max(F.struct(F.col("y1"), (-F.col("block_number")).alias("n"), F.col("text"))).alias("best"))
    return best.select(*key, "table_number", text.collapse(F.col("best.text")).alias("title"), (-F.col("best.n")).alias("title_block_number"))


def find_notes(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(table key, notes): note blocks below a table, up to the next table, heading, title or block
    inside a table (K6, C14)."""
    key = ["document_id", "page_number"]
    tops = tables.select(*key, F.col("table_number").alias("other"), F.col("y0").alias("other_top"))
    t = tables.select(*key, "table_number", F.col("y1").alias("bottom"))
    below = t.join(tops, key, "left").where((F.col("other") == F.col("table_number")) | (F.col("other_top") >= F.col("bottom")))
    limit = below.groupBy(*key, "table_number", "bottom").agg(F.min(F.when(F.col("other") != F.col("table_number"), F.col("other_top"))).alias("limit"))
    b = blocks.select(*key, "block_number", "text", "classification", "x0", "y0")
    rows = limit.join(b, key).where((F.col("y0") >= F.col("bottom")) & (F.col("limit").isNull() | (F.col("y0") < F.col("limit"))))
    stripped = text.strip(F.col("text"))
    stop = text.is_heading(F.col("text")) | stripped.rlike(text.TABLE_TITLE) | (F.col("classification") == "INSIDE_TABLE")
    down = Window.partitionBy(*key, "table_number").orderBy("y0", "x0", "block_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stopped", F.max(stop.cast("int")).over(down)).where("stopped = 0")
    rows = rows.where((F.col("classification") == "OUTSIDE_TABLE") & stripped.rlike(text.TABLE_NOTE))
    notes = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "block_number", F.col("text").alias("t")))), lambda x: text.collapse(x["t"]))
    return rows.groupBy(*key, "table_number").agg(notes.alias("notes"))


def mean_confidence(segments: DataFrame, key: list[str]) -> DataFrame:
    """Confidence weighted by length, 4 decimals (D12); segments: text, confidence."""
    w = F.greatest(F.lit(1), F.length("text"))
    return segments.groupBy(*key).agg(F.round(F.sum(F.col("confidence") * w) / F.sum(w), 4).alias("confidence"))


def merge_ocr(blocks: DataFrame, ocr: DataFrame) -> DataFrame:
    """OCR blocks numbered after a page's own ones, from 0 where it has none; none of them is a partial overlap."""
    key = ["document_id", "page_number"]
    last = blocks.groupBy(*key).agg(F.max("block_number").alias("last"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("block_number"))
    more = ocr.join(last, key, "left").withColumn("block_number", (F.coalesce("last", F.lit(-1)) + nth).cast("int")).drop("last")
    more = more.withColumn("classification", F.when(F.col("classification") == "PARTIAL_OVERLAP", "OUTSIDE_TABLE").otherwise(F.col("classification")))
    return blocks.withColumn("source", F.lit("text_layer")).unionByName(more.withColumn("source", F.lit("ocr")), allowMissingColumns=True)


def merge_ocr_tables(tables: DataFrame, ocr: DataFrame) -> DataFrame:
    """Tables of OCR numbered after a page's own ones, in their order."""
    key = ["document_id", "page_number"]
    own = tables.groupBy(*key).agg(F.count("*").alias("own"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("table_number"))
    more = ocr.join(own, key, "left").withColumn("table_number", (F.coalesce("own", F.lit(0)) + nth).cast("int")).drop("own")
    return tables.withColumn("source", F.lit("text_layer")).unionByName(more.withColumn("source", F.lit("ocr")), allowMissingColumns=True)


def page_text(blocks: DataFrame, kinds: DataFrame) -> DataFrame:
    """(page key, text, method, character_count) in reading order (J6, F6). The kind of the page decides:
    scans join their OCR blocks by an empty line; a mixed page adds its OCR blocks, if any, behind its
    own text; kinds: document_id, page_number, page_type."""
    key = ["document_id", "page_number"]
    ocr, body = F.col("source") == "ocr", text.strip(F.col("text"))
    block = F.struct("y0", "x0", "block_number", F.col("text").alias("t"), body.alias("b"))

    def joined(blocks: Column, field: str, glue: str) -> Column:
        return F.array_join(F.transform(F.array_sort(blocks), lambda x: x[field]), glue)

    own, read = F.collect_list(F.when(~ocr, block)), F.collect_list(F.when(ocr, block))
    texts = blocks.groupBy(*key).agg(own.alias("own"), read.alias("read"))
    scan, layer = text.strip(joined(F.col("read"), "b", "\n\n")), text.strip(joined(F.col("own"), "t", "\n"))
    mixed = F.when(F.size("read") > 0, F.concat(layer, F.lit("\n\n"), joined(F.col("read"), "b", "\n\n"))).otherwise(layer)
    kind = F.col("page_type")
    rows = kinds.join(texts, key, "left")
    out = F.coalesce(F.when(kind == "scanned", scan).when(kind == "mixed", mixed).otherwise(layer), F.lit(""))
    method = F.when(kind == "scanned", "ocr").when(kind == "mixed", "embedded_text+ocr").when(kind == "blank", "none").otherwise("embedded_text")
    return rows.select(*key, out.alias("text"), method.alias("method"), F.length(out).alias("character_count"))


# The warnings of reading a page.
NO_ROWS, EMPTY_ROW = "table_%d_has_no_extracted_rows", "table_%d_has_empty_row"
TABLES_FAILED, OCR_DISABLED = "table_extraction_failed: %s", "ocr_disabled: page needs OCR (set DOCINTEL_OCR_ENGINE)"
OCR_FAILED, OCR_EMPTY, OCR_UNSURE, LEAST_PAGE_CONFIDENCE = "ocr_failed (%s): %s", "ocr_found_no_text", "low_ocr_confidence: %s", 0.5


def table_warnings(tables: DataFrame) -> DataFrame:
    """(document_id, page_number, warnings) of tables (table_number, rows) without rows or with a row of blank cells."""
    blank = F.exists("rows", lambda r: F.forall(r, lambda c: text.strip(F.coalesce(c, F.lit(""))) == ""))
    found = F.when(F.coalesce(F.size("rows"), F.lit(0)) == 0, F.format_string(NO_ROWS, "table_number")).when(blank, F.format_string(EMPTY_ROW, "table_number"))
    rows = tables.select("document_id", "page_number", "table_number", found.alias("w")).where("w is not null")
    return rows.groupBy("document_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_number", "w"))), lambda x: x["w"]).alias("warnings"))


def reading_warnings(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, page_number, warnings) of all pages, in the order in which reading them finds out (J7): a failed search for
    tables, tables, then OCR where the page needs it: disabled, failed, or for scans without text or unsure. pages:
    document_id, page_number, page_type, table_error, ocr_engine (null: none), ocr_error, ocr_items, ocr_confidence."""
    c, scan = F.col, F.col("page_type") == "scanned"
    ocr = (
        F.when(~c("page_type").isin("scanned", "mixed"), F.lit(None))
        .when(c("ocr_engine").isNull(), OCR_DISABLED)
        .when(c("ocr_error").isNotNull(), F.format_string(OCR_FAILED, "ocr_engine", "ocr_error"))
        .when(scan & (c("ocr_items") == 0), OCR_EMPTY)
        .when(scan & (c("ocr_confidence") < LEAST_PAGE_CONFIDENCE), F.format_string(OCR_UNSURE, F.format_number("ocr_confidence", 2)))
    )
    rows = pages.join(table_warnings(tables).withColumnRenamed("warnings", "of_tables"), ["document_id", "page_number"], "left")
    failed = F.when(c("table_error").isNotNull() & c("page_type").isin("text", "mixed"), F.format_string(TABLES_FAILED, "table_error"))
    parts = F.concat(F.array(failed), F.coalesce("of_tables", F.array().cast("array<string>")), F.array(ocr.cast("string")))
    return rows.select("document_id", "page_number", F.array_compact(parts).alias("warnings"))


def page_warnings(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, page_type, character_count, ocr_confidence, ocr_failed,
    empty_tables) with ``warnings`` (J7). The first page says so where no page of a document has text."""
    c = F.col
    document = Window.partitionBy("document_id")
    silent = (F.max("character_count").over(document) == 0) & (c("page_number") == F.min("page_number").over(document))
    found = F.array_compact(
        F.array(
            F.when(c("empty_tables") > 0, F.concat(F.lit("table_empty: "), c("empty_tables").cast("string"))),
            F.when(c("ocr_failed"), "ocr_failed"),
            F.when((c("page_type") == "scanned") & c("ocr_confidence").isNull() & ~c("ocr_failed"), "ocr_found_no_text"),
            F.when((c("page_type") == "scanned") & (c("ocr_confidence") < 0.5), F.concat(F.lit("low_ocr_confidence: "), F.format_number("ocr_confidence", 2))),
            F.when((c("page_type") == "text") & (c("character_count") < 20), "little_or_no_extractable_text"),
            F.when(silent, "no_text_in_document"),
        )
    )
    return pages.withColumn("warnings", found)


def plain_confidence(blocks: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """Mean confidence of blocks and tables that have one, 4 decimals."""
    rows = blocks.select(*key, "confidence").unionByName(tables.select(*key, "confidence"))
    return rows.groupBy(*key).agg(F.round(F.avg("confidence"), 4).alias("confidence"))


def table_extents(tables: DataFrame) -> DataFrame:
    """tables (rows) with row_count and column_count, the cells of the widest row."""
    wide = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))
    return tables.withColumn("row_count", F.size("rows")).withColumn("column_count", wide)


def review_gate(pages: DataFrame) -> DataFrame:
    """(document_id, status, pages_needing_review): any warning stops a document."""
    bad = F.collect_set(F.when(F.size("warnings") > 0, F.col("page_number")))
    return pages.groupBy("document_id").agg(F.array_sort(bad).alias("pages_needing_review")).withColumn("status", F.when(F.size("pages_needing_review") > 0, "NEEDS_REVIEW").otherwise("PROCESSING"))


def quality(kinds: DataFrame) -> DataFrame:
    """(document_id, total_pages, page_types) with the sorted pages of each kind."""
    per = kinds.groupBy("document_id", "page_type").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
    return per.groupBy("document_id").agg(F.sum(F.size("pages")).alias("total_pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_type", "pages")))).alias("page_types"))
