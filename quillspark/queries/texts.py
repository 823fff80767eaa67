"""Queries of the text functions, citations, chat and web operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import citations, web
from ..sources import tables as t



class Sql(str):
    """SQL with places {0} and {1}; other braces (of patterns) are left alone."""

    def format(self, *parts: str) -> str:
        out = str(self)
        for i, part in enumerate(parts):
            out = out.replace(f"{{{i}}}", part)
        return out


W, S, ND = text.W, text.S, text.D
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = Sql(rf"list_filter(regexp_extract_all(lower({{0}}), '[{W}]+'), lambda x: x NOT IN ({STOP}))")
STRIP = Sql(rf"regexp_replace(regexp_replace({{0}}, '^[{S}]+', ''), '[{S}]+$', '')")
COLLAPSE = Sql(STRIP.format(rf"regexp_replace({{0}}, '[{S}]+', ' ', 'g')"))


def h1_tokenize(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.array_join(text.tokenize(F.col("text")), " ").alias("tokens"))


def h2_token_counts(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.approximate_tokens(F.col("text")).alias("tokens"))


def h4_furniture_keys(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.md5(text.furniture_key(F.col("text"))).alias("norm"))


def h5_line_kinds(spark, d):
    b = t.blocks(spark, d)
    c = F.col("text")
    return b.groupBy("document_id").agg(F.count_if(text.is_page_number(c)).alias("page_numbers"), F.count_if(text.is_heading(c)).alias("headings"), F.count_if(text.strip(c).rlike(text.TABLE_TITLE)).alias("titles"), F.count_if(text.strip(c).rlike(text.TABLE_NOTE)).alias("notes"))


def h10_table_headers(spark, d):
    """Parts as tables of their own: a header row of names and a row of values; odd ones have none."""
    p = t.table(spark, d, "part")
    names = F.array(F.lit("Key"), F.lit("Name"), F.lit("2024"))
    row = F.array(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string"))
    rows = F.when(F.col("p_partkey") % 2 == 0, F.array(names, row)).otherwise(F.array(row, row))
    found = p.select("p_partkey", rows.alias("rows")).withColumn("h", text.detect_header(F.col("rows"), F.lit(None).cast("array<string>")))
    return found.select("p_partkey", F.col("h.consumed").alias("consumed"), text.render_row(F.get("rows", F.lit(1)), F.col("h.names")).alias("line"))


def h15_currency(spark, d):
    o = t.table(spark, d, "orders")
    raw = F.concat(F.lit("S"), F.format_number("o_totalprice", 2), F.lit(" in S3, S"), (F.col("o_orderkey") % 9).cast("string"), F.lit("M"))
    return o.select("o_orderkey", text.fix_currency(raw).alias("fixed"))


def h16_quotes(spark, d):
    q = F.concat(F.lit("“ "), F.col("text"), F.lit("’s\n  end...”"))
    return t.table(spark, d, "benchmark").select("item_id", text.normalize_quote(q).alias("quote"))


def h17_contains_words(spark, d):
    """Benchmark openings as quotes, whole and with the last letter cut off."""
    b = t.table(spark, d, "benchmark")
    whole = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    return b.select("item_id", text.contains_words(F.col("text"), whole).alias("whole"), text.contains_words(F.col("text"), F.substring(whole, F.lit(1), F.length(whole) - 1)).alias("cut"))


def h20_relevance(spark, d):
    groups = F.array(F.array(F.lit("the"), F.lit("that")), F.array(F.lit("und"), F.lit("die"), F.lit("der")))
    return t.table(spark, d, "documents").select("doc_id", text.is_relevant(F.col("text"), groups).alias("relevant"))


def h21_checksums(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


def h25_truncate(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.md5(text.truncate(F.col("text"), 500)).alias("content"))


def h30_metadata(spark, d):
    p = t.table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("metadata_json"))
    back = F.from_json("metadata_json", "n_name string, n_regionkey int")
    return p.select("n_nationkey", "metadata_json", back["n_name"].alias("n_name"))


def h32_short_ids(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.short_id(F.concat_ws(":", "source", F.col("doc_id").cast("string"), "lang")).alias("short_id"))


def h34_messages(spark, d):
    n = F.col("doc_id")
    status = F.when(n % 5 == 0, "FAILED").when(n % 5 == 1, "NEEDS_REVIEW").when(n % 5 == 2, "PROCESSING").otherwise("CHUNKED")
    kind = F.when(n % 3 == 0, "scanned").when(n % 3 == 1, "mixed").otherwise("digital")
    reasons = F.transform(F.slice(F.sequence(F.lit(1), F.lit(6)), 1, (n % 6).cast("int")), lambda i: F.concat(F.lit("page "), i.cast("string"), F.lit(": why")))
    return t.table(spark, d, "documents").select("doc_id", text.processing_message(status, kind, n % 9, reasons).alias("message"))


def h33_review_reasons(spark, d):
    e = t.table(spark, d, "events").select(F.concat("event_type", F.lit(" (page "), F.col("user_id").cast("string"), F.lit("): detail")).alias("w"))
    known = {"click": "clicked", "view": "viewed", "table": "table problem"}
    return e.groupBy(text.review_reason(F.col("w"), known).alias("reason")).agg(F.count("*").alias("n")).where("n > 0")


def h35_site_queries(spark, d):
    p = t.table(spark, d, "pages")
    return p.select("page_id", web.host(F.col("url")).alias("host"), web.site_query(F.lit("find this"), F.when(F.col("page_id") % 2 == 0, web.host(F.col("url")))).alias("query"))


def p1_check_citations(spark, d):
    """Each benchmark item is a source; quotes are cut from it, from another one, or lack a source."""
    b = t.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text"))
    sources = b.select("question_id", F.lit(1).alias("number"), F.lit("doc").alias("document_name"), F.lit(1).alias("page_number"), F.col("question_id").cast("string").alias("chunk_id"), F.lit("text").alias("content_type"), "text")
    words = F.split("text", " ")
    other = b.select((F.col("question_id") + 1).alias("question_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("o"))
    good = b.select("question_id", F.lit(0).alias("pos"), F.lit(1).alias("source"), F.array_join(F.slice(words, 2, 5), " ").alias("quote"))
    again = good.withColumn("pos", F.lit(1))
    bad = other.select("question_id", F.lit(2).alias("pos"), F.lit(1).alias("source"), F.col("o").alias("quote")).join(b.select("question_id"), "question_id", "left_semi")
    none = good.withColumn("pos", F.lit(3)).withColumn("source", F.lit(7))
    quotes = good.unionByName(again).unionByName(bad).unionByName(none)
    return citations.check_citations(quotes, sources).select("question_id", "pos", "verified", "reason")


def e15_history(spark, d):
    return citations.history(t.table(spark, d, "conversations"))


def p4_rewrites(spark, d):
    c = t.table(spark, d, "conversations").where("role = 'user'")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("text").alias("question"), F.when(F.col("turn") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" again: "), "text")).alias("rewrite"), F.col("turn").alias("turns"))
    return citations.rewritten(rows)


def a21_scrape(spark, d):
    return web.scrape(t.table(spark, d, "pages"))


def a20_offline_search(spark, d):
    q = t.questions(spark, d).select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), F.lit(None).cast("string").alias("domain"))
    return web.offline_search(t.table(spark, d, "pages"), q)


QUERIES = {f.__name__: f for f in (h1_tokenize, h2_token_counts, h4_furniture_keys, h5_line_kinds, h10_table_headers, h15_currency, h16_quotes, h17_contains_words, h20_relevance, h21_checksums, h25_truncate, h30_metadata, h32_short_ids, h33_review_reasons, h34_messages, h35_site_queries, p1_check_citations, e15_history, p4_rewrites, a21_scrape, a20_offline_search)}

STRIPPED = STRIP.format("text")
QUOTED = "text || '''s end'"
#: A quote with white space collapsed, straight quotes, and no outer quotes or ellipsis at the end.
_STRAIGHT = f"translate({COLLAPSE}, '“”‘’', concat(chr(34), chr(34), chr(39), chr(39)))"
_OUTER = "concat('^[', chr(34), chr(39), ']+|[', chr(34), chr(39), ']+$')"
NORMAL = Sql(STRIP.format(f"regexp_replace(regexp_replace(regexp_replace({_STRAIGHT}, {_OUTER}, '', 'g'), '[.][.][.]$', ''), '…$', '')"))
ORACLES = {
    "h1_tokenize": f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents",
    "h2_token_counts": rf"SELECT doc_id, CAST(ceil(1.3 * len(regexp_extract_all(text, '[{W}]+|[^{W}{S}]')) + 2) AS INTEGER) AS tokens FROM documents",
    "h4_furniture_keys": f"SELECT doc_id, md5({COLLAPSE.format(rf'''regexp_replace(lower(text), '{ND}+', '#', 'g')''')}) AS norm FROM documents",
    "h5_line_kinds": rf"""WITH {t.BLOCKS_SQL}, s AS (SELECT document_id, {STRIPPED} AS x FROM blocks)
        SELECT document_id, count(*) FILTER (regexp_matches(x, '(?i)^(page[{S}]*)?{ND}+([{S}]*(of|/)[{S}]*{ND}+)?$')) AS page_numbers,
               count(*) FILTER (regexp_matches(x, '^{ND}+\.[{S}]+[^{S}]')) AS headings,
               count(*) FILTER (regexp_matches(x, '(?i)^Table[{S}]+{ND}+($|[^{W}])')) AS titles,
               count(*) FILTER (regexp_matches(x, '(?i)^(Notes?|Footnotes?|Source)[{S}]*:')) AS notes FROM s GROUP BY document_id""",
    "h10_table_headers": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS consumed,
        CASE WHEN p_partkey % 2 = 0 THEN 'Key: ' || p_partkey || ' | Name: ' || p_name || ' | 2024: ' || p_size ELSE p_partkey || ' | ' || p_name || ' | ' || p_size END AS line FROM part""",
    "h15_currency": "SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN '$' ELSE 'S' END || format('{:,.2f}', o_totalprice) || ' in S3, $' || CAST(o_orderkey % 9 AS VARCHAR) || 'M' AS fixed FROM orders",
    "h16_quotes": f"SELECT item_id, {COLLAPSE.format(QUOTED)} AS quote FROM benchmark",
    "h17_contains_words": rf"""WITH q AS (SELECT item_id, text, array_to_string(string_split(text, ' ')[1:4], ' ') AS w FROM benchmark)
        SELECT item_id, regexp_matches(text, '(^|[^{W}])' || regexp_escape(w) || '($|[^{W}])') AS whole,
               regexp_matches(text, '(^|[^{W}])' || regexp_escape(left(w, length(w) - 1)) || '($|[^{W}])') AS cut FROM q""",
    "p1_check_citations": f"""WITH b AS (SELECT item_id AS i, text, string_split(text, ' ') AS w FROM benchmark),
        c AS (SELECT i, 0 AS pos, 1 AS source, array_to_string(w[2:6], ' ') AS quote FROM b UNION ALL SELECT i, 1, 1, array_to_string(w[2:6], ' ') FROM b
            UNION ALL SELECT i + 1, 2, 1, array_to_string(w[1:6], ' ') FROM b WHERE i + 1 IN (SELECT item_id FROM benchmark) UNION ALL SELECT i, 3, 7, array_to_string(w[2:6], ' ') FROM b),
        n AS (SELECT c.*, {NORMAL.format('quote')} AS q, CASE WHEN source = 1 THEN {NORMAL.format('b.text')} END AS t FROM c JOIN b USING (i)),
        v AS (SELECT *, CASE WHEN t IS NULL THEN 'no such source' WHEN q = '' OR NOT regexp_matches(t, '(^|[^{W}])' || regexp_escape(q) || '($|[^{W}])') THEN 'quote not in source' END AS reason FROM n),
        k AS (SELECT *, row_number() OVER (PARTITION BY i, source, q, reason IS NULL ORDER BY pos) AS nth FROM v)
        SELECT i AS question_id, pos, reason IS NULL AS verified, reason FROM k WHERE reason IS NOT NULL OR nth = 1""",
    "a20_offline_search": f"""WITH {t.QUESTIONS_SQL}, p AS (SELECT DISTINCT page_id, url AS link, unnest({TOKENS.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS term FROM pages),
        q AS (SELECT DISTINCT question_id AS query_id, unnest({TOKENS.format('question')}) AS term FROM questions),
        h AS (SELECT query_id, page_id, link, count(*) AS score FROM p JOIN q USING (term) GROUP BY ALL)
        SELECT query_id, page_id, link, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM h) WHERE rank <= 5""",
    "h20_relevance": "SELECT doc_id, (contains(text, 'the') AND contains(text, 'that')) OR (contains(text, 'und') AND contains(text, 'die') AND contains(text, 'der')) AS relevant FROM documents",
    "h21_checksums": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "h25_truncate": "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || chr(10) || '...[Content Truncated]' ELSE text END) AS content FROM documents",
    "h30_metadata": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS metadata_json, n_name FROM nation""",
    "h32_short_ids": "SELECT doc_id, doc_id || ':' || lang AS short_id FROM documents",
    "h34_messages": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Processing failed; the file is not searchable.'
        WHEN 1 THEN 'Not searchable: ' || CASE doc_id % 6 WHEN 0 THEN 'some pages could not be read' WHEN 1 THEN 'page 1: why' WHEN 2 THEN 'page 1: why; page 2: why' ELSE 'page 1: why; page 2: why; page 3: why' END || '.'
        WHEN 2 THEN 'PROCESSING' ELSE CASE doc_id % 3 WHEN 0 THEN 'Ready. Scanned document: read ' || doc_id % 9 || ' page(s) with OCR.' WHEN 1 THEN 'Ready. Mixed document: OCR used on ' || doc_id % 9 || ' page(s) with scanned content.' ELSE 'Ready.' END END AS message FROM documents""",
    "h33_review_reasons": """SELECT CASE event_type WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'viewed' ELSE event_type || ' (page ' || user_id || '): detail' END AS reason, count(*) AS n FROM events GROUP BY 1""",
    "h35_site_queries": """SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) AS host,
        CASE WHEN page_id % 2 = 0 THEN 'site:' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) || ' find this' ELSE 'find this' END AS query FROM pages""",
    "e15_history": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
        SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history FROM n WHERE k <= 6 GROUP BY conv_id""",
    "p4_rewrites": rf"SELECT conv_id * 100 + turn AS question_id, CASE WHEN turn % 4 = 0 THEN text ELSE {STRIP.format("('again: ' || text)")} END AS question FROM conversations WHERE role = 'user'",
}
