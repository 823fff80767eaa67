"""Queries of the registry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as ops
from ..sources import tables as t

R = t.REGISTRY_SQL
LATEST = f"WITH {R}, latest AS (SELECT r.* FROM registry r JOIN (SELECT filename, max(version) AS version FROM registry GROUP BY filename) m USING (filename, version))"


def a2_latest_versions(spark, d):
    return ops.latest_versions(t.registry(spark, d)).select("document_id", "filename", "version", "status")


def a3_document_versions(spark, d):
    return ops.document_versions(t.registry(spark, d), "src3").select("document_id", "version")


def a3_latest_document(spark, d):
    return ops.latest_document(t.registry(spark, d), "src3").select("document_id", "version", "status")


def a1_latest_chunks(spark, d):
    chunks = t.blocks(spark, d).join(t.registry(spark, d).select("document_id", F.col("version").alias("document_version")), "document_id")
    out = ops.latest_chunks(chunks, t.registry(spark, d))
    return out.select("document_id", "document_version", "document_name", "page_number", "block_number", "text")


def c4_session_scope(spark, d):
    """Documents of one session that are the newest version of their name and chunked; names repeat 97 apart."""
    from pyspark.sql import Window

    name = F.concat("filename", F.lit("/"), (F.col("document_id") % 97).cast("string"))
    reg = t.registry(spark, d).withColumn("filename", name).withColumn("version", F.row_number().over(Window.partitionBy("filename").orderBy("document_id")))
    return ops.searchable(reg, t.links(spark, d), "s10").select("document_id", "filename", "version")


def d1_searchable_library(spark, d):
    return ops.searchable(t.registry(spark, d)).select("document_id", "filename", "version")


def b3_register(spark, d):
    docs = t.registry(spark, d)
    arrivals = docs.select(F.col("document_id").alias("seq"), "filename", "checksum", F.lit(None).cast("string").alias("session_id"))
    return ops.register(arrivals).select("seq", "filename", "outcome", "version")


def b4_current_status(spark, d):
    log = t.table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return ops.current_status(log)


def b5_insert_missing(spark, d):
    have = t.links(spark, d).where("document_id % 20 = 0")
    return ops.insert_missing(have, t.links(spark, d), ["session_id", "document_id"])


def b6_delete_cascade(spark, d):
    doomed = t.registry(spark, d).where("filename = 'src3'").select("document_id")
    return ops.delete_documents(doomed, documents=t.registry(spark, d), chunks=t.blocks(spark, d), session_documents=t.links(spark, d))[1]


def b7_removable_files(spark, d):
    versions = t.registry(spark, d).where("filename = 'src3'").select("checksum", F.when(F.col("status") == "CHUNKED", F.concat(F.lit("archive/"), F.col("document_id").cast("string"))).alias("archive_path"), F.concat(F.lit("in/"), F.col("document_id").cast("string")).alias("source_path"))
    inbox = t.registry(spark, d).where("filename <> 'src3'").select("checksum", F.concat(F.lit("inbox/"), F.col("document_id").cast("string")).alias("path"))
    return ops.removable_files(versions, inbox)


def c3_session_list(spark, d):
    active = t.table(spark, d, "events").groupBy(F.concat(F.lit("s"), (F.col("user_id") % 30).cast("string")).alias("session_id")).agg(F.max("ts").alias("last_active_at"))
    return ops.session_list(active, t.links(spark, d)).select("session_id", "documents")


def c7_missing_files(spark, d):
    listing = t.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("source").alias("filename")).where("filename <> 'src4'").distinct()
    return ops.missing_files(t.registry(spark, d), listing).select("document_id", "filename")


def c18_library_copy(spark, d):
    uploads = t.registry(spark, d).where("session_id is not null").select(F.col("document_id").alias("upload_id"), "checksum")
    return ops.library_copy(uploads, t.registry(spark, d)).select("upload_id", "library_id", "route")


def _session_registry(spark, d):
    """Library rows as they are, and every 20th document in a session's registry under the name of its source."""
    from pyspark.sql import Window

    reg = t.registry(spark, d)
    own = reg.where("document_id % 20 = 0").withColumn("version", F.row_number().over(Window.partitionBy("session_id", "filename").orderBy("document_id")))
    return reg.where("session_id is null").unionByName(own)


def s8_upload_routes(spark, d):
    """Every session document uploaded to its session, and every 7th library document to session s1."""
    reg = t.registry(spark, d)
    session = F.coalesce("session_id", F.lit("s1"))
    uploads = reg.where("session_id is not null or document_id % 7 = 1").select(F.col("document_id").alias("seq"), "filename", "checksum", session.alias("session_id"))
    return ops.route_uploads(uploads, _session_registry(spark, d)).select("seq", "session_id", "filename", "route", "document_id")


def s8_session_links(spark, d):
    """The links of all sessions after the uploads of ``s8_upload_routes``, by session."""
    links = t.links(spark, d).where("document_id % 20 = 0 and document_id % 40 = 0")
    return ops.session_links(s8_upload_routes(spark, d), links).groupBy("session_id").agg(F.count("*").alias("documents"), F.min("document_id").alias("first"), F.max("document_id").alias("last"))


def f7_known_contents(spark, d):
    """For each document, whether its session, or the library, has a document with the bytes of the one before it."""
    from pyspark.sql import Window

    reg = t.registry(spark, d)
    before = F.lag("checksum").over(Window.partitionBy("filename").orderBy("document_id"))
    asked = reg.select("document_id", "session_id", before.alias("checksum"))
    return ops.existing(asked, reg, ["checksum", "session_id"]).select("document_id", "found")


def c20_library_view(spark, d):
    counts = t.blocks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"))
    kinds = t.registry(spark, d).where("document_id % 4 = 0").select("document_id", F.lit("digital").alias("document_type"))
    return ops.library_view(t.registry(spark, d), counts, kinds)


def s3_needs_processing(spark, d):
    rows = t.registry(spark, d).withColumn("status", F.when(F.col("document_id") % 5 == 0, "FAILED").otherwise(F.col("status")))
    return ops.needs_processing(rows).select("document_id", "filename", "status")


def s6_changed_files(spark, d):
    before = t.registry(spark, d).select("document_id", "checksum")
    after = before.withColumn("checksum", F.when(F.col("document_id") % 11 == 0, F.lit("changed")).otherwise(F.col("checksum")))
    return ops.changed_during_processing(before, after)


def s7_idle_sessions(spark, d):
    active = t.table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_active_at"))
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    return ops.idle_sessions(active, now).select("session_id", F.date_format("last_active_at", "yyyy-MM-dd HH:mm:ss").alias("last_active_at"))


def b2_upsert_vectors(spark, d):
    v = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model"), F.col("label"), F.lit(0).alias("created_at"))
    new = v.where("chunk_id % 3 = 0").withColumn("label", F.col("label") + 100).withColumn("created_at", F.lit(1))
    return ops.upsert_vectors(v, new)


def b10_archive_names(spark, d):
    r = t.registry(spark, d).withColumn("file", F.concat(F.col("filename"), F.lit(".final.pdf")))
    return r.select("document_id", ops.archive_name("file", "version").alias("archive_name"), ops.registry_key("filename", "session_id").alias("registry_key"))


def d5_session_keys(spark, d):
    return t.registry(spark, d).where("session_id is not null").select("session_id", "filename").distinct()


def d11_duplicate_texts(spark, d):
    r = t.registry(spark, d)
    return r.groupBy("checksum").agg(F.count("*").alias("copies"), F.min("document_id").alias("first_id")).where("copies > 1")


def f1_candidates(spark, d):
    docs = t.registry(spark, d)
    chunks = t.blocks(spark, d).join(docs.select("document_id", F.col("version").alias("document_version")), "document_id")
    name = F.concat_ws(":", "document_id", "page_number", "block_number")
    return ops.candidates(chunks.withColumn("chunk_id", name), docs).select("document_name", "page_number", "chunk_id")


def b8_end_session(spark, d):
    sessions = t.links(spark, d).select("session_id").distinct()
    return ops.end_session("s10", t.registry(spark, d), sessions, t.links(spark, d), chunks=t.blocks(spark, d))[1]


def _filed(spark, d):
    """The registry with archived files for two of three documents."""
    archived = F.when(F.col("document_id") % 3 > 0, F.concat(F.lit("archive/"), ops.archive_name(F.concat("filename", F.lit(".pdf")), "version")))
    return t.registry(spark, d).withColumn("archive_path", archived)


def c19_find_library(spark, d):
    docs = t.registry(spark, d)
    names = docs.select(F.lit("archive").alias("folder"), ops.archive_name(F.concat("filename", F.lit(".pdf")), "version").alias("name"))
    names = names.unionByName(docs.select(F.lit("inbox").alias("folder"), F.col("filename").alias("name"))).distinct()
    return ops.find_library_documents(names.withColumn("path", F.concat_ws("/", "folder", "name")), _filed(spark, d)).select("path", "document_id", "version")


def s9_add_to_library(spark, d):
    """Every file of the library added once more, those of other documents under one name too."""
    docs = t.registry(spark, d).withColumn("has_file", F.col("document_id") % 4 > 0)
    again = ops.latest_versions(docs).select("document_id", "filename", "version", F.when(F.col("document_id") % 5 == 0, "registered").when(F.col("document_id") % 3 == 0, "duplicate_content").otherwise("already_registered").alias("outcome"))
    return ops.staged(again, docs).select("document_id", "filename", "outcome", "action")


def s10_reprocess(spark, d):
    docs = _filed(spark, d).withColumn("inbox_path", F.concat(F.lit("inbox/"), F.col("document_id").cast("string"))).withColumn("source_path", F.concat(F.lit("in/"), F.col("document_id").cast("string")))
    listing = docs.where("document_id % 2 = 0 and archive_path is not null").select(F.col("archive_path").alias("path"), "checksum")
    listing = listing.unionByName(docs.where("document_id % 5 > 0").select(F.col("source_path").alias("path"), F.when(F.col("document_id") % 7 == 1, "changed").otherwise(F.col("checksum")).alias("checksum")))
    return ops.reprocess(docs, listing)


def s11_process_documents(spark, d):
    n = F.col("document_id")
    docs = t.registry(spark, d).select("document_id", "checksum", F.when(n % 11 == 0, "not a PDF").alias("parse_error"), F.when(n % 7 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("pages_needing_review"), F.when(n % 5 == 0, "gap or overlap").alias("chunk_error"), F.when(n % 3 == 0, "other").otherwise(F.col("checksum")).alias("checksum_after"))
    return ops.processed(docs).select("document_id", "status", "error")


QUERIES = {f.__name__: f for f in (a2_latest_versions, a3_document_versions, a3_latest_document, a1_latest_chunks, c4_session_scope, d1_searchable_library, b3_register, b4_current_status, b5_insert_missing, b6_delete_cascade, b7_removable_files, c3_session_list, c7_missing_files, c18_library_copy, s8_upload_routes, s8_session_links, f7_known_contents, c20_library_view, s3_needs_processing, s6_changed_files, s7_idle_sessions, b2_upsert_vectors, b10_archive_names, d5_session_keys, d11_duplicate_texts, f1_candidates, b8_end_session, c19_find_library, s9_add_to_library, s10_reprocess, s11_process_documents)}

ROUTES = f"""{LATEST},
    up AS (SELECT document_id AS seq, filename, checksum, coalesce(session_id, 's1') AS session_id FROM registry WHERE session_id IS NOT NULL OR document_id % 7 = 1),
    lib AS (SELECT checksum, min(document_id) AS library_id FROM latest WHERE status = 'CHUNKED' AND session_id IS NULL GROUP BY checksum),
    held AS (SELECT *, row_number() OVER (PARTITION BY session_id, filename ORDER BY document_id) AS v FROM (SELECT * EXCLUDE (version) FROM registry WHERE document_id % 20 = 0)),
    a AS (SELECT v - (1::BIGINT << 40) AS seq, filename, checksum, session_id FROM held UNION ALL SELECT seq, filename, checksum, session_id FROM up WHERE checksum NOT IN (SELECT checksum FROM lib)),
    n AS (SELECT *, row_number() OVER (PARTITION BY checksum, session_id ORDER BY seq) = 1 AS is_new FROM a),
    r AS (SELECT *, (SELECT arg_max(b.checksum, b.seq) FROM n b WHERE b.filename = n.filename AND b.session_id = n.session_id AND b.seq < n.seq AND b.is_new) AS cur,
            sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, filename ORDER BY seq) AS v FROM n),
    o AS (SELECT seq, filename, session_id, CASE WHEN is_new THEN 'registered' WHEN checksum = cur THEN 'already' ELSE 'duplicate' END AS outcome, v FROM r WHERE seq >= 0),
    routed AS (SELECT o.seq, o.session_id, o.filename, CASE WHEN outcome = 'duplicate' THEN 'DUPLICATE' WHEN outcome = 'already' AND h.status IS NOT NULL THEN h.status ELSE 'PROCESS' END AS route,
            CASE WHEN outcome = 'already' THEN h.document_id END AS document_id FROM o LEFT JOIN held h ON h.session_id = o.session_id AND h.filename = o.filename AND h.v = o.v
        UNION ALL SELECT seq, session_id, filename, 'REUSED', library_id FROM up JOIN lib USING (checksum))"""
ORACLES = {
    "a2_latest_versions": f"{LATEST} SELECT document_id, filename, version, status FROM latest",
    "a3_document_versions": f"WITH {R} SELECT document_id, version FROM registry WHERE filename = 'src3' ORDER BY version",
    "a3_latest_document": f"WITH {R} SELECT document_id, version, status FROM registry WHERE filename = 'src3' ORDER BY version DESC LIMIT 1",
    "a1_latest_chunks": f"{LATEST}, {t.BLOCKS_SQL} SELECT b.document_id, l.version AS document_version, l.filename AS document_name, b.page_number, b.block_number, b.text FROM blocks b JOIN latest l USING (document_id) WHERE l.status = 'CHUNKED' AND l.session_id IS NULL",
    "c4_session_scope": f"""WITH {R}, n AS (SELECT document_id, filename || '/' || document_id % 97 AS filename, status, session_id FROM registry),
        v AS (SELECT *, row_number() OVER w AS version, max(document_id) OVER (PARTITION BY filename) AS newest FROM n WINDOW w AS (PARTITION BY filename ORDER BY document_id))
        SELECT document_id, filename, version FROM v WHERE document_id = newest AND status = 'CHUNKED' AND session_id = 's10'""",
    "d1_searchable_library": f"WITH {R} SELECT document_id, filename, version FROM registry d WHERE status = 'CHUNKED' AND session_id IS NULL AND version = (SELECT max(version) FROM registry x WHERE x.filename = d.filename)",
    "b3_register": f"""WITH {R},
        n AS (SELECT document_id AS seq, filename, checksum, CASE WHEN row_number() OVER (PARTITION BY checksum ORDER BY document_id) = 1 THEN 1 ELSE 0 END AS is_new FROM registry),
        p AS (SELECT *, (SELECT arg_max(b.checksum, b.seq) FROM n b WHERE b.filename = n.filename AND b.seq < n.seq AND b.is_new = 1) AS cur, sum(is_new) OVER (PARTITION BY filename ORDER BY seq) AS v FROM n)
        SELECT seq, filename, CASE WHEN is_new = 1 THEN 'registered' WHEN checksum = cur THEN 'already_registered' ELSE 'duplicate_content' END AS outcome,
               CASE WHEN is_new = 1 OR checksum = cur THEN CAST(v AS INTEGER) END AS version FROM p""",
    "b4_current_status": "SELECT user_id AS document_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id",
    "b5_insert_missing": f"WITH {R} SELECT session_id, document_id FROM registry WHERE session_id IS NOT NULL",
    "b6_delete_cascade": f"""WITH {R}, {t.BLOCKS_SQL}, doomed AS (SELECT document_id FROM registry WHERE filename = 'src3')
        SELECT count(*) AS deleted, 'documents' AS name FROM registry WHERE document_id IN (FROM doomed)
        UNION ALL SELECT count(*), 'chunks' FROM blocks WHERE document_id IN (FROM doomed)
        UNION ALL SELECT count(*), 'session_documents' FROM registry WHERE session_id IS NOT NULL AND document_id IN (FROM doomed)""",
    "b7_removable_files": f"""WITH {R}, v AS (SELECT * FROM registry WHERE filename = 'src3')
        SELECT 'archive/' || document_id AS path FROM v WHERE status = 'CHUNKED' UNION SELECT 'in/' || document_id FROM v
        UNION SELECT 'inbox/' || document_id FROM registry WHERE filename <> 'src3' AND checksum IN (SELECT checksum FROM v)""",
    "c3_session_list": f"""WITH {R}, s AS (SELECT DISTINCT 's' || CAST(user_id % 30 AS VARCHAR) AS session_id FROM events)
        SELECT s.session_id, count(r.document_id) AS documents FROM s LEFT JOIN registry r ON r.session_id = s.session_id GROUP BY s.session_id""",
    "c7_missing_files": f"WITH {R} SELECT document_id, filename FROM registry WHERE session_id IS NULL AND filename NOT IN (SELECT source FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src4')",
    "c18_library_copy": f"""{LATEST}, lib AS (SELECT checksum, min(document_id) AS library_id FROM latest WHERE status = 'CHUNKED' AND session_id IS NULL GROUP BY checksum)
        SELECT r.document_id AS upload_id, library_id, CASE WHEN library_id IS NULL THEN 'PROCESS' ELSE 'REUSED' END AS route FROM registry r LEFT JOIN lib USING (checksum) WHERE r.session_id IS NOT NULL""",
    "c20_library_view": f"""{LATEST}, {t.BLOCKS_SQL}, n AS (SELECT document_id, count(*) AS chunks FROM blocks GROUP BY document_id)
        SELECT filename, l.document_id, version, status, coalesce(chunks, 0) AS chunks, CASE WHEN l.document_id % 4 = 0 THEN 'digital' ELSE '' END AS document_type FROM latest l LEFT JOIN n USING (document_id) WHERE session_id IS NULL""",
    "f7_known_contents": f"""WITH {R}, a AS (SELECT document_id, session_id, lag(checksum) OVER (PARTITION BY filename ORDER BY document_id) AS c FROM registry)
        SELECT document_id, EXISTS (SELECT 1 FROM registry r WHERE r.checksum IS NOT DISTINCT FROM a.c AND r.session_id IS NOT DISTINCT FROM a.session_id) AS found FROM a""",
    "s8_upload_routes": f"{ROUTES} SELECT seq, session_id, filename, route, document_id FROM routed",
    "s8_session_links": f"""{ROUTES}, k AS (SELECT session_id, document_id FROM registry WHERE document_id % 40 = 0 UNION SELECT session_id, document_id FROM routed WHERE route IN ('REUSED', 'CHUNKED'))
        SELECT session_id, count(*) AS documents, min(document_id) AS first, max(document_id) AS last FROM k GROUP BY session_id""",
    "s3_needs_processing": f"{LATEST} SELECT document_id, filename, 'FAILED' AS status FROM latest WHERE document_id % 5 = 0",
    "s6_changed_files": "SELECT doc_id AS document_id FROM documents WHERE doc_id % 11 = 0",
    "s7_idle_sessions": "SELECT user_id AS session_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_active_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR",
    "b2_upsert_vectors": "SELECT vec_id AS chunk_id, 'm' AS model, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS created_at FROM embeddings",
    "b10_archive_names": f"WITH {R} SELECT document_id, filename || '.final.v' || version || '.pdf' AS archive_name, CASE WHEN session_id IS NULL THEN filename ELSE 'session:' || session_id || '/' || filename END AS registry_key FROM registry",
    "d5_session_keys": f"WITH {R} SELECT DISTINCT session_id, filename FROM registry WHERE session_id IS NOT NULL",
    "d11_duplicate_texts": "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "f1_candidates": f"{LATEST}, {t.BLOCKS_SQL} SELECT l.filename AS document_name, b.page_number, b.document_id || ':' || b.page_number || ':' || b.block_number AS chunk_id FROM blocks b JOIN latest l USING (document_id) WHERE l.status = 'CHUNKED' AND l.session_id IS NULL",
    "b8_end_session": f"""WITH {R}, {t.BLOCKS_SQL}, doomed AS (SELECT document_id FROM registry WHERE filename IN (SELECT filename FROM registry WHERE session_id = 's10'))
        SELECT count(*) AS deleted, 'documents' AS name FROM registry WHERE document_id IN (FROM doomed)
        UNION ALL SELECT count(*), 'chunks' FROM blocks WHERE document_id IN (FROM doomed)
        UNION ALL SELECT count(*), 'session_documents' FROM registry WHERE session_id = 's10'
        UNION ALL SELECT count(DISTINCT session_id), 'sessions' FROM registry WHERE session_id = 's10'""",
    "c19_find_library": f"""{LATEST}, p AS (SELECT DISTINCT 'archive' AS folder, filename || '.v' || version || '.pdf' AS name FROM registry UNION SELECT 'inbox', filename FROM registry)
        SELECT folder || '/' || name AS path, document_id, version FROM p LEFT JOIN (SELECT * FROM latest WHERE session_id IS NULL) l
          ON CASE folder WHEN 'archive' THEN document_id % 3 > 0 AND name = filename || '.v' || version || '.pdf' ELSE document_id % 3 = 0 AND name = filename END""",
    "s9_add_to_library": f"""{LATEST}, a AS (SELECT *, CASE WHEN document_id % 5 = 0 THEN 'registered' WHEN document_id % 3 = 0 THEN 'duplicate_content' ELSE 'already_registered' END AS outcome FROM latest)
        SELECT document_id, filename, outcome, CASE outcome WHEN 'registered' THEN 'PROCESS' WHEN 'duplicate_content' THEN 'DUPLICATE' ELSE CASE WHEN status <> 'CHUNKED' THEN 'PROCESS' WHEN document_id % 4 > 0 THEN 'SKIP' ELSE 'ARCHIVE' END END AS action FROM a""",
    "s10_reprocess": f"""{LATEST} SELECT document_id, filename, CASE WHEN document_id % 2 = 0 AND document_id % 3 > 0 THEN 'archive/' || filename || '.v' || version || '.pdf' WHEN document_id % 5 > 0 THEN 'in/' || document_id END AS path,
        CASE WHEN document_id % 2 = 0 AND document_id % 3 > 0 THEN 'PROCESS' WHEN document_id % 5 = 0 THEN 'SKIPPED: source file not found' WHEN document_id % 7 = 1 THEN 'SKIPPED: file differs' ELSE 'PROCESS' END AS action FROM latest""",
    "s11_process_documents": """SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'FAILED' WHEN doc_id % 7 = 0 THEN 'NEEDS_REVIEW' WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'FAILED' ELSE 'CHUNKED' END AS status,
        CASE WHEN doc_id % 11 = 0 THEN 'not a PDF' WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'gap or overlap' WHEN doc_id % 3 = 0 THEN 'File changed during processing; chunks were not saved. Rescan the file.' END AS error FROM documents""",
}
