"""Document registry: versions, scopes, duplicates, sessions, deletion and status, as relations.

A registry row is one version of a document: document_id, filename (the registry key), checksum,
version, status, session_id (null: the shared library).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of handled documents, and the error of a file that changed meanwhile.
HANDLED = ("CHUNKED", "NEEDS_REVIEW")
CHANGED = "File changed during processing; chunks were not saved. Rescan the file."


def latest_versions(registry: DataFrame) -> DataFrame:
    """The newest version of each key, whatever its status."""
    newest = registry.groupBy("filename").agg(F.max("version").alias("version"))
    return registry.join(newest, ["filename", "version"])


def latest_document(registry: DataFrame, key: str) -> DataFrame:
    """The newest version of one key (A3, F2)."""
    return registry.where(F.col("filename") == key).orderBy(F.desc("version")).limit(1)


def document_versions(registry: DataFrame, key: str) -> DataFrame:
    return registry.where(F.col("filename") == key).orderBy("version")


def searchable(registry: DataFrame, session_links: DataFrame | None = None, session_id: str | None = None) -> DataFrame:
    """Documents a search may use (A1, D1): the newest version of a key over all statuses, and only if
    that version is CHUNKED; from the library, or from one session (C4), never both."""
    newest = latest_versions(registry).where("status = 'CHUNKED'")
    if session_id is None:
        return newest.where("session_id is null")
    mine = session_links.where(F.col("session_id") == session_id).select("document_id")
    return newest.join(mine, "document_id", "left_semi")


def latest_chunks(chunks: DataFrame, registry: DataFrame, session_links: DataFrame | None = None, session_id: str | None = None) -> DataFrame:
    """The chunks of searchable documents."""
    scope = searchable(registry, session_links, session_id).select("document_id", F.col("version").alias("document_version"), F.col("filename").alias("document_name"))
    return chunks.join(scope, ["document_id", "document_version"])


def candidates(chunks: DataFrame, registry: DataFrame, session_links: DataFrame | None = None, session_id: str | None = None) -> DataFrame:
    """``latest_chunks`` in candidate order (F1): names and chunk ids as binary strings."""
    return latest_chunks(chunks, registry, session_links, session_id).orderBy("document_name", "page_number", "chunk_id")


def register(arrivals: DataFrame) -> DataFrame:
    """Outcome of each arrival (B3, E5, S2): arrivals have seq, filename, checksum, session_id.

    An arrival whose checksum its scope has seen is a duplicate: ``already_registered`` when the
    newest registered version of the same key has it, ``duplicate_content`` otherwise (older versions
    of the same key included). Others are registered with the next version of their key. The version is
    the new one, the one that has the bytes already, or null for a duplicate."""
    scope = [F.coalesce("session_id", F.lit("")), F.col("session_id").isNull()]
    seen = F.row_number().over(Window.partitionBy("checksum", *scope).orderBy("seq"))
    first = arrivals.withColumn("is_new", (seen == 1).cast("int"))
    per_key = Window.partitionBy("filename", *scope).orderBy("seq")
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    current = F.last(F.when(F.col("is_new") == 1, F.col("checksum")), ignorenulls=True).over(before)
    outcome = F.when(F.col("is_new") == 1, "registered").when(F.col("checksum") == current, "already_registered").otherwise("duplicate_content")
    version = F.when(outcome != "duplicate_content", F.sum("is_new").over(per_key))
    return first.withColumn("outcome", outcome).withColumn("version", version.cast("int")).select("seq", "filename", "checksum", "session_id", "outcome", "version")


def current_status(events: DataFrame) -> DataFrame:
    """The newest status of each document in a log (B4): document_id, status, at."""
    return events.groupBy("document_id").agg(F.max_by("status", "at").alias("status"))


def insert_missing(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Append the rows whose key isn't there yet."""
    return rows.unionByName(new.dropDuplicates(key).join(rows.select(*key), key, "left_anti"))


def delete_documents(doomed: DataFrame, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Cascade (B6, C5): each table without the doomed document_ids, and how many rows each lost."""
    kept, counts = {}, None
    for name, rows in tables.items():
        kept[name] = rows.join(doomed.select("document_id"), "document_id", "left_anti")
        gone = rows.join(doomed.select("document_id"), "document_id", "left_semi").agg(F.count("*").alias("deleted")).withColumn("name", F.lit(name))
        counts = gone if counts is None else counts.unionByName(gone)
    return kept, counts


def removable_files(versions: DataFrame, inbox: DataFrame) -> DataFrame:
    """Paths to remove with a document (B7): archived and source paths of its versions, and inbox
    copies whose checksum one of the versions has."""
    paths = versions.select(F.col("archive_path").alias("path")).unionByName(versions.select(F.col("source_path").alias("path")))
    copies = inbox.join(versions.select("checksum"), "checksum", "left_semi").select("path")
    return paths.unionByName(copies).where("path is not null").distinct()


def end_session(session_id: str, registry: DataFrame, sessions: DataFrame, session_links: DataFrame, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Cascade of a session's end (B8): every version of each key that it uploaded, its links to reused
    documents and its own row go; returns the tables left and how many rows each lost."""
    mine = registry.where(F.col("session_id") == session_id).select("filename").distinct()
    doomed = registry.join(mine, "filename", "left_semi").select("document_id")
    other = F.col("session_id").isNull() | (F.col("session_id") != session_id)
    kept, counts = delete_documents(doomed, documents=registry, **tables)
    for name, rows in (("session_documents", session_links), ("sessions", sessions)):
        kept[name] = rows.where(other)
        counts = counts.unionByName(rows.where(~other).agg(F.count("*").alias("deleted"), F.lit(name).alias("name")))
    return kept, counts


def find_library_documents(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """paths (path, folder, name) with the library document whose current file each is (C19): in the
    ``archive`` folder by the name of its archived file, in the ``inbox`` by its own name as long as it isn't
    archived. Other folders and unknown names have none."""
    newest = latest_versions(registry).where("session_id is null")
    place = F.when(F.col("archive_path").isNotNull(), "archive").otherwise("inbox")
    name = F.coalesce(F.element_at(F.split("archive_path", "/"), -1), F.col("filename"))
    return paths.join(newest.select("document_id", "version", place.alias("folder"), name.alias("name")), ["folder", "name"], "left")


def existing(asked: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """asked with ``found``: whether any row has the same key, nulls being equal (F7). Keys are made distinct before
    they are joined, so many rows of one key cost no more than one."""
    known = rows.select(*(F.col(k).alias(f"known_{i}") for i, k in enumerate(key))).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"known_{i}")) for i, k in enumerate(key)))
    out = asked.join(known.withColumn("known", F.lit(True)), same, "left")
    return out.select(*asked.columns, F.coalesce("known", F.lit(False)).alias("found"))


def session_list(sessions: DataFrame, session_links: DataFrame) -> DataFrame:
    """Sessions with their number of documents, most recently active first."""
    found = sessions.join(session_links, "session_id", "left")
    return found.groupBy("session_id", "last_active_at").agg(F.count("document_id").alias("documents")).orderBy(F.desc("last_active_at"))


def idle_sessions(sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Sessions idle for more than so many hours, the limit itself excluded."""
    return sessions.where(F.col("last_active_at") < now - F.make_interval(hours=F.lit(hours)))


def library_copy(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """Uploads with the searchable library document that has the same bytes, if any."""
    library = searchable(registry).groupBy("checksum").agg(F.min("document_id").alias("library_id"))
    found = uploads.join(library, "checksum", "left")
    return found.withColumn("route", F.when(F.col("library_id").isNotNull(), "REUSED").otherwise("PROCESS"))


def route_uploads(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """What happens to files uploaded into sessions (S8): uploads (seq, filename, checksum, session_id) with ``route`` and
    ``document_id``. A searchable library document with the same bytes is ``REUSED``. Else the file is registered in its
    session: bytes that the session has under another name, or as an older version, are a ``DUPLICATE``; a version that is CHUNKED or
    NEEDS_REVIEW already keeps its status; all else is to ``PROCESS`` (the document is null until it is registered)."""
    rows = library_copy(uploads, registry)
    reused = rows.where("library_id is not null").select("seq", F.lit("REUSED").alias("route"), F.col("library_id").alias("document_id"))
    held = registry.where("session_id is not null")
    # What sessions hold came before all uploads, in the order of versions.
    before = held.select((F.col("version").cast("bigint") - (1 << 40)).alias("seq"), "filename", "checksum", "session_id")
    arrivals = before.unionByName(rows.where("library_id is null").select(F.col("seq").cast("bigint"), "filename", "checksum", "session_id"))
    outcomes = register(arrivals).where(F.col("seq") > -(1 << 39))
    known = held.select("session_id", "filename", "version", "status", "document_id")
    found = outcomes.join(known, ["session_id", "filename", "version"], "left")
    handled = F.col("status").isin(*HANDLED)
    route = F.when(F.col("outcome") == "duplicate_content", "DUPLICATE").when((F.col("outcome") == "already_registered") & handled, F.col("status")).otherwise("PROCESS")
    new = found.select("seq", route.alias("route"), F.when(F.col("outcome") == "already_registered", F.col("document_id")).alias("document_id"))
    return uploads.join(reused.unionByName(new), "seq")


def session_links(routed: DataFrame, links: DataFrame) -> DataFrame:
    """Links (session_id, document_id) with those that uploads add: of documents that are REUSED or CHUNKED."""
    return insert_missing(links, routed.where("route in ('REUSED', 'CHUNKED')").select("session_id", "document_id"), ["session_id", "document_id"])


def processed(documents: DataFrame) -> DataFrame:
    """documents (document_id, checksum, parse_error, pages_needing_review, chunk_error, checksum_after)
    with their final ``status`` and ``error`` (S11): a parse error fails a document, pages to review stop
    it before chunking, then a chunk error or a file that changed meanwhile fails it."""
    changed = F.when(~F.col("checksum").eqNullSafe(F.col("checksum_after")), CHANGED)
    review = F.coalesce(F.size("pages_needing_review"), F.lit(0)) > 0
    error = F.coalesce("parse_error", F.when(~review, F.coalesce(F.col("chunk_error"), changed)))
    status = F.when(error.isNotNull(), "FAILED").when(review, "NEEDS_REVIEW").otherwise("CHUNKED")
    return documents.select("*", status.alias("status"), error.alias("error"))


def staged(registered: DataFrame, registry: DataFrame) -> DataFrame:
    """What adding each file to the library does next (S9): registered are rows of ``register``,
    registry has status and has_file. Duplicates stop; a CHUNKED document is skipped while its file is
    there and else archived again; all others, NEEDS_REVIEW too, are processed."""
    current = latest_versions(registry).select("filename", "version", "status", "has_file")
    rows = registered.join(current.withColumnRenamed("version", "current"), "filename", "left")
    chunked = (F.col("outcome") == "already_registered") & (F.col("status") == "CHUNKED")
    action = F.when(F.col("outcome") == "duplicate_content", "DUPLICATE").when(chunked & F.col("has_file"), "SKIP").when(chunked, "ARCHIVE").otherwise("PROCESS")
    return rows.withColumn("action", action).drop("current", "status", "has_file")


def reprocess(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """The file that each newest version is processed from again, and whether it is (S10): of the archive,
    the inbox and the path of registration the first that exists; listing has path and checksum."""
    newest = latest_versions(registry)
    paths = newest.select("document_id", F.posexplode(F.array("archive_path", "inbox_path", "source_path")).alias("nth", "path"))
    first = paths.join(listing.withColumnRenamed("checksum", "found"), "path").groupBy("document_id").agg(F.min(F.struct("nth", "path", "found")).alias("f"))
    rows = newest.join(first, "document_id", "left")
    action = F.when(F.col("f").isNull(), "SKIPPED: source file not found").when(F.col("f.found") != F.col("checksum"), "SKIPPED: file differs").otherwise("PROCESS")
    return rows.select("document_id", "filename", F.col("f.path").alias("path"), action.alias("action"))


def missing_files(registry: DataFrame, listing: DataFrame | None) -> DataFrame:
    """Library documents whose file the listing lacks (C7, S4). None stands for an absent archive folder
    and reports nothing; an empty folder reports every document."""
    library = registry.where("session_id is null")
    return library.limit(0) if listing is None else library.join(listing, "filename", "left_anti")


def needs_processing(registry: DataFrame) -> DataFrame:
    """Newest versions the watcher still has to handle (S3); failed ones are retried."""
    return latest_versions(registry).where(~F.col("status").isin(*HANDLED))


def library_view(registry: DataFrame, chunk_counts: DataFrame, quality: DataFrame) -> DataFrame:
    """Newest library documents with chunk counts and document kinds, 0 and '' where unknown (C20, D3)."""
    newest = latest_versions(registry).where("session_id is null")
    found = newest.join(chunk_counts, "document_id", "left").join(quality, "document_id", "left")
    return found.select("filename", "document_id", "version", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("document_type", F.lit("")).alias("document_type"))


def changed_during_processing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose bytes differ after processing."""
    joined = before.join(after.withColumnRenamed("checksum", "now"), "document_id", "left")
    return joined.where(~F.col("checksum").eqNullSafe(F.col("now"))).select("document_id")


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Latest vector of each (chunk_id, model) (B2); of equal times a new one wins."""
    both = vectors.withColumn("quill_new", F.lit(0)).unionByName(new.withColumn("quill_new", F.lit(1)))
    newest = F.row_number().over(Window.partitionBy("chunk_id", "model").orderBy(F.desc("created_at"), F.desc("quill_new")))
    return both.withColumn("quill_nth", newest).where("quill_nth = 1").drop("quill_nth", "quill_new")


def archive_name(filename: str | Column, version: str | Column) -> Column:
    """<stem>.v<version><suffix>."""
    name = F.col(filename) if isinstance(filename, str) else filename
    version = F.col(version) if isinstance(version, str) else version
    suffix = F.regexp_extract(name, r"[^/.]+(\.[^/.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.concat(stem, F.lit(".v"), version.cast("string"), suffix)


def registry_key(filename: str, session_id: str) -> Column:
    """The file name, or session:<id>/<name> for uploads."""
    return F.when(F.col(session_id).isNull(), F.col(filename)).otherwise(F.concat(F.lit("session:"), F.col(session_id), F.lit("/"), F.col(filename)))
