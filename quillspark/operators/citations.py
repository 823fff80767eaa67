"""Verification of quoted citations, and the outcome of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def check_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """citations (question_id, pos, source, quote) with ``verified``, the quote as shown, and ``reason``.

    sources: question_id, number (from 1), document_name, page_number, chunk_id, content_type, text.
    A quote is verified when its words occur in the source; for a table also when each of its two or
    more cells is a cell of one row, which is then shown whole. Repeated (source, quote) are dropped."""
    rows = citations.join(sources.withColumnRenamed("number", "source"), ["question_id", "source"], "left")
    quote = text.normalize_quote(F.coalesce("quote", F.lit("")))
    rows = rows.withColumn("q", quote)
    found = text.contains_words(text.normalize_quote(F.col("text")), F.col("q"))
    wanted = text.cells(F.col("q"))
    lines = F.transform(F.split("text", "\n"), text.normalize_quote)
    row = F.get(F.filter(lines, lambda x: F.size(F.array_except(wanted, text.cells(x))) == 0), F.lit(0))
    table = F.when((F.col("content_type") == "table") & (F.size(wanted) >= 2), row)
    shown = F.when(F.col("q") == "", F.lit("")).when(found, F.col("q")).otherwise(F.coalesce(table, F.lit("")))
    rows = rows.withColumn("shown", shown)
    reason = F.when(F.col("chunk_id").isNull(), "no such source").when(F.col("shown") == "", "quote not in source")
    rows = rows.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("question_id", "source", "shown", F.col("reason").isNull()).orderBy("pos"))
    rows = rows.withColumn("nth", nth).where("reason is not null or nth = 1")
    return rows.select("question_id", "pos", "source", F.when(F.col("reason").isNull(), F.col("shown")).otherwise(F.col("quote")).alias("quote"), F.col("reason").isNull().alias("verified"), "reason", "chunk_id")


def answer_status(replies: DataFrame, checked: DataFrame) -> DataFrame:
    """(question_id, status, answer): not_found without an answer, answered with at least one verified
    citation, else unsupported (P2). replies: question_id, answerable, answer."""
    n = checked.groupBy("question_id").agg(F.count_if("verified").alias("n"))
    rows = replies.join(n, "question_id", "left")
    status = F.when(~F.coalesce("answerable", F.lit(False)), "not_found").when(F.coalesce("n", F.lit(0)) > 0, "answered").otherwise("unsupported")
    return rows.select("question_id", status.alias("status"), F.when(status == "not_found", F.lit("")).otherwise(F.col("answer")).alias("answer"))


def judge(cases: DataFrame, results: DataFrame, cited: DataFrame) -> DataFrame:
    """(case_id, passed, why) (L8, C16). cases: case_id, expect_any; results: case_id, status; cited:
    case_id, text of the cited chunks. A case without expectations must be not_found, others must be
    answered from a relevant chunk."""
    rows = cases.join(results, "case_id", "left")
    good = cited.join(cases, "case_id").where(text.is_relevant(F.col("text"), F.col("expect_any"))).select("case_id").distinct().withColumn("good", F.lit(True))
    rows = rows.join(good, "case_id", "left")
    none = F.size("expect_any") == 0
    why = (
        F.when(F.col("status").isNull(), "no result")
        .when(none & (F.col("status") != "not_found"), "answered without evidence")
        .when(~none & (F.col("status") != "answered"), F.col("status"))
        .when(~none & ~F.coalesce("good", F.lit(False)), "wrong chunk")
    )
    return rows.select("case_id", why.isNull().alias("passed"), why.alias("why"))


def render_sources(hits: DataFrame) -> DataFrame:
    """(question_id, prompt): numbered sources in rank order and the question."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("document_name"), F.lit(", page "), F.col("page_number").cast("string"), F.lit(" ("), F.col("content_type"), F.lit(")\n"), text.strip(F.col("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    return hits.groupBy("question_id", "question").agg(F.concat(F.lit("Sources:\n\n"), F.array_join(ordered, "\n\n"), F.lit("\n\nQuestion: "), F.first("question")).alias("prompt")).select("question_id", "prompt")


def history(messages: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, history): the last messages, User: or Assistant: before each."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    rows = messages.withColumn("nth", nth).where(F.col("nth") <= last).select("conv_id", "turn", line.alias("line"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("history"))


def rewritten(rewrites: DataFrame) -> DataFrame:
    """The rewritten question, or the original where there is no history or the rewrite is blank."""
    blank = text.strip(F.coalesce("rewrite", F.lit(""))) == ""
    return rewrites.select("question_id", F.when(blank | (F.coalesce("turns", F.lit(0)) == 0), F.col("question")).otherwise(text.strip(F.col("rewrite"))).alias("question"))
