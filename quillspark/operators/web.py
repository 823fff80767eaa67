"""Web pages as search results and readable text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship

NOISE = ("script", "style", "nav", "footer", "header")


class _Visible(HTMLParser):
    """Trimmed strings outside the noise elements, and the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.strings, self.title, self.in_title = [], [], None, False

    def handle_starttag(self, tag, attrs):
        if tag in NOISE:
            self.skip.append(tag)
        self.in_title = tag == "title" and self.title is None and not self.skip

    def handle_endtag(self, tag):
        if tag in self.skip:
            del self.skip[self.skip.index(tag) :]
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title = (self.title or "") + data
        if data.strip():
            self.strings.append(data.strip())


def visible_text(page: str | None) -> tuple[str, str]:
    """(title, text): the strings of a page one per line, without noise elements."""
    p = _Visible()
    p.feed(page or "")
    p.close()
    return (p.title.strip() if p.title and p.title.strip() else "No Title"), "\n".join(p.strings)


def scrape(pages: DataFrame, max_length: int = 4000) -> DataFrame:
    """(page_id, url, title, content, status_code) of fetched pages (page_id, url, html)."""
    ship(pages.sparkSession)

    def run(batches):
        for df in batches:
            found = [visible_text(h) for h in df.html]
            yield pd.DataFrame({"page_id": df.page_id, "url": df.url, "title": [x[0] for x in found], "content": [x[1] for x in found]})

    rows = pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, title string, content string")
    return rows.select("page_id", "url", "title", text.truncate(F.col("content"), max_length).alias("content"), F.lit(200).alias("status_code"))


def site_query(query, domain):
    """``site:<domain> <query>`` where a domain is given."""
    return F.when(F.coalesce(domain, F.lit("")) == "", query).otherwise(F.concat(F.lit("site:"), domain, F.lit(" "), query))


def host(url):
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)


def offline_search(pages: DataFrame, queries: DataFrame, num_results: int = 5) -> DataFrame:
    """Stand-in for a web search (A20): pages of the wanted host by the number of query words in their
    text; (query_id, page_id, link, score, rank). queries: query_id, query, domain (null: any)."""
    from pyspark.sql import Window

    from .retrieval import small

    words = pages.select("page_id", F.col("url").alias("link"), host(F.col("url")).alias("host"), F.explode(F.array_distinct(text.tokenize(F.regexp_replace("html", "<[^>]*>", " ")))).alias("term"))
    wanted = small(queries.select("query_id", "domain", F.explode(F.array_distinct(text.tokenize(F.col("query")))).alias("term")))
    hits = words.join(wanted, "term").where("domain is null or host = domain").groupBy("query_id", "page_id", "link").agg(F.count("*").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= num_results)
