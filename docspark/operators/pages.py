"""Web pages: links, frontier crawl over a link table, parsing, quality filter, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T

#: Pages with fewer words are stubs.
STUB_WORDS = 100


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, link of every href, in page order."""
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "link"))


def is_section(link: Column) -> Column:
    return link.startswith("reference_guide/") & link.endswith(".html")


def is_subsection(link: Column) -> Column:
    return link.endswith(".html") & link.contains("/") & ~link.contains("..") & ~link.contains("http") & ~link.contains("#")


def is_node(link: Column) -> Column:
    return link.endswith(".html") & ~link.contains("/") & ~link.startswith("#")


def frontier(link_table: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """node, level: everything within `depth` links of the seeds(node), at its smallest level. One join a level."""
    found = seeds.select("node", F.lit(0).alias("level"))
    edge = found
    for level in range(1, depth + 1):
        edge = edge.join(link_table, edge["node"] == link_table["src"]).select(F.col("dst").alias("node"), F.lit(level).alias("level")).distinct()
        found = found.unionByName(edge)
    return found.groupBy("node").agg(F.min("level").alias("level"))


def article(html: Column) -> Column:
    """The main part: <main>, else <article>, else <body>, else all."""
    def inner(tag: str) -> Column:
        return F.nullif(F.regexp_extract(html, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))

    return F.coalesce(inner("main"), inner("article"), inner("body"), html)


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, title (first h1, else the URL's file stem), section (second path part if there are more than two), text."""
    path = F.regexp_extract(F.col("url"), r"^https?://[^/]+/([^?#]*)", 1)
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.html$", "")
    title = T.html_to_text(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    return pages.select(
        "page_id", "url", F.coalesce(F.nullif(title, F.lit("")), stem).alias("title"),
        F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise("reference_guide").alias("section"), T.html_to_text(article(F.col("html"))).alias("text"),
    )


def not_stubs(parsed: DataFrame, least: int = STUB_WORDS) -> DataFrame:
    return parsed.where(T.word_count(F.col("text")) >= least)


def url_reason(url: Column) -> Column:
    """Why a URL is not safe to fetch (null: it is): https, a host, no credentials, and no private or local IPv4 address."""
    host = F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1)
    private = host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.)") | (host == "localhost")
    return F.when(~url.startswith("https://"), "not https").when(host == "", "no host").when(url.rlike(r"^https://[^/]*@"), "credentials").when(private, "private address")


def citations(reports: DataFrame) -> DataFrame:
    """report_id, pos, url of the lines after `## Sources` up to the next heading: one URL a line, end punctuation cut, first of each kept."""
    lines = reports.select("report_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.max(F.when(F.col("line").startswith("## "), F.struct("pos", F.col("line")))).over(order)
    inside = lines.withColumn("under", heading["line"]).where("under = '## Sources' and line not like '## %'")
    found = inside.select("report_id", "pos", F.rtrim(F.regexp_extract("line", r"(https://[^\s)>]+)", 1), F.lit(".,;")).alias("url")).where("url <> ''")
    return found.groupBy("report_id", "url").agg(F.min("pos").alias("pos"))


def verify(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """cited(report_id, url) with status verified or unverified and a reason."""
    known = pages.select("url", F.lit(True).alias("known")).distinct()
    reason = F.coalesce(url_reason(F.col("url")), F.when(F.col("known").isNull(), "not found"))
    joined = cited.join(known, "url", "left").withColumn("reason", reason)
    return joined.select("report_id", "url", F.when(F.col("reason").isNull(), "verified").otherwise("unverified").alias("status"), "reason")


def citation_gate(verified: DataFrame) -> DataFrame:
    """report_id, passed, details: a report passes if all of its citations are verified."""
    bad = F.when(F.col("status") != "verified", F.concat("url", F.lit(": "), "reason"))
    return verified.groupBy("report_id").agg(F.bool_and(F.col("status") == "verified").alias("passed"), F.array_join(F.array_sort(F.collect_list(bad)), "; ").alias("details"))
