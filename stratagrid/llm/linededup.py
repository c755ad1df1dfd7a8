"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency on a site is the number of the site's pages that
contain it divided by the site's pages; a line whose frequency exceeds max_ratio, on at least
min_pages pages, is boilerplate there and is dropped from the site's pages. The same line stays
on sites where it is rare.

Lines are counted by 64-bit hash, each once a page, within tasks before the shuffle, so a site
that holds a third of all pages is many small partial counts. A site has at most
(mean lines a page) / max_ratio boilerplate lines; they are sent to every task only if they are
few in all (broadcast_lines), else joined by host with Spark's skew handling.

Defined results: a null text or html has no lines; a null or malformed url belongs to the host
'' (one site); repeated page ids and rows are pages of their own; extra columns are ignored; an
empty table gives an empty result. Lines have white space runs folded, empty lines are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import text_or_empty, written

#: Markup that holds no text, and elements that end a line. One dialect for Spark and RE2.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|button|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/][^>]*)?>"
TAG = r"<[A-Za-z/!?][^>]*>"
#: Character references in the order they are replaced.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SPACE = r"[ \t\r\f\x0B]+"


def html_text(html: Column) -> Column:
    """Text of a page, a line for each block element."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(text: Column) -> Column:
    """Lines with folded white space, without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")


def drop_site_lines(pages: DataFrame, host: Column, text: Column, *, max_ratio: float = 0.03, min_pages: int = 4, broadcast_lines: int = 500_000) -> DataFrame:
    """pages with host, kept (array of lines) and n_lines, n_dropped."""
    rows = pages.withColumns({"host": host, "lines": lines_of(text)})
    hashed = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    counts = rows.select("host", F.explode(hashed).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    common = counts.join(totals, "host").where(F.col("n") > max_ratio * F.col("pages"))
    by_host = written(common.groupBy("host").agg(F.collect_set("h").alias("boilerplate")), "site-lines")
    size = by_host.agg(F.coalesce(F.sum(F.size("boilerplate") + 8), F.lit(0))).first()[0]
    # the side is bounded by what was counted just now
    small = F.broadcast(by_host) if size <= broadcast_lines else by_host
    out = rows.join(small, "host", "left").withColumn("kept", F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", F.xxhash64(x)))))
    return out.withColumns({"n_lines": F.size("lines").cast("long"), "n_dropped": (F.size("lines") - F.size("kept")).cast("long")}).drop("boilerplate", "lines")


def clean_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text of every page."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    out = drop_site_lines(rows, host_of(F.col("url")), html_text(F.col("html")), **options)
    return out.select("page_id", "host", "n_lines", "n_dropped", F.array_join("kept", "\n").alias("text"))


def page_report(pages: DataFrame, **options) -> DataFrame:
    """page_id, host, n_lines, n_dropped, n_chars and MD5 of the cleaned text of every page."""
    return clean_pages(pages, **options).select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _sql_text(html: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(regexp_replace(regexp_replace(coalesce({html}, ''), {q(HIDDEN)}, '', 'g'), {q(BLOCK)}, chr(10), 'g'), {q(TAG)}, '', 'g')"
    for name, char in ENTITIES:
        out = f"replace({out}, {q(name)}, {q(char)})"
    return out


def report_sql(max_ratio: float = 0.03, min_pages: int = 4) -> str:
    """DuckDB text of page_report() over pages."""
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
    list_filter(list_transform(string_split({_sql_text("html")}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
l AS (SELECT r, host, unnest(list_distinct(lines)) AS line FROM p),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT host, line FROM l GROUP BY host, line HAVING count(*) >= {min_pages} AND count(*) > {max_ratio} * (SELECT pages FROM t WHERE t.host = l.host)),
g AS (SELECT host, list(line) AS boiler FROM b GROUP BY host),
k AS (SELECT p.page_id, p.host, p.lines, list_filter(p.lines, lambda x: NOT list_contains(coalesce(g.boiler, []), x)) AS kept FROM p LEFT JOIN g ON p.host = g.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  length(coalesce(array_to_string(kept, chr(10)), ''))::BIGINT AS n_chars, md5(coalesce(array_to_string(kept, chr(10)), '')) AS text_md5
FROM k"""
