"""Queries over pages: Markdown, links, robots rules, crawl frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import web
from ..operators import isolation as iso
from .registry import query, table



@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<head\b[^>]*>.*?</head>', '', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '(?is)<h1\b[^>]*>(.*?)</h1>', chr(10) || '# \1' || chr(10), 'g') AS t FROM a),
 c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</?p\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM b),
 e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM c)
 SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS markdown FROM e"""
)
def src7_html_to_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_to_markdown(F.col("html")).alias("markdown"))


@query(
    r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*"([^"]*)"', 1)) AS href FROM pages), p AS (SELECT page_id, url, regexp_replace(href, '#.*$', '') AS p FROM h WHERE href <> '' AND href NOT LIKE '#%')
 SELECT page_id, CASE WHEN starts_with(p, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || p WHEN regexp_matches(p, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN p ELSE regexp_extract(url, '^([a-zA-Z]+://[^?#]*/)', 1) || p END AS link FROM p"""
)
def src11_links(spark, d):
    return web.links(table(spark, d, "pages"))


@query(r"SELECT page_id, '# ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || '> Source: ' || url AS head, length(regexp_extract(html, '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1)) AS n FROM pages")
def src12_main_content(spark, d):
    head = F.concat(F.lit("# "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("\n> Source: "), F.col("url"))
    return table(spark, d, "pages").select("page_id", head.alias("head"), F.length(F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)(?:</article>|\z)", 1)).cast("long").alias("n"))


@query("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, NOT (regexp_extract(url, '://[^/?#]*([^?#]*)', 1) LIKE '/en/1%') OR regexp_extract(url, '://[^/?#]*([^?#]*)', 1) LIKE '/en/12%' AS allowed FROM pages")
def src13_robots(spark, d):
    probes = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path")).distinct()
    robots = probes.select("host").distinct().withColumn("content", F.lit("# rules\nUser-agent: *\nDisallow: /en/1*\nAllow: /en/12\nnonsense\nUser-agent: other\nDisallow: /\n"))
    return web.allowed(probes, web.robots_rules(robots))


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_name AS src, n_name AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey), h(node, depth) AS (SELECT lower(min(c_name)), 0 FROM customer UNION SELECT lower(dst), depth + 1 FROM h JOIN e ON lower(src) = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM h GROUP BY 1")
def src10_crawl_frontier(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    edges = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst")).distinct()
    edges = edges.union(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"))
    return web.crawl(edges, c.agg(F.min("c_name").alias("node")), 3)


@query("SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '://(localhost|127\\.|10\\.|192\\.168\\.)') AS fetchable FROM pages")
def src8_fetch_guard(spark, d):
    return table(spark, d, "pages").select("page_id", (~web.url_is_blocked("url")).alias("fetchable"))


@query("SELECT page_id, html NOT LIKE '%onclick=%' AND html NOT LIKE '%javascript:%' AS safe, len(regexp_extract_all(html, '<script')) AS scripts FROM pages")
def src9_sanitize_report(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", (~F.contains(h, F.lit("onclick=")) & ~F.contains(h, F.lit("javascript:"))).alias("safe"), F.regexp_count(h, F.lit("<script")).cast("long").alias("scripts"))


def _page_facts(html: str | None) -> dict:
    """Title and number of paragraphs of a page; a page with a number of the unlucky kind cannot be read."""
    if "<h1>" not in html:
        raise ValueError("no heading")
    title = html.split("<h1>", 1)[1].split("</h1>", 1)[0]
    if title.count(" ") % 5 == 4:
        raise KeyError("unlucky")
    return {"title": title, "paragraphs": html.count("<p>")}


@query(
    """WITH h AS (SELECT page_id, contains(html, '<h1>') AS has, split_part(split_part(html, '<h1>', 2), '</h1>', 1) AS title, (length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs FROM pages), s AS (SELECT *, CASE WHEN NOT has THEN 'ValueError: no heading' WHEN (length(title) - length(replace(title, ' ', ''))) % 5 = 4 THEN 'KeyError: ''unlucky''' END AS error FROM h)
 SELECT page_id, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN paragraphs END AS paragraphs FROM s"""
)
def p6_isolated_failures(spark, d):
    """Titles of pages; those that cannot be read fail by themselves."""
    pages = table(spark, d, "pages").where("html is not null")
    return iso.isolated(pages, _page_facts, "title string, paragraphs long", "page_id", "html")
