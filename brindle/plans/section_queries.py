"""Markdown queries. The documents' lines become Markdown by a rule of their numbers, so that all constructs occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as sc
from .registry import query, table

#: What a line becomes, by its number modulo eleven; fixed values.
_MARKS = {0: "# ", 3: "## ", 5: "- ", 6: "> ", 8: "### "}


def _markdown(spark, d):
    """doc_id, text: a fence about every eleventh line but one."""

    def mark(line, i):
        at = i % 11
        out = F.when(at == 9, F.concat(F.lit("```\n"), line, F.lit("\n```"))).when(at == 2, F.lit(""))
        for k, m in _MARKS.items():
            out = out.when(at == k, F.concat(F.lit(m), line))
        return out.otherwise(line)

    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


_MD = """md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE (i - 1) % 11 WHEN 9 THEN '```' || chr(10) || l || chr(10) || '```' WHEN 2 THEN '' WHEN 0 THEN '# ' || l WHEN 3 THEN '## ' || l WHEN 5 THEN '- ' || l WHEN 6 THEN '> ' || l WHEN 8 THEN '### ' || l ELSE l END), chr(10)) AS text FROM documents WHERE text IS NOT NULL),
 li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md)"""
_STRIP = r"regexp_replace({}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_SECTIONS = f"""{_MD}, lv AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,2}} ') THEN length(regexp_extract(line, '^(#+) ', 1)) ELSE 0 END AS lv FROM li WHERE NOT regexp_matches(line, '<!-- PAGE:[0-9]+(-[0-9]+)? -->')),
 se AS (SELECT *, sum((lv > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM lv),
 cut AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS n, coalesce(max(regexp_replace(line, '^[# ]+', '')) FILTER (lv > 0), '') AS heading, max(lv) AS level, {_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (lv = 0), '')")} AS content FROM se GROUP BY doc_id, sec)"""


@query(f"WITH {_SECTIONS} SELECT * FROM cut")
def x1_markdown_sections(spark, d):
    """Sections by headings of the first two levels."""
    return sc.sections(_markdown(spark, d))


@query(f"WITH RECURSIVE {_SECTIONS}, st AS (SELECT doc_id, n, heading, level, CASE WHEN heading <> '' THEN [heading] ELSE []::VARCHAR[] END AS stack FROM cut WHERE n = 1 UNION ALL SELECT c.doc_id, c.n, c.heading, c.level, CASE WHEN c.heading <> '' THEN list_append(s.stack[:greatest(c.level - 1, 0)], c.heading) ELSE s.stack[:greatest(c.level - 1, 0)] END FROM st s JOIN cut c ON c.doc_id = s.doc_id AND c.n = s.n + 1) SELECT doc_id, n, heading, level, array_to_string(stack, ' > ') AS path FROM st")
def w10_heading_stack(spark, d):
    """Heading paths by a stack."""
    return sc.heading_paths(sc.sections(_markdown(spark, d)))


@query(
    f"""WITH RECURSIVE {_SECTIONS}, tk AS (SELECT *, length(content) // 4 AS own, CASE WHEN heading = '' THEN content ELSE '## ' || heading || chr(10) || chr(10) || content END AS whole FROM cut),
 f AS (SELECT doc_id, n, own AS used, 1 AS chunk FROM tk WHERE n = 1 UNION ALL SELECT t.doc_id, t.n, CASE WHEN f.used + length(t.whole) // 4 > 400 AND f.used >= 50 THEN t.own ELSE f.used + length(t.whole) // 4 END, f.chunk + CASE WHEN f.used + length(t.whole) // 4 > 400 AND f.used >= 50 THEN 1 ELSE 0 END FROM f JOIN tk t ON t.doc_id = f.doc_id AND t.n = f.n + 1),
 j AS (SELECT t.*, f.chunk, row_number() OVER (PARTITION BY t.doc_id, f.chunk ORDER BY t.n) AS r FROM tk t JOIN f USING (doc_id, n))
 SELECT doc_id, chunk, max(heading) FILTER (r = 1) AS heading, max(level) FILTER (r = 1) AS level, min(n) AS first, max(n) AS last, {_STRIP.format("string_agg(CASE WHEN r = 1 THEN content ELSE whole END, chr(10) || chr(10) ORDER BY n)")} AS content FROM j GROUP BY ALL"""
)
def x3_merged_sections(spark, d):
    """Sections merged to 400 tokens, at least 50 (the documents are too short for the usual 4000 and 500)."""
    return sc.merged(sc.sections(_markdown(spark, d)), 400, 50)


@query(
    rf"""WITH {_MD}, fe AS (SELECT *, regexp_matches(line, '^[ \t]*```') AS fence, sum(regexp_matches(line, '^[ \t]*```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM li),
 ty AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#+ ') THEN 'heading' WHEN regexp_matches(line, '^[ \t]*>') THEN 'quote' WHEN regexp_matches(line, '^[ \t]*([-*+]|[0-9]+[.)])[ \t]+') THEN 'list' WHEN regexp_matches(line, '^[ \t\r]*$') THEN 'blank' ELSE 'sentence' END AS type FROM fe),
 op AS (SELECT *, CASE WHEN type = 'heading' THEN regexp_replace(line, '^[# ]+', '') END AS head, CASE WHEN type = 'heading' THEN length(regexp_extract(line, '^(#+) ', 1)) END AS hl, type <> coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY i), '') OR type IN ('list', 'heading') OR (fence AND fences % 2 = 1) AS opens FROM ty),
 bl AS (SELECT *, sum(opens::INT) OVER w AS block, count(head) OVER w AS sec, last_value(head IGNORE NULLS) OVER w AS heading, last_value(hl IGNORE NULLS) OVER w AS level FROM op WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 bo AS (SELECT *, CASE type WHEN 'heading' THEN regexp_replace(line, '^[# ]+', '') WHEN 'list' THEN regexp_replace(line, '^[ \t]*([-*+]|[0-9]+[.)])[ \t]+', '') WHEN 'quote' THEN regexp_replace(line, '^[ \t]*>[ ]?', '') ELSE line END AS body FROM bl WHERE type <> 'blank' AND NOT fence),
 wh AS (SELECT doc_id, block, type, sec, any_value(heading) AS heading, any_value(level) AS level, CASE WHEN type = 'code' THEN string_agg(body, chr(10) ORDER BY i) ELSE {_STRIP.format("string_agg(body, ' ' ORDER BY i)")} END AS whole FROM bo GROUP BY doc_id, block, type, sec),
 pi AS (SELECT *, CASE WHEN type = 'sentence' THEN list_filter(list_transform(string_split(regexp_replace(whole, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 1) ELSE [whole] END AS pieces FROM wh),
 rw AS (SELECT doc_id, sec, type, block, heading, level, unnest(pieces) AS text, generate_subscripts(pieces, 1) AS part FROM pi),
 ft AS (SELECT *, CASE type WHEN 'heading' THEN 0 WHEN 'sentence' THEN 1 WHEN 'list' THEN 2 WHEN 'code' THEN 3 ELSE 4 END AS ord, length(text) >= CASE WHEN type = 'code' THEN 10 ELSE 15 END AS fits FROM rw),
 be AS (SELECT *, sum(fits::INT) OVER (PARTITION BY doc_id ORDER BY sec, ord, block, part) - fits::INT AS before FROM ft),
 ti AS (SELECT *, type = 'heading' AND level = 1 AND sec = 1 AND before = 0 AS title FROM be),
 cu AS (SELECT * REPLACE (CASE WHEN type = 'code' AND length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS text) FROM ti WHERE fits OR (title AND text <> ''))
 SELECT doc_id, row_number() OVER w AS n, type, coalesce(heading, '') AS heading, coalesce(level, 0) AS level, text, sum(length(text) + 1) OVER w - 1 - length(text) AS start_char, sum(length(text) + 1) OVER w - 1 AS end_char, CASE WHEN title THEN 2.0 WHEN type IN ('heading', 'quote') THEN 1.1 WHEN type = 'sentence' THEN 1.0 WHEN type = 'list' THEN 1.05 ELSE 0.9 END::DOUBLE AS weight FROM cu WINDOW w AS (PARTITION BY doc_id ORDER BY sec, ord, block, part)"""
)
def x10_x11_typed_segments(spark, d):
    """Headings, sentences, list items, code and quotes of whole texts, with offsets and weights."""
    return sc.segments(_markdown(spark, d))


_FRONT = """fm AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '---' || chr(10) || 'lang: x' || chr(10) || 'title: "' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '"' || chr(10) || '---' || chr(10) WHEN 1 THEN '# ' || regexp_extract(html, '<h1>([^<\\n]*)', 1) || chr(10) ELSE '' END || 'Body of the page.' AS text, url FROM pages)"""


@query(rf"""WITH {_FRONT}, b AS (SELECT *, regexp_extract(text, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)', 1) AS front, regexp_replace(text, '(?s)^---[ \t]*\n.*?\n---[ \t]*(?:\n|$)', '') AS body FROM fm) SELECT page_id AS doc_id, coalesce(nullif(regexp_replace(trim(regexp_extract(front, '(?m)^title:[ \t]*([^\n]+)$', 1)), '^["'']|["'']$', '', 'g'), ''), nullif(trim(regexp_extract(body, '(?m)^# ([^\n]+)$', 1)), ''), regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '')) AS title, body FROM b""")
def x12_markdown_titles(spark, d):
    """Titles from front matter, first heading or file name."""
    title, head = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", r"<h1>([^<\n]*)", 1)
    front = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('---\nlang: x\ntitle: "'), title, F.lit('"\n---\n'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("# "), head, F.lit("\n"))).otherwise("")
    pages = table(spark, d, "pages").select("page_id", F.concat(front, F.lit("Body of the page.")).alias("text"), "url")
    return sc.titles(pages, "page_id", "text", "url")


@query("WITH m AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN '<!-- PAGE:' || (doc_id % 7 + 1) || ' -->' || chr(10) || text || chr(10) || '<!-- PAGE:' || (doc_id % 7 + 2) || '-' || (doc_id % 7 + 4) || ' -->' ELSE text END, '') AS text FROM documents), p AS (SELECT doc_id, list_min(list_transform(regexp_extract_all(text, '<!-- PAGE:([0-9]+)(?:-[0-9]+)? -->', 1), lambda x: x::BIGINT)) AS first_page, list_max(list_transform(regexp_extract_all(text, '<!-- PAGE:(?:[0-9]+-)?([0-9]+) -->', 1), lambda x: x::BIGINT)) AS last_page, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS words FROM m) SELECT doc_id, first_page, last_page, coalesce(last_page - first_page + 1, greatest(1, ceil(words / 500)))::BIGINT AS pages FROM p")
def x4_page_markers(spark, d):
    """Page spans by markers, estimated where there are none."""
    i = F.col("doc_id")
    marked = F.concat(F.lit("<!-- PAGE:"), (i % 7 + 1).cast("string"), F.lit(" -->\n"), F.col("text"), F.lit("\n<!-- PAGE:"), (i % 7 + 2).cast("string"), F.lit("-"), (i % 7 + 4).cast("string"), F.lit(" -->"))
    return sc.page_spans(table(spark, d, "documents").withColumn("text", F.when(i % 2 == 0, marked).otherwise(F.col("text"))))
