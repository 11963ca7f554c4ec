"""Collections of works and map-reduce summaries over parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as sm
from .judgement_queries import _sql_list
from .registry import query, table


@query(
    rf"""WITH s AS (SELECT p_brand AS doc_id, p_partkey AS n, CASE p_size % 6 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN 'Contents' WHEN 2 THEN 'The Tragedy of ' || p_name ELSE p_name END AS heading, CASE WHEN p_partkey % 3 < 2 OR p_brand LIKE '%1' THEN 1 ELSE 2 END AS level, '- ' || p_name || ' ... 12' || chr(10) || '3. ' || p_type || ' 7' || chr(10) || 'ab' AS content FROM part),
 f AS (SELECT *, level = 1 AS first, regexp_matches(trim(heading), '(?i){sm.CHAPTER}') OR doc_id LIKE '%1' AND p AS chapter FROM (SELECT *, false AS p FROM s)), g AS (SELECT *, len(list_filter({_sql_list(sm.TOC)}, lambda w: contains(lower(heading), w))) > 0 AS toc,
 list_distinct(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[ \t]*([-*+]|\d+[.)])[ \t]+', ''), '\.{{2,}}\s*\d+$', ''), '^\d+\.\s*', ''), '\s+\d+$', ''))), lambda x: length(x) > 3)) AS entries FROM f),
 a AS (SELECT doc_id, count(*) FILTER (first) AS h1, count(*) FILTER (first AND chapter) AS chapters, count(*) FILTER (first AND NOT chapter AND NOT toc) AS works, count(*) FILTER (first AND regexp_matches(trim(heading), '(?i){sm.PLAY.replace("'", "''")}')) AS plays, coalesce(arg_min(len(entries), n) FILTER (toc), 0) AS toc_entries FROM g GROUP BY 1),
 c AS (SELECT *, chapters > 0.7 * h1 AND chapters >= 3 AS chaptered, least(1, CASE WHEN works >= 10 THEN 0.4 WHEN works >= 5 THEN 0.3 WHEN works >= 3 THEN 0.2 ELSE 0 END + CASE WHEN toc_entries >= 10 THEN 0.3 WHEN toc_entries >= 5 THEN 0.2 WHEN toc_entries > 0 THEN 0.1 ELSE 0 END + CASE WHEN doc_id LIKE '%2' THEN 0.2 ELSE 0 END + CASE WHEN plays >= 3 THEN 0.3 ELSE 0 END)::DOUBLE AS raw FROM a), d AS (SELECT *, round(raw * CASE WHEN chaptered THEN 0.2 ELSE 1 END, 6)::DOUBLE AS confidence FROM c)
 SELECT doc_id, works, chapters, toc_entries, confidence, chaptered, NOT chaptered AND (confidence >= 0.6 OR works >= 3) AS is_collection, CASE WHEN works > 20 THEN 'index' WHEN works > 10 THEN 'sampled' ELSE 'full' END AS strategy FROM d"""
)
def c4_x29_collections(spark, d):
    """Which brands' lists of parts are collections of works."""
    p = table(spark, d, "part")
    size = F.col("p_size") % 6
    heading = F.when(size == 0, F.concat(F.lit("Chapter "), F.col("p_size").cast("string"))).when(size == 1, "Contents").when(size == 2, F.concat(F.lit("The Tragedy of "), "p_name")).otherwise(F.col("p_name"))
    level = F.when((F.col("p_partkey") % 3 < 2) | F.col("p_brand").endswith("1"), 1).otherwise(2)
    content = F.concat(F.lit("- "), "p_name", F.lit(" ... 12\n3. "), "p_type", F.lit(" 7\nab"))
    sections = p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("n"), heading.alias("heading"), level.alias("level"), content.alias("content"))
    titles = p.select(F.col("p_brand").alias("doc_id")).distinct().withColumn("title", F.when(F.col("doc_id").endswith("2"), "Collected Works").otherwise("A book"))
    return sm.collections(sections, titles)


@query(
    "WITH RECURSIVE p AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) // 4 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), f AS (SELECT conv_id, turn, r, size AS used, 1 AS batch FROM p WHERE r = 1 UNION ALL SELECT p.conv_id, p.turn, p.r, CASE WHEN f.used + p.size > 85 THEN p.size ELSE f.used + p.size END, f.batch + CASE WHEN f.used + p.size > 85 THEN 1 ELSE 0 END FROM f JOIN p ON p.conv_id = f.conv_id AND p.r = f.r + 1) SELECT conv_id, turn, batch FROM f"
)
def p1_reduce_batches(spark, d):
    """Turns in batches of 85 % of a budget of 100 tokens."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return sm.batches(c, "conv_id", "turn", "text", 100).select("conv_id", "turn", "batch")


@query()
def p1_map_reduce(spark, d):
    """One summary of each conversation."""
    return sm.map_reduce(table(spark, d, "conversations"), "conv_id", "turn", "text", 60)
