"""Graph queries: suppliers and parts are vertices, line items edges; regions, nations and people a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as gr
from ..sources.storage import materialize
from .registry import query, table

_PAIR = "SELECT DISTINCT l_suppkey::BIGINT AS src, (1000000000 + l_partkey)::BIGINT AS dst FROM lineitem"


def _edges(spark, d):
    """One edge a line item; the operators fold parallel ones."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") + 1000000000).cast("long").alias("dst"))


@query(r"WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+'), lambda x: length(x) > 2))) AS name FROM documents), c AS (SELECT count(*) AS total FROM documents), f AS (SELECT name, count(*) AS mentions FROM t GROUP BY 1) SELECT name, mentions, round(least(0.9, 0.4 + 0.05 * ln(total / mentions)), 6) AS confidence, 'technology' AS kind FROM f, c WHERE ln(total / mentions) >= 3.5 AND mentions >= 3")
def kg1_kg2_candidates(spark, d):
    return gr.significant(gr.candidates(table(spark, d, "documents"), "doc_id", "text")).select("name", "mentions", F.round("confidence", 6).alias("confidence"), "kind")


@query(r"""WITH q AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*'')', 1)) AS q FROM pages), h AS (SELECT page_id, trim(substr(q, 2, length(q) - 2)) AS href FROM q), u AS (SELECT *, regexp_matches(href, '(?i)^(https?:)?//') AS outside, regexp_replace(lower(regexp_extract(href, '^[^/]*//(?:[^/?#@]*@)?([^/?#:]*)', 1)), 'www\.', '', 'g') AS domain, regexp_extract(href, '^[^/]*//[^/?#]*/([^/?#]+/[^/?#]+)', 1) AS repository FROM h) SELECT page_id, href, CASE WHEN NOT outside THEN href WHEN domain = 'github.com' AND repository <> '' THEN 'github:' || repository ELSE 'site:' || domain END AS target, CASE WHEN outside THEN 'links_to' ELSE 'references' END AS relation FROM u WHERE CASE WHEN outside THEN domain <> '' ELSE NOT regexp_matches(href, '^(#|$|[a-zA-Z][a-zA-Z0-9+.-]*:)') END""")
def kg3_all_links(spark, d):
    return gr.link_relations(table(spark, d, "pages"))


@query("SELECT p_partkey, 'e_' || regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g') AS entity_id, regexp_replace(regexp_replace(lower(trim(p_name)), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), '[\"''`]', '', 'g') AS normal FROM part")
def kg7_entity_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.entity_id(F.col("p_name")).alias("entity_id"), tx.normalise_name(F.col("p_name")).alias("normal"))


@query("WITH e AS (SELECT l_suppkey::BIGINT AS a, (1000000000 + l_partkey)::BIGINT AS b, count(*) AS w FROM lineitem GROUP BY ALL) SELECT a, b, w AS weight FROM e UNION ALL SELECT b, a, w FROM e")
def kg9_adjacency(spark, d):
    return gr.undirected(_edges(spark, d), weight=None)


@query(f"WITH RECURSIVE e AS ({_PAIR}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), h(node, hop) AS (SELECT 7::BIGINT, 0 UNION SELECT b, hop + 1 FROM h JOIN u ON a = node WHERE hop < 2) SELECT node, min(hop) AS hop FROM h GROUP BY 1")
def kg15_two_hop(spark, d):
    return gr.k_hop(_edges(spark, d), spark.createDataFrame([(7,)], "node long"), 2)


_LEVELS = ", ".join(
    f"f{k} AS MATERIALIZED (SELECT u.b AS node, min(u.a) AS parent FROM u JOIN f{k - 1} ON u.a = f{k - 1}.node WHERE u.b NOT IN ({' UNION ALL '.join(f'SELECT node FROM f{i}' for i in range(k))}) GROUP BY 1)" for k in range(1, 6)
)


@query(
    f"""WITH RECURSIVE e AS ({_PAIR}), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), f0 AS (SELECT 3::BIGINT AS node, NULL::BIGINT AS parent), {_LEVELS},
 s AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {k} AS hop, node, parent FROM f{k}" for k in range(6))}), p AS (SELECT hop, node, parent FROM s WHERE node = 8 UNION ALL SELECT s.hop, s.node, s.parent FROM p JOIN s ON s.node = p.parent)
 SELECT hop, node FROM p"""
)
def kg16_shortest_path(spark, d):
    """A shortest path from 3 to 8 of five hops at most, each node's parent the smallest of the hop before; none without one."""
    return gr.shortest_path(_edges(spark, d), 3, 8, 5)


@query("WITH e AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1) SELECT s, s_name, degree FROM e JOIN supplier ON s_suppkey = s ORDER BY degree DESC, s LIMIT 30")
def kg17_top_nodes(spark, d):
    degree = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.countDistinct("l_partkey").alias("degree"))
    return degree.join(table(spark, d, "supplier"), F.col("s") == F.col("s_suppkey")).select("s", "s_name", "degree").orderBy(F.desc("degree"), "s").limit(30)


@query("SELECT CASE WHEN o_custkey = 10 THEN 'outgoing' ELSE 'incoming' END AS direction, o_orderkey AS other, o_orderpriority AS relation FROM orders WHERE o_custkey = 10 OR o_orderkey = 10")
def kg18_entity_detail(spark, d):
    o = table(spark, d, "orders").where("o_custkey = 10 or o_orderkey = 10")
    return o.select(F.when(F.col("o_custkey") == 10, "outgoing").otherwise("incoming").alias("direction"), F.col("o_orderkey").alias("other"), F.col("o_orderpriority").alias("relation"))


@query()
def kg10_communities(spark, d):
    return gr.label_propagation(gr.undirected(_edges(spark, d), weight=None), 5)


@query("WITH e AS (SELECT l_suppkey::BIGINT AS a, (1000000000 + l_partkey)::BIGINT AS b, count(*) AS w FROM lineitem GROUP BY ALL), u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), m AS (SELECT sum(w) AS m2 FROM u), p AS (SELECT a % 5 AS c, sum(w) AS total, sum(CASE WHEN a % 5 = b % 5 THEN w ELSE 0 END) AS inside FROM u GROUP BY 1) SELECT round(sum(inside / m2 - pow(total / m2, 2)), 6) AS modularity FROM p, m")
def kg11_modularity(spark, d):
    both = materialize(gr.undirected(_edges(spark, d), weight=None))
    placed = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node") % 5)
    return gr.modularity(both, placed).select(F.round("modularity", 6).alias("modularity"))


@query("WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ', ' ORDER BY n) AS context FROM l WHERE n <= 3 GROUP BY 1")
def kg12_kg14_context(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), 1, 3).alias("m"))
    return l.select("l_orderkey", F.array_join(F.transform("m", lambda x: x["l_partkey"].cast("string")), ", ").alias("context"))


@query("SELECT o_custkey AS name, count(DISTINCT o_orderkey) AS chunks, count(DISTINCT o_orderpriority) AS types FROM orders GROUP BY 1 HAVING types > 1")
def a13_a14_merge_and_collisions(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.countDistinct("o_orderkey").alias("chunks"), F.countDistinct("o_orderpriority").alias("types")).where("types > 1")
