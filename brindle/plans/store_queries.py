"""Sinks and incremental ingest over orders, line items, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import store as st
from .registry import query, table


@query("WITH b AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderpriority AS body FROM orders) SELECT id, max(seq) AS seq, max_by(body, seq) AS body FROM b GROUP BY 1")
def snk1_upsert_documents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("body"), "o_orderstatus")
    return st.upsert_last(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), ["id"], "seq")


@query("WITH b AS (SELECT o_custkey AS name, 1 AS mentions, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS descr, o_orderkey AS seq FROM orders) SELECT name, sum(mentions)::BIGINT AS mentions, max_by(descr, seq) FILTER (descr IS NOT NULL) AS descr FROM b GROUP BY 1")
def snk2_upsert_entities(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.lit(1).alias("mentions"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("descr"), F.col("o_orderkey").alias("seq"))
    return st.upsert_counts(o.where("seq < 1000"), o.where("seq >= 1000"), ["name"], "mentions", ["descr"], "seq")


@query("SELECT l_suppkey AS s, l_partkey AS t, l_returnflag AS type, count(*) AS weight FROM lineitem GROUP BY ALL")
def snk3_snk4_upsert_edges(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t"), F.col("l_returnflag").alias("type")).agg(F.count("*").alias("weight"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def snk5_cascade_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return st.remove(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, ["l_orderkey"])


@query("SELECT DISTINCT c_nationkey AS community, c_custkey AS member FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier")
def snk6_insert_members(spark, d):
    old = table(spark, d, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("member"))
    return st.insert_missing(old, table(spark, d, "supplier").select(F.col("s_nationkey").alias("community"), F.col("s_suppkey").alias("member")), ["community", "member"])


@query("SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL")
def snk7_segments_with_vectors(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("WITH s AS (SELECT source, doc_id, substr(sha256(text), 1, 16) AS h FROM documents), v AS (SELECT DISTINCT source, h FROM s JOIN documents USING (source, doc_id) WHERE source IN ('src1', 'src2') AND n_chars > 800) SELECT source, doc_id, h FROM s WHERE source NOT IN ('src1', 'src2') OR (source, h) IN (SELECT source, h FROM v)")
def snk8_remove_stale(spark, d):
    s = table(spark, d, "documents").select("source", "doc_id", tx.content_hash(F.col("text")).alias("h"), "n_chars")
    valid = s.where("source in ('src1', 'src2') and n_chars > 800").select("source", "h")
    return st.remove_stale(s.select("source", "doc_id", "h"), valid, "source", "h")


@query("""SELECT '"' || replace(text, '"', '""') || '"' AS body, doc_id FROM documents WHERE regexp_matches(text, '[",\r\n]')""")
def snk12_csv_quoting(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.rlike('[",\r\n]')).select(st.csv_field(t).alias("body"), "doc_id")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def snk13_markdown_output(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("m"))
    return c.select("conv_id", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("body"))


@query("SELECT lower(name) AS name, max(s) AS strength, list_sort(list(DISTINCT o)) AS sources FROM (SELECT c_mktsegment AS name, c_acctbal AS s, 'catalog' AS o FROM customer UNION ALL SELECT lower(c_mktsegment), c_acctbal + 1, 'graph' FROM customer) GROUP BY 1")
def snk16_sync_catalog(spark, d):
    c = table(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("name")).agg(F.max("c_acctbal").alias("strength"))
    catalog, graph = c.withColumn("sources", F.array(F.lit("catalog"))), c.select("name", (F.col("strength") + 1).alias("strength"), F.array(F.lit("graph")).alias("sources"))
    return st.sync_entities(catalog, graph)


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents WHERE (source, substr(sha256(text), 1, 16)) NOT IN (SELECT source, substr(sha256(text), 1, 16) FROM documents WHERE lang <> 'en')")
def src2_incremental_index(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", tx.content_hash(F.col("text")).alias("h"), "lang")
    return st.remove(rows, rows.where("lang <> 'en'"), ["source", "h"]).select("doc_id", "h")


@query("SELECT substr(sha256(text), 1, 32) AS h, source AS collection, min(doc_id) AS id FROM documents GROUP BY ALL")
def src3_upload_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 32).alias("h"), F.col("source").alias("collection")).agg(F.min("doc_id").alias("id"))


@query("SELECT user_id, list(event_type ORDER BY ts, event_id) AS keys, count(*) AS n FROM events GROUP BY 1")
def src16_load_profiles(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("m"))
    return e.select("user_id", F.transform("m", lambda x: x["event_type"]).alias("keys"), F.size("m").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def src18_scroll_by_filter(spark, d):
    wanted = table(spark, d, "part").where("p_size = 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(wanted, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")
