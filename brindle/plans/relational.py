"""Joins, aggregations, windows, sorts and set operations of the catalog and graph stores, over the star tables.

customers play entities, orders documents, line items links, nations collections.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as gr
from .registry import query, table


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey ")
def j1_entities_of_chunk(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS weight FROM lineitem)"


def _edges(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t"))
    return gr.dealt(lines, lines.count(), "s", "t").groupBy("s", "t").agg(F.count("*").alias("weight"))


@query(f"WITH {_EDGES} SELECT s, t, weight, s_name, p_name FROM e JOIN supplier ON s_suppkey = s JOIN part ON p_partkey = t WHERE s = 5 OR t = 5")
def j2_relationships_of(spark, d):
    e = _edges(spark, d).where("s = 5 or t = 5")
    return e.join(table(spark, d, "supplier"), F.col("s") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("t") == F.col("p_partkey")).select("s", "t", "weight", "s_name", "p_name")


@query(f"WITH {_EDGES} SELECT s_name, p_name, weight FROM e JOIN supplier ON s_suppkey = s JOIN part ON p_partkey = t ORDER BY weight DESC, s_name, p_name LIMIT 100")
def j3_edges_by_weight(spark, d):
    e = _edges(spark, d).join(table(spark, d, "supplier"), F.col("s") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("t") == F.col("p_partkey"))
    return e.select("s_name", "p_name", "weight").orderBy(F.desc("weight"), "s_name", "p_name").limit(100)


@query("SELECT n_nationkey, n_name, list_sort(list(s_name) FILTER (s_name IS NOT NULL)) AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def j4_communities_with_members(spark, d):
    members = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("m"))
    joined = table(spark, d, "nation").join(members, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("n_nationkey", "n_name", F.when(F.size("m") > 0, F.col("m")).alias("members"))


@query("SELECT o_orderkey, r_name FROM orders JOIN region ON contains(lower(o_orderpriority || ' ' || o_orderstatus), lower(substr(r_name, 1, 1)))")
def j5_substring_mentions(spark, d):
    """Names inside texts; the few names are a bounded table of five."""
    region = F.broadcast(table(spark, d, "region").select("r_name"))
    text = F.lower(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus"))
    return table(spark, d, "orders").join(region, F.contains(text, F.lower(F.substring("r_name", 1, 1)))).select("o_orderkey", "r_name")


@query("WITH top AS (SELECT o_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT DISTINCT o_orderkey, s_nationkey FROM top JOIN supplier ON s_suppkey = l_suppkey WHERE n <= 3")
def j6_relationships_of_top3(spark, d):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    top = table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 3").join(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return top.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("o_orderkey", "s_nationkey").distinct()


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING shared >= 3")
def j8_cooccurrence(spark, d):
    """Pairs inside an order: an order has seven lines at most, so its pairs are few."""
    return order_pairs(table(spark, d, "lineitem")).withColumnRenamed("n", "shared").where("shared >= 3")


def order_pairs(lines):
    """(a, b, n): suppliers a < b and the orders of both; an order of seven lines has 21 pairs, three a line."""
    lines = lines.select("l_orderkey", "l_suppkey")
    n = lines.count()
    sets = gr.dealt(lines, n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("m"))
    pairs = sets.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    return gr.dealt(pairs, 3 * n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


#: Rows with the lists of their peers that a task takes.
PEER_ROWS = 50_000


def _peers(rows):
    """(k, peer), once for each value that both have, k itself included; dealt by k.

    rows is (k, v). The list of a value's keys goes to each of them, so that pairs arise
    only behind the shuffle, where all of a key are in one task; tasks grow with the rows
    (counted first). Null keys and values meet nothing.
    """
    known = rows.dropna()
    n = -(-known.count() // PEER_ROWS)
    sets = known.groupBy("v").agg(F.collect_set("k").alias("m"))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.select(F.explode("m").alias("k"), "m").repartition(max(least, n), "k").select("k", F.explode("m").alias("peer"))


@query("WITH s AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS m FROM lineitem GROUP BY 1) SELECT a.k AS a, b.k AS b, len(list_intersect(a.m, b.m)) AS shared FROM s a JOIN s b ON a.k < b.k WHERE shared > 0")
def j9_shared_chunks(spark, d):
    """By the shared value, not over all pairs of sets."""
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"))
    return _peers(s).where("k < peer").groupBy("k", "peer").agg(F.count("*").alias("shared")).select(F.col("k").alias("a"), F.col("peer").alias("b"), "shared")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j10_exists_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j11_missing_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def j12_include_navigation(spark, d):
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("customers"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS links FROM customer ORDER BY links DESC, c_custkey LIMIT 50")
def j13_top_by_links(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("links")).orderBy(F.desc("links"), "c_custkey").limit(50)


@query(f"WITH {_EDGES}, n AS (SELECT p_partkey FROM part WHERE p_size > 25), m AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) SELECT s, t, weight FROM e WHERE t IN (SELECT * FROM n) AND s IN (SELECT * FROM m)")
def j14_induced_edges(spark, d):
    parts, suppliers = table(spark, d, "part").where("p_size > 25"), table(spark, d, "supplier").where("s_acctbal > 3000")
    return _edges(spark, d).join(parts, F.col("t") == F.col("p_partkey"), "left_semi").join(suppliers, F.col("s") == F.col("s_suppkey"), "left_semi")


@query("WITH m AS (SELECT s_nationkey AS c, list(s_suppkey) AS own FROM supplier GROUP BY 1) SELECT c FROM m WHERE list_has_any(own, [3, 17, 44, 71])")
def j16_overlapping_communities(spark, d):
    members = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("long")).alias("own"))
    return members.where(F.arrays_overlap("own", F.array(*[F.lit(x).cast("long") for x in (3, 17, 44, 71)]))).select(F.col("s_nationkey").alias("c"))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem), x AS (SELECT DISTINCT a.k AS k, b.k AS peer FROM p a JOIN p b ON a.v = b.v AND a.k <> b.k) SELECT x.k AS k, count(*) AS peers, round(avg(s_acctbal), 4) AS mean FROM x JOIN supplier ON s_suppkey = peer GROUP BY 1")
def j18_peers_sharing_vectors(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"))
    pairs = _peers(p).where("k <> peer").select("k", "peer").distinct()
    return pairs.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("peer")).groupBy("k").agg(F.count("*").alias("peers"), F.round(F.avg("s_acctbal"), 4).alias("mean"))


@query("WITH r AS (SELECT event_id AS id, user_id AS frame, (event_id % 37) * 3 AS x, (event_id % 23) * 3 AS y, 10 + event_id % 7 AS w, 8 + event_id % 5 AS h FROM events), p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM r a JOIN r b ON a.frame = b.frame AND a.id < b.id) SELECT a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.5")
def j19_iou_overlap(spark, d):
    """Boxes of one frame meet in the grid cells that they touch; a pair is taken in its first common cell."""
    cell = 12
    r = table(spark, d, "events").selectExpr("event_id id", "user_id frame", "(event_id % 37) * 3 x", "(event_id % 23) * 3 y", "10 + event_id % 7 w", "8 + event_id % 5 h")
    cells = r.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w")) / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h")) / cell))))
    a, b = (cells.select("frame", "cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "y", "w", "h")]) for p in "ab")
    p = a.join(b, ["frame", "cx", "cy"]).where("a_id < b_id").where(f"cx = floor(greatest(a_x, b_x) / {cell}) and cy = floor(greatest(a_y, b_y) / {cell})")
    p = p.withColumn("i", F.expr("greatest(0, least(a_x + a_w, b_x + b_w) - greatest(a_x, b_x)) * greatest(0, least(a_y + a_h, b_y + b_h) - greatest(a_y, b_y))"))
    iou = F.col("i") / (F.col("a_w") * F.col("a_h") + F.col("b_w") * F.col("b_h") - F.col("i"))
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), iou.alias("raw")).where("raw >= 0.5").select("a", "b", F.round("raw", 6).alias("iou"))


@query("SELECT (SELECT count(*) FROM customer) AS entities, (SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM lineitem) AS links, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS sources")
def a1_table_counts(spark, d):
    counts = [table(spark, d, t).agg(F.count("*").alias(n)) for t, n in (("customer", "entities"), ("orders", "documents"))]
    counts.append(table(spark, d, "lineitem").agg(F.count("*").alias("links"), F.countDistinct("l_suppkey").alias("sources")))
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each


@query(f"WITH {_EDGES}, v AS (SELECT s AS n FROM e UNION SELECT 100000 + t FROM e) SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM v) AS connected, round(100.0 * (SELECT count(*) FROM v) / ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)), 4) AS coverage")
def a2_graph_stats(spark, d):
    e = _edges(spark, d)
    l = table(spark, d, "lineitem")
    v = l.select(F.col("l_suppkey").alias("n")).distinct().union(l.select(F.col("l_partkey") + 100000).distinct())
    v = gr.dealt(v, l.count(), "n").distinct().agg(F.count("*").alias("connected"))
    nodes = table(spark, d, "supplier").select("s_suppkey").union(table(spark, d, "part").select("p_partkey")).agg(F.count("*").alias("nodes"))
    return nodes.crossJoin(F.broadcast(e.agg(F.count("*").alias("edges")))).crossJoin(F.broadcast(v)).withColumn("coverage", F.round(100.0 * F.col("connected") / F.col("nodes"), 4))


@query("SELECT c_nationkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS completed, round(sum(o_totalprice), 2) AS bytes FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def a3_collection_rollup(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1")
def a6_a26_type_histogram(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("pct"))


@query("SELECT conv_id, arg_min(CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END, turn) AS title, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def a24_conversation_titles(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by(tx.title_of(F.col("text")), "turn").alias("title"), F.count("*").alias("n"))


@query("WITH g AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(m, 6) AS mean, round(s, 6) AS sd, round(least(1, greatest(0, m - (CASE WHEN n < 30 THEN 2.0 ELSE 1.96 END) * s / sqrt(n))), 6) AS low, round(least(1, greatest(0, m + (CASE WHEN n < 30 THEN 2.0 ELSE 1.96 END) * s / sqrt(n))), 6) AS high FROM g")
def a19_stability(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    half = F.when(F.col("n") < 30, 2.0).otherwise(1.96) * F.col("s") / F.sqrt("n")
    clip = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6)
    return g.select("event_type", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), clip(F.col("m") - half).alias("low"), clip(F.col("m") + half).alias("high"))


@query("SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def a23_rollup(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT source, lang, avg(n_chars) AS mean, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END) AS success FROM documents GROUP BY ALL")
def a20_usage_statistics(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("mean"), F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)).alias("success"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def w9_last_messages(spark, d):
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 3").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, turn, a = 1 AS first, b = 1 AS last FROM r WHERE a = 1 OR b = 1")
def w3_first_last(spark, d):
    up, down = W.partitionBy("conv_id").orderBy("turn"), W.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(up) == 1).alias("first"), (F.row_number().over(down) == 1).alias("last"))
    return r.where("first or last")


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, i, (CASE WHEN i / n < 0.12 THEN 1.3 WHEN i / n >= 0.88 THEN 1.2 ELSE 1.0 END)::DOUBLE AS weight FROM r WHERE i % 4 = 0")
def w4_w5_stride_and_position(spark, d):
    w = W.partitionBy("source")
    r = table(spark, d, "documents").select("source", "doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("i"), F.count("*").over(w).alias("n")).where("i % 4 = 0")
    at = F.col("i") / F.col("n")
    return r.select("source", "doc_id", "i", F.when(at < 0.12, 1.3).when(at >= 0.88, 1.2).otherwise(1.0).alias("weight"))


@query("WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, round(avg(abs(value - before)), 6) AS mean_step FROM l WHERE before IS NOT NULL GROUP BY 1")
def w7_pair_metrics(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    l = table(spark, d, "events").select("user_id", (F.col("value") - F.lag("value").over(w)).alias("step"))
    return l.where("step is not null").groupBy("user_id").agg(F.round(F.avg(F.abs("step")), 6).alias("mean_step"))


@query("WITH f AS (SELECT conv_id, turn, role = 'user' AS flag, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS island FROM conversations) SELECT conv_id, min(turn) AS start, max(turn) AS stop, count(*) AS n FROM f WHERE flag GROUP BY conv_id, island")
def w8_islands(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    f = table(spark, d, "conversations").withColumn("flag", F.col("role") == "user")
    f = f.withColumn("edge", (F.col("flag") != F.coalesce(F.lag("flag").over(w), ~F.col("flag"))).cast("int")).withColumn("island", F.sum("edge").over(w))
    return f.where("flag").groupBy("conv_id", "island").agg(F.min("turn").alias("start"), F.max("turn").alias("stop"), F.count("*").alias("n")).drop("island")


@query("SELECT event_type, user_id, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 2")
def w11_recent_priors(spark, d):
    w = W.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 2").select("event_type", "user_id", "value", "ts")


@query("SELECT event_type, round(median(value), 6) AS med, round(max(value), 6) AS top FROM events GROUP BY 1")
def w12_temporal_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("med"), F.round(F.max("value"), 6).alias("top"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 20")
def t12_page_of_results(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").offset(20).limit(20)


@query("SELECT doc_id, lang, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def t7_t8_sorted_documents(spark, d):
    top = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")))  # a hundred rows


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS b, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE a = 1 OR b = 1 OR a = (n + 1) // 2")
def t11_representative_works(spark, d):
    w = W.partitionBy("source", "lang")
    r = table(spark, d, "documents").select("source", "lang", "doc_id", F.row_number().over(w.orderBy("doc_id")).alias("a"), F.count("*").over(w).alias("n"))
    return r.where("a = 1 or a = n or a = (n + 1) div 2").select("source", "lang", "doc_id")


@query("SELECT l_suppkey AS n FROM lineitem UNION SELECT o_custkey FROM orders")
def sd1_union_distinct(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("n")).union(table(spark, d, "orders").select("o_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def sd3_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def sd5_distinct_by_first(spark, d):
    """First row of each key by id; an aggregate, so the keys' rows meet only as partial minima."""
    return table(spark, d, "documents").groupBy("source").agg(F.min(F.struct("doc_id", "lang")).alias("m")).select("source", "m.doc_id", "m.lang")


@query("SELECT doc_id, text FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars > 500")
def pf1_filters(spark, d):
    return table(spark, d, "documents").where((F.col("lang") == "en") & F.col("source").isin("src1", "src2") & (F.col("n_chars") > 500)).select("doc_id", "text")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND p_size < 20")
def pf2_substring_search(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") < 20)).select("p_partkey", "p_name")


@query("SELECT event_id, event_type FROM events WHERE regexp_full_match(event_type, '(?i)(c.*|view)')")
def pf3_glob_match(spark, d):
    from ..operators.signals import matches_globs

    return table(spark, d, "events").where(matches_globs(F.col("event_type"), "c*,view")).select("event_id", "event_type")


@query("WITH s AS (SELECT doc_id, 100 * (doc_id % 7) AS a, 100 * (doc_id % 7) + 50 AS b FROM documents) SELECT doc_id, a, b FROM s WHERE a < 320 AND b > 130")
def pf8_interval_overlap(spark, d):
    s = table(spark, d, "documents").select("doc_id", (100 * (F.col("doc_id") % 7)).alias("a")).withColumn("b", F.col("a") + 50)
    return s.where("a < 320 and b > 130")


@query("SELECT doc_id, substr(text, greatest(1, strpos(text, 'the') - 20), 60) AS highlight FROM documents WHERE strpos(text, 'the') > 0")
def pf9_highlight(spark, d):
    at = F.instr("text", "the")
    return table(spark, d, "documents").where(at > 0).select("doc_id", F.substring(F.col("text"), F.greatest(F.lit(1), at - 20), F.lit(60)).alias("highlight"))


@query("SELECT doc_id, regexp_matches(lower(text), 'project gutenberg|licen[sc]ed under|donat|table of contents|all rights reserved') AS boilerplate FROM documents")
def pf10_boilerplate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower("text").rlike("project gutenberg|licen[sc]ed under|donat|table of contents|all rights reserved").alias("boilerplate"))


@query("SELECT p_partkey, (CASE WHEN p_size > 25 THEN 1.0 ELSE 0 END + CASE WHEN p_retailprice > 1200 THEN 1.0 ELSE 0 END + CASE WHEN contains(p_name, 'e') THEN 1.0 ELSE 0 END) / 3 AS score FROM part")
def pf7_criteria_score(spark, d):
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return table(spark, d, "part").select("p_partkey", ((one(F.col("p_size") > 25) + one(F.col("p_retailprice") > 1200) + one(F.contains("p_name", F.lit("e")))) / 3).alias("score"))


@query("SELECT text AS query, CASE WHEN regexp_matches(lower(text), 'summary|overview|main themes|overall') THEN 'Global' WHEN regexp_matches(lower(text), 'relate|connect|compare|between') THEN 'Drift' ELSE 'Local' END AS mode FROM conversations WHERE role = 'user'")
def pf17_query_mode(spark, d):
    t = F.lower("text")
    mode = F.when(t.rlike("summary|overview|main themes|overall"), "Global").when(t.rlike("relate|connect|compare|between"), "Drift").otherwise("Local")
    return table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("query"), mode.alias("mode"))
