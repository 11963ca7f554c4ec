"""Composite scores, routing, claims and configured plans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..operators import rank as rk
from ..operators import texts as ops
from ..operators import waves
from .registry import query, table
from .retrieval import QUERY

_Q = "[" + ",".join(f"{v!r}::DOUBLE" for v in QUERY) + "]"


@query("""SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents WHERE n_chars > 300 GROUP BY 1 ORDER BY n DESC, source LIMIT 5""")
def src17_configured_plan(spark, d):
    config = '[{"step": "filter", "where": "n_chars > 300"}, {"step": "aggregate", "by": ["source"], "columns": {"n": "count(*)", "longest": "max(n_chars)"}}, {"step": "top", "by": ["n"], "n": 5, "ties": ["source"]}]'
    return waves.from_config(table(spark, d, "documents"), config)


@query("SELECT doc_id, length(text) AS size, CASE WHEN n_chars > 500 THEN n_chars // 4 END AS tokens, CASE WHEN lang = 'en' THEN upper(source) END AS origin FROM documents")
def p4_p5_wave_orchestrator(spark, d):
    all_waves = [
        waves.Wave("size", lambda df: {"size": F.length("text").cast("long")}, 100, emits=frozenset({"size"})),
        waves.Wave("tokens", lambda df: {"tokens": F.expr("size div 4")}, 50, needs=frozenset({"size"}), emits=frozenset({"tokens"}), when=F.col("n_chars") > 500),
        waves.Wave("origin", lambda df: {"origin": F.upper("source")}, 10, emits=frozenset({"origin"}), when=F.col("lang") == "en"),
        waves.Wave("unused", lambda df: {"unused": F.lit(1)}, 5, emits=frozenset({"unused"})),
    ]
    chosen = waves.needed(all_waves, {"tokens", "origin"})
    return waves.run(table(spark, d, "documents"), chosen).select("doc_id", "size", "tokens", "origin")


@query("SELECT 'host:' || regexp_extract(url, '://([^/?#]*)', 1) AS id, 'host' AS kind, count(*) AS n FROM pages GROUP BY 1 UNION ALL SELECT 'lang:' || regexp_extract(url, '://[^/]*/([a-z]+)/', 1), 'lang', count(*) FROM pages GROUP BY 1")
def kg6_implicit_entities(spark, d):
    p = table(spark, d, "pages").select(F.explode(F.array(F.struct(F.lit("host").alias("kind"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("v")), F.struct(F.lit("lang").alias("kind"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("v")))).alias("x"))
    return p.groupBy(F.concat("x.kind", F.lit(":"), "x.v").alias("id"), F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH s AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS similarity, vec_id // 100 AS batch FROM embeddings), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY batch ORDER BY similarity DESC, vec_id) <= 20) SELECT vec_id, batch, round(similarity, 6) AS similarity FROM b ORDER BY similarity DESC, vec_id LIMIT 30")
def r22_hierarchical_batches(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", vx.cosine(F.col("embedding"), vx.literal(QUERY)).alias("similarity"), F.expr("vec_id div 100").alias("batch"))
    best = rk.per_group_top(s, ["batch"], "similarity", "vec_id", 20).withColumn("similarity", F.round("similarity", 6))
    return rk.top_k(best, 30, "similarity", "vec_id")


@query("WITH r AS (SELECT conv_id, turn, length(text) AS score, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations) SELECT conv_id, turn, score FROM r WHERE n <= 5 OR k <= 5")
def r24_small_document_answers(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("score"))
    return rk.per_group_top(c, ["conv_id"], "score", "turn", 5)


@query(f"WITH s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 5) SELECT vec_id, score, substr(text, 1, 200) AS citation, max(score) OVER () >= 0.3 AS on_topic FROM s JOIN documents ON doc_id = vec_id")
def r27_catalog_search(spark, d):
    s = rk.cosine_scores(table(spark, d, "embeddings").where("label in (1, 2, 3)"), QUERY).select("vec_id", F.round("similarity", 6).alias("score"))
    top = rk.top_k(s, 5, "score", "vec_id")
    best = F.broadcast(top.agg((F.max("score") >= 0.3).alias("on_topic")))
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("citation"))
    return docs.join(F.broadcast(top), F.col("doc_id") == F.col("vec_id")).crossJoin(best).select("vec_id", "score", "citation", "on_topic")


@query("WITH w(kind, weight) AS (VALUES ('click', 0.9), ('view', 0.4), ('purchase', 1.0)), s AS (SELECT user_id, event_type, round(avg(value) * coalesce(weight, 0.2), 6)::DOUBLE AS score FROM events LEFT JOIN w ON kind = event_type GROUP BY user_id, event_type, weight) SELECT user_id, event_type, score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) <= 2")
def r30_ledger_salience(spark, d):
    weight = F.when(F.col("event_type") == "click", 0.9).when(F.col("event_type") == "view", 0.4).when(F.col("event_type") == "purchase", 1.0).otherwise(0.2)
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value") * F.first(weight), 6).alias("score"))
    return rk.per_group_top(s, ["user_id"], "score", "event_type", 2)


@query("WITH p AS (SELECT p_partkey, p_brand, p_type, p_retailprice FROM part), b AS (SELECT p_brand, avg(p_retailprice) AS m FROM p GROUP BY 1 HAVING count(*) > 80), t AS (SELECT p_type, avg(p_retailprice) AS m FROM p GROUP BY 1) SELECT p_partkey, round(coalesce(b.m, t.m, 1.0), 4) AS weight FROM p LEFT JOIN b USING (p_brand) LEFT JOIN t USING (p_type)")
def r31_nearest_profile_weights(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    b = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mb")).where("n > 80").select("p_brand", "mb")
    t = p.groupBy("p_type").agg(F.avg("p_retailprice").alias("mt"))
    return p.join(b, "p_brand", "left").join(t, "p_type", "left").select("p_partkey", F.round(F.coalesce("mb", "mt", F.lit(1.0)), 4).alias("weight"))


@query("WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) SELECT doc_id, n, CASE WHEN starts_with(line, '#') THEN 'Heading' WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'ListItem' WHEN starts_with(line, '>') THEN 'Quote' WHEN contains(line, '|') THEN 'TableRow' ELSE 'Sentence' END AS type, CASE WHEN (n - 1) / total < 0.12 THEN 'Introduction' WHEN (n - 1) / total >= 0.88 THEN 'Conclusion' ELSE 'Body' END AS position FROM l WHERE length(line) >= 15")
def x10_x11_segments(spark, d):
    l = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", F.size("l").alias("total"), F.posexplode("l").alias("at", "line")).where(F.length("line") >= 15)
    line, place = F.col("line"), F.col("at") / F.col("total")
    kind = F.when(line.startswith("#"), "Heading").when(line.startswith("- ") | line.startswith("* "), "ListItem").when(line.startswith(">"), "Quote").when(line.contains("|"), "TableRow").otherwise("Sentence")
    return l.select("doc_id", (F.col("at") + 1).cast("long").alias("n"), kind.alias("type"), F.when(place < 0.12, "Introduction").when(place >= 0.88, "Conclusion").otherwise("Body").alias("position"))


@query(r"WITH s AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: length(x) > 0) AS s FROM documents), m AS (SELECT doc_id, len(s) AS n, len(list_filter(s, lambda x: regexp_matches(x, '[0-9]|[A-Z][a-z]+ [A-Z]'))) AS evidence FROM s) SELECT doc_id, n, round(evidence / greatest(1, n), 6) AS density, round(0.45 * least(1, n / 10) + 0.55 * evidence / greatest(1, n), 6) AS overall FROM m")
def x25_quality_metrics(spark, d):
    s = F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 0)
    m = table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.filter("s", lambda x: x.rlike("[0-9]|[A-Z][a-z]+ [A-Z]"))).alias("evidence"))
    density = F.col("evidence") / F.greatest(F.lit(1), F.col("n"))
    return m.select("doc_id", "n", F.round(density, 6).alias("density"), F.round(0.45 * F.least(F.lit(1.0), F.col("n") / 10) + 0.55 * density, 6).alias("overall"))


@query("WITH s AS (SELECT p_partkey, 0.5 * (p_size > 30)::INT + 0.3 * (p_retailprice > 1300)::INT AS photo, 0.4 * (p_size < 20)::INT + 0.2 * (p_retailprice < 1100)::INT AS icon, 0.35 AS diagram FROM part) SELECT p_partkey, CASE WHEN greatest(photo, icon, diagram) < 0.3 THEN 'Unknown' WHEN photo >= icon AND photo >= diagram THEN 'Photo' WHEN icon >= diagram THEN 'Icon' ELSE 'Diagram' END AS kind FROM s")
def c6_image_type(spark, d):
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    s, r = F.col("p_size"), F.col("p_retailprice")
    p = table(spark, d, "part").select("p_partkey", (0.5 * one(s > 30) + 0.3 * one(r > 1300)).alias("photo"), (0.4 * one(s < 20) + 0.2 * one(r < 1100)).alias("icon"), F.lit(0.35).alias("diagram"))
    best = F.greatest("photo", "icon", "diagram")
    return p.select("p_partkey", F.when(best < 0.3, "Unknown").when(F.col("photo") == best, "Photo").when(F.col("icon") == best, "Icon").otherwise("Diagram").alias("kind"))


@query("WITH a AS (SELECT user_id, event_type, max(value) AS fast FROM events WHERE value < 20 GROUP BY ALL), b AS (SELECT user_id, event_type, max(value) AS whole FROM events GROUP BY ALL) SELECT user_id, event_type, round(least(100, whole + 0.3 * (whole - coalesce(fast, 0))), 6) AS boosted FROM b LEFT JOIN a USING (user_id, event_type)")
def c9_signal_boost(spark, d):
    fast, whole = F.max(F.when(F.col("value") < 20, F.col("value"))), F.max("value")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.least(F.lit(100.0), whole + 0.3 * (whole - F.coalesce(fast, F.lit(0.0)))), 6).alias("boosted"))


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+')) AS word FROM documents), k AS (SELECT word FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10) SELECT doc_id, round(count(k.word) / count(*), 6) AS known_share FROM w LEFT JOIN k USING (word) GROUP BY 1")
def m12_spell_check_ratio(spark, d):
    """Share of words that ten documents or more use."""
    return ops.known_share(table(spark, d, "documents"), "doc_id", "text", 10)


@query("SELECT user_id || '_' || event_type AS image_id, event_id, event_type AS key, value FROM events")
def snk10_append_signals(spark, d):
    return table(spark, d, "events").select(F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("image_id"), "event_id", F.col("event_type").alias("key"), "value")


@query("WITH f AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, value FROM f WHERE before IS NULL OR abs(value - before) > 3")
def sd13_frame_dedup(spark, d):
    before = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", "value", before.alias("before")).where("before is null or abs(value - before) > 3").drop("before")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'chapter') THEN 'Book' WHEN contains(lower(text), 'abstract') THEN 'Paper' WHEN contains(lower(text), 'licensed') OR contains(lower(text), 'rights reserved') THEN 'Web' ELSE 'Unknown' END AS kind, strpos(text, chr(10)) AS content_start FROM documents")
def c2_c3_pf12_front_matter(spark, d):
    t = F.lower("text")
    kind = F.when(t.contains("chapter"), "Book").when(t.contains("abstract"), "Paper").when(t.contains("licensed") | t.contains("rights reserved"), "Web").otherwise("Unknown")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), F.instr("text", "\n").cast("long").alias("content_start"))
