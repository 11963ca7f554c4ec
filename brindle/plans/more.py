"""Further catalog, claim, layout, routing and scoring queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import folds
from ..operators import store as st
from .registry import query, table
from .relational import order_pairs


@query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def snk9_delete_collection(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders")
    return st.remove(o, gone, ["o_custkey"]).select(*o.columns)


@query("SELECT event_type, user_id, max(ts) AS ts, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def snk11_replace_effectiveness(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("WITH c AS (SELECT sha256(lower(text)) AS k, min(conv_id) AS first FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, turn, first <> conv_id AS hit FROM conversations JOIN c ON k = sha256(lower(text)) WHERE role = 'user'")
def snk14_summary_cache(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").withColumn("k", F.sha2(F.lower("text"), 256))
    cache = q.groupBy("k").agg(F.min("conv_id").alias("first"))
    return q.join(cache, "k").select("conv_id", "turn", (F.col("first") != F.col("conv_id")).alias("hit"))


@query("SELECT DISTINCT p_type AS word FROM part WHERE p_type LIKE '%E%' ORDER BY word")
def snk15_word_list_search(spark, d):
    return table(spark, d, "part").where(F.col("p_type").like("%E%")).select(F.col("p_type").alias("word")).distinct().orderBy("word")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), j AS (SELECT doc_id, n, regexp_matches(lower(line), 'licensed|released|rights reserved|http') AS junk FROM l), g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, junk ORDER BY n) AS island FROM j) SELECT doc_id, min(n) AS first, max(n) AS last FROM g WHERE junk GROUP BY doc_id, island")
def pf11_junk_ranges(spark, d):
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.lower("line").rlike("licensed|released|rights reserved|http"))
    w = W.partitionBy("doc_id").orderBy("at")
    return l.withColumn("island", F.col("at") - F.row_number().over(w)).groupBy("doc_id", "island").agg((F.min("at") + 1).cast("long").alias("first"), (F.max("at") + 1).cast("long").alias("last")).drop("island")


@query("SELECT DISTINCT lower(trim(p_name)) AS name FROM part WHERE NOT regexp_matches(p_name, '^[0-9]') AND NOT regexp_matches(p_name, '[<>{}]') AND length(trim(p_name)) BETWEEN 3 AND 60")
def pf13_valid_entities(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").where(~n.rlike("^[0-9]") & ~n.rlike("[<>{}]") & F.length(F.trim(n)).between(3, 60)).select(F.lower(F.trim(n)).alias("name")).distinct()


@query("SELECT event_id, value < 20 OR coalesce((props->>'$.k')::INT, 0) < 30 AS escalate FROM events")
def pf14_escalation(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return table(spark, d, "events").select("event_id", ((F.col("value") < 20) | (k < 30)).alias("escalate"))


@query("WITH r(kind, least, strategy, priority) AS (VALUES ('click', 0.0, 'fast', 1), ('click', 50.0, 'deep', 2), ('view', 0.0, 'fast', 1), ('view', 30.0, 'deep', 3)) SELECT event_id, strategy FROM events JOIN r ON event_type = kind AND value >= least QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY priority DESC, strategy) = 1")
def pf15_strategy_selection(spark, d):
    rules = spark.createDataFrame([("click", 0.0, "fast", 1), ("click", 50.0, "deep", 2), ("view", 0.0, "fast", 1), ("view", 30.0, "deep", 3)], "kind string, least double, strategy string, priority int")
    fit = table(spark, d, "events").join(F.broadcast(rules), (F.col("event_type") == F.col("kind")) & (F.col("value") >= F.col("least")))  # four rules
    return fit.groupBy("event_id").agg(F.max_by("strategy", "priority").alias("strategy"))


@query("SELECT source, doc_id, prose FROM (SELECT source, doc_id, NOT contains(text, '|') AS prose, row_number() OVER (PARTITION BY source ORDER BY contains(text, '|'), n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 8")
def pf16_prose_first(spark, d):
    w = W.partitionBy("source").orderBy("other", F.desc("n_chars"), "doc_id")
    r = table(spark, d, "documents").withColumn("other", F.contains("text", F.lit("|"))).withColumn("n", F.row_number().over(w)).where("n <= 8")
    return r.select("source", "doc_id", (~F.col("other")).alias("prose"))


@query("SELECT lower(p_type) AS name, count(DISTINCT p_size) AS mentions, max(p_retailprice) AS confidence, list_sort(list(DISTINCT p_brand)) AS signals FROM part GROUP BY 1")
def a7_candidate_fold(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_type").alias("name")).agg(F.countDistinct("p_size").alias("mentions"), F.max("p_retailprice").alias("confidence"), F.array_sort(F.collect_set("p_brand")).alias("signals"))


@query("SELECT l_suppkey AS s, l_returnflag AS type, list_sort(list(DISTINCT l_linestatus)) AS chunks FROM lineitem GROUP BY ALL")
def a8_link_grouping(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("type")).agg(F.array_sort(F.collect_set("l_linestatus")).alias("chunks"))


@query("WITH c AS (SELECT o_orderpriority AS topic, o_orderkey AS id, (o_orderkey % 3 + 1) * (o_custkey % 4) * greatest(1, o_orderkey % 5) AS weight FROM orders) SELECT topic, count(*) AS claims, sum(weight)::BIGINT AS weight, max_by(id, (weight, -id)) AS best FROM c GROUP BY 1")
def a12_claims_by_topic(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_orderpriority").alias("topic"), k.alias("id"), ((k % 3 + 1) * (F.col("o_custkey") % 4) * F.greatest(F.lit(1), k % 5)).alias("weight"))
    return c.groupBy("topic").agg(F.count("*").alias("claims"), F.sum("weight").cast("long").alias("weight"), F.max_by("id", F.struct("weight", -F.col("id"))).alias("best"))


@query("SELECT source, round((count(*) FILTER (lang = 'en') + 0.5 * count(*) FILTER (lang = 'de')) / count(*), 6)::DOUBLE AS coverage FROM documents GROUP BY 1")
def a15_coverage(spark, d):
    lang = F.col("lang")
    return table(spark, d, "documents").groupBy("source").agg(F.round((F.count_if(lang == "en") + 0.5 * F.count_if(lang == "de")) / F.count("*"), 6).alias("coverage"))


@query("SELECT conv_id, turn AS a, next AS b FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL")
def a16_flow_edges(spark, d):
    n = F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("a"), n.alias("b")).where("b is not null")


@query("SELECT CASE label % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'visual' WHEN 2 THEN 'color' ELSE 'motion' END AS vector_type, count(*) AS n, min(len(embedding)) AS dim FROM embeddings GROUP BY 1")
def a22_index_stats(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["text", "visual", "color", "motion"])), (F.col("label") % 4 + 1).cast("int"))
    return table(spark, d, "embeddings").groupBy(kind.alias("vector_type")).agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations")
def w10_heading_path(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "system", F.col("text")), ignorenulls=True).over(w).alias("heading"))


@query()
def t9_t10_token_budget(spark, d):
    """By source: short documents are required, then the others by length while they fit into 4000 tokens."""
    rows = table(spark, d, "documents").select("source", F.struct((F.col("n_chars") >= 200).alias("late"), (-F.col("n_chars")).alias("order"), F.col("doc_id").alias("id"), tx.token_estimate(F.col("text")).alias("size"), (F.col("n_chars") < 200).alias("required")).alias("x"))
    items = rows.groupBy("source").agg(F.array_sort(F.collect_list("x")).alias("items"))
    return items.select("source", folds.within_budget(F.col("items"), 4000).alias("ids"))


@query()
def sd14_online_clusters(spark, d):
    return folds.online_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.6)


@query()
def sd10_merge_names(spark, d):
    return folds.merge_names(table(spark, d, "part"), "p_brand", "p_partkey", "p_name")


@query()
def sd11_subtitles(spark, d):
    return folds.subtitles(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query()
def m7_effectiveness(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("day"), (F.col("value") > 10).alias("ok"))
    return folds.effectiveness(e, "event_type", "event_id", "day", "ok")


@query(r"WITH q AS (SELECT ['the', 'tion', 'der', 'est'] AS q), w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+'), lambda x: length(x) > 1) AS w FROM documents) SELECT doc_id, round(least(1, list_sum(list_transform(q, lambda t: ln(1 + len(list_filter(w, lambda x: x = t))))) / sqrt(greatest(1, len(w))) / 3), 6) AS overlap FROM w, q")
def r19_vocabulary_overlap(spark, d):
    terms = ["the", "tion", "der", "est"]
    words = table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    from ..operators.rank import count_of

    total = sum((F.log(1 + count_of("w", t)) for t in terms), F.lit(0.0))
    return words.select("doc_id", F.round(F.least(F.lit(1.0), total / F.sqrt(F.greatest(F.lit(1), F.size("w"))) / 3), 6).alias("overlap"))


@query(r"WITH s AS (SELECT doc_id, lang, 0.3 * least(1, n_chars / 500) + CASE WHEN contains(text, '|') THEN -0.5 ELSE 0 END + CASE WHEN ends_with(text, '.') THEN 0.2 ELSE 0 END AS score FROM documents) SELECT doc_id, lang, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, doc_id) <= 25")
def r18_fast_prefilter(spark, d):
    t = F.col("text")
    score = 0.3 * F.least(F.lit(1.0), F.col("n_chars") / 500) + F.when(F.contains(t, F.lit("|")), -0.5).otherwise(0.0) + F.when(F.endswith(t, F.lit(".")), 0.2).otherwise(0.0)
    from ..operators.rank import per_group_top

    return per_group_top(table(spark, d, "documents").select("doc_id", "lang", F.round(score, 6).alias("score")), ["lang"], "score", "doc_id", 25)


@query("WITH c AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) SELECT l_suppkey AS entity, count(*) AS mentions FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM c) GROUP BY 1 ORDER BY mentions DESC, entity LIMIT 10")
def r28_related_entities(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("l_orderkey"))
    found = table(spark, d, "lineitem").join(F.broadcast(top), "l_orderkey", "left_semi")  # twenty rows
    return found.groupBy(F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity").limit(10)


@query("WITH p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING n >= 2) SELECT a, b, n FROM p WHERE a IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND b IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ORDER BY n DESC, a, b LIMIT 500")
def kg5_cooccurrence_edges(spark, d):
    kept = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    lines = table(spark, d, "lineitem").join(kept, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return order_pairs(lines).where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(500)


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'code' WHEN contains(p_type, 'BRASS') THEN 'concept' ELSE 'technology' END AS kind FROM part")
def kg4_signal_classes(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(F.contains(t, F.lit("STEEL")), "code").when(F.contains(t, F.lit("BRASS")), "concept").otherwise("technology").alias("kind"))


@query("SELECT doc_id, ceil(n_chars / 3000)::INT AS pages, n_chars // 3000 + 1 AS last_page FROM documents")
def x4_page_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.ceil(F.col("n_chars") / 3000).cast("int").alias("pages"), F.expr("n_chars div 3000 + 1").alias("last_page"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name, '^(Mr|Mrs|Dr|Prof)\.?\s+', '')), '[^a-z0-9 ]', '', 'g')) AS normal FROM part")
def x15_normalise(spark, d):
    n = F.regexp_replace(F.lower(F.regexp_replace("p_name", r"^(Mr|Mrs|Dr|Prof)\.?\s+", "")), "[^a-z0-9 ]", "")
    return table(spark, d, "part").select("p_partkey", F.trim(n).alias("normal"))


@query(r"WITH s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS n, len(l) AS total FROM (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: length(x) > 10) AS l FROM documents)) SELECT doc_id, n, round(len(regexp_extract_all(lower(sentence), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+')) / sqrt(length(sentence)) * CASE WHEN n = 1 THEN 1.2 WHEN n = total THEN 1.1 ELSE 1 END, 6) AS score FROM s")
def x21_sentence_scores(spark, d):
    l = F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 10)
    s = table(spark, d, "documents").select("doc_id", l.alias("l")).select("doc_id", F.size("l").alias("total"), F.posexplode("l").alias("at", "sentence"))
    place = F.when(F.col("at") == 0, 1.2).when(F.col("at") == F.col("total") - 1, 1.1).otherwise(1.0)
    return s.select("doc_id", (F.col("at") + 1).cast("long").alias("n"), F.round(tx.word_count(F.col("sentence")) / F.sqrt(F.length("sentence")) * place, 6).alias("score"))


@query("SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'High' WHEN n_chars > 1000 THEN 'Medium' WHEN n_chars > 200 THEN 'Low' ELSE 'None' END AS confidence FROM documents")
def x27_confidence_bucket(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.when(n > 3000, "High").when(n > 1000, "Medium").when(n > 200, "Low").otherwise("None").alias("confidence"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+'), lambda x: list_contains(['the','and','of','to','in','der','die','und','la','de','el','que'], x))) AS stopwords FROM documents")
def x31_stopword_lookup(spark, d):
    stop = ["the", "and", "of", "to", "in", "der", "die", "und", "la", "de", "el", "que"]
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(tx.tokens(F.col("text"), 1), lambda x: x.isin(stop))).cast("long").alias("stopwords"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS short_hash, base64(from_hex(sha256(text))) AS full_hash FROM documents")
def m6_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("short_hash"), F.base64(F.unhex(F.sha2("text", 256))).alias("full_hash"))


@query("WITH v AS (SELECT user_id, avg(value) AS a, avg(CASE WHEN event_type = 'click' THEN value END) AS x FROM events GROUP BY 1) SELECT user_id, round(coalesce(x, 0.0 - a), 6) AS novelty FROM v")
def m9_novelty(spark, d):
    v = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("x"))
    return v.select("user_id", F.round(F.coalesce("x", -F.col("a")), 6).alias("novelty"))


@query("SELECT user_id, max(value) FILTER (event_type = 'click') AS a, coalesce(max(value) FILTER (event_type = 'click'), max(value) FILTER (event_type = 'view'), 0) AS best FROM events GROUP BY 1")
def m17_fallback_lookup(spark, d):
    best = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(best("click").alias("a"), F.coalesce(best("click"), best("view"), F.lit(0.0)).alias("best"))


@query("SELECT conv_id, turn, round(CASE WHEN length(text) = 0 THEN 0.1 ELSE greatest(0, least(1, 0.5 + 0.15 * least(1, length(text) / 200) - CASE WHEN contains(lower(text), 'image') THEN 0.2 ELSE 0 END)) END, 6)::DOUBLE AS score FROM conversations")
def c8_caption_quality(spark, d):
    t = F.col("text")
    score = 0.5 + 0.15 * F.least(F.lit(1.0), F.length(t) / 200) - F.when(F.contains(F.lower(t), F.lit("image")), 0.2).otherwise(0.0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(F.when(F.length(t) == 0, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), 6).alias("score"))


@query("WITH m AS (SELECT user_id, floor(value) % 9 AS bin, value FROM events), n AS (SELECT user_id, bin, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT user_id, bin FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, bin) = 1), a AS (SELECT user_id, round(avg(value), 6) AS mean, max(value) AS top, round(1 - stddev_pop(value) / nullif(avg(value), 0), 6) AS temporal FROM m GROUP BY 1) SELECT user_id, bin AS direction, mean, top, temporal FROM a JOIN b USING (user_id)")
def c13_motion_aggregate(spark, d):
    m = table(spark, d, "events").select("user_id", (F.floor("value") % 9).cast("double").alias("bin"), "value")
    b = m.groupBy("user_id", "bin").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("direction"))
    a = m.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"), F.round(1 - F.stddev_pop("value") / F.nullif(F.avg("value"), F.lit(0.0)), 6).alias("temporal"))
    return a.join(b, "user_id")


@query("WITH w AS (SELECT user_id AS page, event_id AS id, (event_id % 61) * 4 AS y, 10 + event_id % 5 AS h FROM events), o AS (SELECT *, lag(y) OVER (PARTITION BY page ORDER BY y, id) AS py, lag(h) OVER (PARTITION BY page ORDER BY y, id) AS ph FROM w), f AS (SELECT *, CASE WHEN py IS NULL OR least(y + h, py + ph) - greatest(y, py) <= 0.5 * least(h, ph) THEN 1 ELSE 0 END AS new FROM o), l AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS line FROM f) SELECT page, line::BIGINT AS line, min(y) AS top, max(y + h) AS bottom, count(*) AS words FROM l GROUP BY page, line")
def c15_words_to_lines(spark, d):
    w = W.partitionBy("page").orderBy("y", "id")
    o = table(spark, d, "events").selectExpr("user_id page", "event_id id", "(event_id % 61) * 4 y", "10 + event_id % 5 h").withColumns({"py": F.lag("y").over(w), "ph": F.lag("h").over(w)})
    new = F.col("py").isNull() | (F.expr("least(y + h, py + ph) - greatest(y, py) <= 0.5 * least(h, ph)"))
    l = o.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("line", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return l.groupBy("page", "line").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count("*").alias("words"))
