"""Signals from events: user is the owner, event type the key, props.k / 100 the confidence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import signals as sg
from .registry import query, table

_SIG = "s AS (SELECT user_id, event_type, event_id, ts, value, coalesce((props->>'$.k')::INT, 0) / 100 AS confidence FROM events)"


def _signals(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)) / 100
    return table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value", k.alias("confidence"))


def _by(spark, d, strategy):
    return sg.aggregate(_signals(spark, d), ["user_id", "event_type"], strategy)


@query(f"WITH {_SIG} SELECT user_id, event_type, value FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY confidence DESC, event_id) = 1")
def a9_highest_confidence(spark, d):
    return _by(spark, d, "highest_confidence")


@query(f"WITH {_SIG} SELECT user_id, event_type, value FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def a9_most_recent(spark, d):
    return _by(spark, d, "most_recent")


@query(f"WITH {_SIG} SELECT user_id, event_type, round(sum(value * confidence) / nullif(sum(confidence), 0), 6) AS value FROM s GROUP BY ALL")
def a9_weighted_average(spark, d):
    return _by(spark, d, "weighted_average").withColumn("value", F.round("value", 6))


@query(f"WITH {_SIG}, v AS (SELECT user_id, floor(value) AS value, sum(confidence) AS votes FROM s GROUP BY ALL) SELECT user_id, value FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(votes, 6) DESC, value) = 1")
def a9_majority_vote(spark, d):
    whole = _signals(spark, d).withColumn("value", F.floor("value").cast("double"))
    votes = whole.groupBy("user_id", "value").agg(F.round(F.sum("confidence"), 6).alias("votes"))
    return votes.groupBy("user_id").agg(F.max_by("value", F.struct("votes", -F.col("value"))).alias("value"))


@query(f"WITH {_SIG} SELECT user_id, event_type, list(value ORDER BY ts, event_id) AS value FROM s GROUP BY ALL")
def a9_collect(spark, d):
    return _by(spark, d, "collect")


@query(f"WITH {_SIG} SELECT user_id, event_type, count(*) AS n, round(avg(confidence), 6) AS confidence, round(max(value), 6) AS value FROM s GROUP BY ALL")
def a10_merge_signals(spark, d):
    return _signals(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.max("value"), 6).alias("value"))


@query(f"WITH {_SIG}, b AS (SELECT user_id, event_type, value FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY confidence DESC, event_id) = 1) SELECT user_id, list(event_type ORDER BY event_type) AS keys, list(round(value, 6) ORDER BY event_type) AS vals FROM b GROUP BY 1")
def a11_profile_view(spark, d):
    best = _by(spark, d, "highest_confidence")
    rows = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", F.round("value", 6).alias("v")))).alias("m"))
    return rows.select("user_id", F.transform("m", lambda x: x["event_type"]).alias("keys"), F.transform("m", lambda x: x["v"]).alias("vals"))


@query(f"WITH {_SIG}, b AS (SELECT user_id, max_by(value, (confidence, value)) FILTER (event_type = 'click') AS a, max_by(value, (confidence, value)) FILTER (event_type = 'view') AS b FROM s GROUP BY 1) SELECT user_id, 'click-view' AS rule, a, b FROM b WHERE abs(a - b) > 5")
def j17_m11_contradictions(spark, d):
    return sg.contradictions(_signals(spark, d), "user_id", [("click-view", "click", "view", 5.0)], key="event_type")


@query(f"WITH {_SIG} SELECT event_id, round((CASE WHEN regexp_full_match(event_type, '(?i)click') THEN 1.0 WHEN regexp_full_match(event_type, '(?i)v[^.]+') THEN 0.8 ELSE 0.5 END) * confidence, 6) AS salience FROM s")
def r29_signal_salience(spark, d):
    return sg.salience(_signals(spark, d), [("click", 1.0), ("v*", 0.8)], 0.5, "event_type").select("event_id", F.round("salience", 6).alias("salience"))


@query(f"WITH {_SIG}, n AS (SELECT max(ts) AS now FROM s) SELECT event_id, round(confidence * pow(0.98, date_diff('day', ts::DATE, now::DATE)), 6) AS weight FROM s, n")
def a18_m7_decayed_weight(spark, d):
    s = _signals(spark, d)
    now = F.broadcast(s.agg(F.max("ts").alias("now")))
    return s.crossJoin(now).select("event_id", F.round(sg.decayed(F.col("confidence"), F.lit(0.98), F.datediff("now", "ts")), 6).alias("weight"))


@query(f"WITH {_SIG}, p AS (SELECT user_id, round(value) AS bucket, confidence FROM s), h AS (SELECT user_id, bucket, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT user_id, sum(n) AS n FROM h GROUP BY 1) SELECT user_id, round(-sum(h.n / t.n * log2(h.n / t.n)), 6) AS entropy FROM h JOIN t USING (user_id) GROUP BY 1")
def m4_entropy(spark, d):
    h = _signals(spark, d).groupBy("user_id", F.round("value").alias("bucket")).agg(F.count("*").alias("n"))
    # H = log n - sum(c log c) / n, so that one pass over the counts is enough
    g = h.groupBy("user_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    return g.select("user_id", F.round(F.log2("t") - F.col("w") / F.col("t"), 6).alias("entropy"))


@query("WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT round(corr(a.n, b.n), 6) AS r FROM h a JOIN h b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'view'")
def m3_histogram_correlation(spark, d):
    h = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    return h.where("a > 0 and b > 0").agg(F.round(F.corr("a", "b"), 6).alias("r"))


@query("SELECT event_id, bit_count(xor(event_id * 2654435761, user_id * 40503)) AS d FROM events")
def m5_hamming(spark, d):
    return table(spark, d, "events").select("event_id", F.bit_count((F.col("event_id") * 2654435761).bitwiseXOR(F.col("user_id") * 40503)).alias("d"))


@query("WITH c AS (SELECT generate_subscripts(l, 1) AS pos, unnest(l) AS ch, conf FROM (SELECT string_split(text, '') AS l, 1 + doc_id % 3 AS conf FROM documents)), v AS (SELECT pos, ch, sum(conf) AS w FROM c GROUP BY ALL), t AS (SELECT pos, sum(w) AS t FROM v GROUP BY 1) SELECT pos, ch, round(w / t, 6) AS share FROM v JOIN t USING (pos) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY w DESC, ch) = 1")
def tv_whole_texts(spark, d):
    """Confidence-weighted majority of characters at every place of the texts."""
    docs = table(spark, d, "documents").select("text", (1 + F.col("doc_id") % 3).alias("confidence"))
    return sg.place_votes(docs).withColumn("share", F.round("share", 6))


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY ALL")
def m15_recent_window(spark, d):
    e = table(spark, d, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return e.crossJoin(now).where("ts >= now - interval 10 days").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT > 50")
def m16_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k > 50")


@query("WITH f AS (SELECT user_id, event_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events), g AS (SELECT user_id, avg(step) AS m FROM f GROUP BY 1) SELECT user_id, round(1 - least(1, greatest(0, m / 30)), 6) AS stability, count(*) FILTER (step > 2.5 * m) AS changes FROM f JOIN g USING (user_id) GROUP BY user_id, m")
def c12_frame_complexity(spark, d):
    w, u = W.partitionBy("user_id").orderBy("ts", "event_id"), W.partitionBy("user_id")
    f = table(spark, d, "events").withColumn("step", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("m", F.avg("step").over(u))
    return f.groupBy("user_id").agg(F.first("m").alias("m"), F.count_if(F.col("step") > 2.5 * F.col("m")).alias("changes")).select("user_id", F.round(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m") / 30)), 6).alias("stability"), "changes")


@query("WITH p AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 3 WHEN p_size > 20 THEN 2 WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1500 THEN 2 ELSE 0 END AS quality, CASE WHEN p_size < 10 THEN 2 ELSE 0 END + CASE WHEN p_retailprice < 1000 THEN 1 ELSE 0 END AS fast FROM part) SELECT p_partkey, quality, fast, CASE WHEN quality >= 3 THEN 'Quality' WHEN fast >= 3 OR (fast >= 2 AND quality = 0) THEN 'Fast' ELSE 'Balanced' END AS route FROM p")
def c7_routing_score(spark, d):
    s, r = F.col("p_size"), F.col("p_retailprice")
    quality = F.when(s > 40, 3).when(s > 20, 2).when(s > 10, 1).otherwise(0) + F.when(r > 1500, 2).otherwise(0)
    fast = F.when(s < 10, 2).otherwise(0) + F.when(r < 1000, 1).otherwise(0)
    p = table(spark, d, "part").select("p_partkey", quality.alias("quality"), fast.alias("fast"))
    return p.withColumn("route", F.when(F.col("quality") >= 3, "Quality").when((F.col("fast") >= 3) | ((F.col("fast") >= 2) & (F.col("quality") == 0)), "Fast").otherwise("Balanced"))


@query("SELECT p_partkey, CASE WHEN p_size < 13 THEN 'low' WHEN p_size < 26 THEN 'hd' WHEN p_size < 38 THEN 'fullhd' ELSE '4k' END AS resolution, CASE WHEN p_retailprice < 1000 THEN 'blurry' WHEN p_retailprice < 1400 THEN 'soft' ELSE 'sharp' END AS sharpness FROM part WHERE p_retailprice >= 950")
def pf6_c11_named_filters(spark, d):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").where(r >= 950).select("p_partkey", F.when(s < 13, "low").when(s < 26, "hd").when(s < 38, "fullhd").otherwise("4k").alias("resolution"), F.when(r < 1000, "blurry").when(r < 1400, "soft").otherwise("sharp").alias("sharpness"))
