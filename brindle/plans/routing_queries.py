"""Routes and discriminators over profiles of images made from the table of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as rt
from .registry import query, table

_PROFILE = """p_partkey AS image, CASE WHEN p_partkey % 4 <> 0 THEN 'h' || (p_partkey % 50) END AS hash, p_partkey % 3 = 0 AS animated, p_partkey % 9 AS frames, p_partkey * 7919 % 3000000 AS pixels, (p_partkey % 11) / 11e0 AS text_likeliness, (p_partkey % 7) / 30e0 AS edge_density,
 CASE p_size % 7 WHEN 0 THEN 'Photo' WHEN 1 THEN 'Chart' WHEN 2 THEN 'Icon' WHEN 3 THEN 'ScannedDocument' ELSE 'Photo' END AS content_type, (p_partkey % 17) / 40e0 AS text_coverage, p_partkey % 15 AS text_regions, p_partkey % 5 = 0 AS subtitles, CASE p_partkey % 3 WHEN 0 THEN 'caption' WHEN 1 THEN 'moderate' ELSE 'substantial' END AS text_tier"""
_LISTS = lambda key: "[" + ", ".join(f"'{w}'" for w in rt.SKIP[key]) + "]"


@query(
    f"""WITH im AS (SELECT {_PROFILE} FROM part), re AS (SELECT 'h' || (o_orderkey % 60) AS hash, ['fast', 'balanced', 'quality'][o_orderkey % 3 + 1] AS route, o_orderdate AS stored, o_orderkey % 7 = 0 AS kept FROM orders), nw AS (SELECT max(stored) AS now FROM re),
 us AS (SELECT *, CASE WHEN NOT kept AND stored > now - INTERVAL 240 HOUR THEN 0 WHEN kept THEN 1 END AS r FROM re, nw), be AS (SELECT * FROM us WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY r, stored DESC, route) = 1),
 po AS (SELECT *, CASE WHEN text_coverage > 0.4 THEN 3 WHEN text_coverage > 0.2 THEN 2 WHEN text_coverage > 0.1 THEN 1 ELSE 0 END + (text_regions > 10)::INT * 2 + (animated AND frames > 3 AND NOT (subtitles AND text_coverage < 0.15))::INT * 2 + (text_likeliness > 0.5 AND text_coverage < 0.05)::INT + (content_type IN ('Diagram', 'Chart', 'ScannedDocument', 'Screenshot'))::INT * 2 + (edge_density > 0.15 AND text_regions > 5)::INT + (pixels > 2000000 AND text_coverage > 0.05)::INT AS quality,
   (text_coverage < 0.1 AND text_regions <= 3)::INT * 2 + (NOT animated AND frames <= 1 AND text_coverage < 0.15)::INT + (text_regions = 0 AND text_likeliness < 0.1)::INT * 2 + (subtitles AND text_coverage < 0.15 AND NOT contains(content_type, 'Document'))::INT + (pixels < 100000)::INT AS fast FROM im),
 ro AS (SELECT po.*, coalesce(be.route, CASE WHEN quality >= 3 THEN 'quality' WHEN fast >= 3 OR (fast >= 2 AND quality = 0) THEN 'fast' ELSE 'balanced' END) AS route, CASE WHEN be.r = 0 THEN 'cache' WHEN be.r = 1 THEN 'profile' ELSE 'points' END AS "from" FROM po LEFT JOIN be ON po.hash = be.hash)
 SELECT image, route, quality, fast, "from", CASE route WHEN 'fast' THEN CASE WHEN animated THEN {_LISTS(('animated', 'fast'))} WHEN text_tier = 'caption' THEN {_LISTS(('caption', 'fast'))} ELSE {_LISTS(('static', 'fast'))} END WHEN 'balanced' THEN CASE WHEN animated THEN {_LISTS(('animated', 'balanced'))} WHEN text_tier IN ('caption', 'moderate') THEN {_LISTS(('light', 'balanced'))} ELSE {_LISTS(('static', 'balanced'))} END ELSE [] END AS skip FROM ro"""
)
def p7_auto_routing(spark, d):
    """Route of each part's image by its points or by a remembered route, and the waves it skips."""
    orders = table(spark, d, "orders")
    ways = F.array(F.lit("fast"), F.lit("balanced"), F.lit("quality"))
    remembered = orders.select(F.concat(F.lit("h"), (F.col("o_orderkey") % 60).cast("string")).alias("hash"), F.element_at(ways, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("route"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 7 == 0).alias("kept"))
    now = orders.agg(F.max("o_orderdate")).first()[0]
    return rt.routed(table(spark, d, "part").selectExpr(*_split(_PROFILE)), remembered, F.lit(now), 240)


def _split(columns: str) -> list[str]:
    """The select list's items; commas inside brackets do not part them."""
    out, depth, item = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


_SEEN = """p_partkey AS image, (p_partkey % 11) / 10e0 AS likely, CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN p_name ELSE p_name || ' it''s 42 ' || p_type END AS text, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'A Moving Label in red' WHEN 2 THEN 'black word' ELSE p_type END AS caption, CASE WHEN p_partkey % 3 = 0 THEN (p_size % 10) / 10e0 END AS confidence, (p_size % 30) * 1e0 AS magnitude, (p_size * 7 % 100) * 1e0 AS percent, CASE p_size % 2 WHEN 0 THEN 'left' ELSE 'steel' END AS direction,
 (p_size % 21) / 20e0 AS saturation, p_partkey % 6 = 0 AS gray, (p_partkey % 13) / 100e0 AS edges, (p_partkey * 13 % 1500) * 1e0 AS sharpness, (p_size % 40) / 10e0 AS aspect, (p_partkey % 9) * 1e0 AS entropy, p_partkey % 7 AS colours"""
_CAP = lambda words: " OR ".join(f"contains(lower(caption), {w})" for w in words)
_PARTS = lambda parts: f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
_TOLD = "trim(coalesce(text, '')) <> ''"


@query(
    rf"""WITH se AS (SELECT {_SEEN} FROM part), pt AS (SELECT *, {_PARTS(['likely', f"CASE WHEN {_TOLD} THEN least(1.0, length(text) / 500) END", rf"CASE WHEN {_TOLD} THEN len(list_filter(regexp_split_to_array(text, '[ ]+'), lambda w: regexp_matches(w, '^[\p{{L}}\p{{Nd}}]{{2,}}$'))) / greatest(1, len(list_filter(regexp_split_to_array(text, '[ ]+'), lambda w: w <> ''))) END", f"CASE WHEN {_TOLD} AND caption IS NOT NULL THEN CASE WHEN " + _CAP(["'text'", "'word'", "'caption'", "'label'"]) + " THEN 0.8 ELSE 0.3 END END"])} AS o,
   {_PARTS(["confidence", "CASE WHEN magnitude > 1 THEN least(1.0, magnitude / 20) ELSE 0.2 END", "percent / 100", "CASE WHEN caption IS NOT NULL THEN CASE WHEN " + _CAP(["'animat'", "'moving'", "'motion'", "direction"]) + " THEN 0.9 ELSE 0.4 END END"])} AS m,
   {_PARTS(["CASE WHEN colours > 0 THEN least(colours, 3) * 12 / 100 END", "CASE WHEN gray THEN 1.0 ELSE greatest(0.0, 1 - abs(saturation - 0.5) * 2) END", "CASE WHEN gray THEN 0.95 END", "CASE WHEN colours > 0 AND caption IS NOT NULL THEN CASE WHEN " + _CAP(["'red'", "'color'"]) + " OR (gray AND (" + _CAP(["'gray'", "'black'", "'white'"]) + ")) THEN 0.85 ELSE 0.4 END END"])} AS p,
   {_PARTS(["least(1.0, edges * 10)", "CASE WHEN sharpness < 100 THEN 0.2 WHEN sharpness < 500 THEN 0.6 ELSE least(1.0, sharpness / 1000) END", "CASE WHEN aspect > 0.3 AND aspect < 3 THEN 1.0 ELSE 0.5 END", "least(1.0, entropy / 8)"])} AS s FROM se)
 SELECT image, round(CASE WHEN likely < 0.2 THEN 0 ELSE list_sum(o) / len(o) END, 6) AS ocr_fidelity, round(CASE WHEN confidence IS NULL THEN 0 ELSE list_sum(m) / len(m) END, 6) AS motion_agreement, round(list_sum(p) / len(p), 6) AS palette_consistency, round(list_sum(s) / len(s), 6) AS structural_alignment FROM pt"""
)
def m8_discriminators(spark, d):
    """How well text, motion, palette and structure of each part's image agree with what was said of it."""
    colours = F.transform(F.filter(F.sequence(F.lit(0), F.col("colours")), lambda k: k > 0), lambda k: F.struct(F.when(k == 1, "Red").otherwise("x").alias("name"), F.lit(12.0).alias("percent")))
    seen = table(spark, d, "part").selectExpr(*_split(_SEEN)).withColumn("colours", colours)
    c = F.col
    scores = {
        "ocr_fidelity": rt.ocr_fidelity(c("likely"), c("text"), c("caption")), "motion_agreement": rt.motion_agreement(c("confidence"), c("magnitude"), c("percent"), c("direction"), c("caption")),
        "palette_consistency": rt.palette_consistency(c("colours"), c("saturation"), c("gray"), c("caption")), "structural_alignment": rt.structural_alignment(c("edges"), c("sharpness"), c("aspect"), c("entropy")),
    }
    return seen.select("image", *[F.round(v, 6).alias(k) for k, v in scores.items()])


@query(
    """WITH cl AS (SELECT l_orderkey AS image, CASE l_linenumber % 4 WHEN 0 THEN ['L' || l_suppkey] WHEN 1 THEN ['V1', 'L2'] WHEN 2 THEN [l_returnflag, l_linestatus] ELSE [] END AS s, l_quantity > 20 AS proved FROM lineitem),
 n AS (SELECT image, count(*) AS claims, count(*) FILTER (len(list_filter(s, lambda x: NOT starts_with(upper(x), 'L'))) > 0) AS grounded, count(*) FILTER (proved) AS proved, count(*) FILTER (len(list_filter(s, lambda x: NOT starts_with(upper(x), 'L'))) = 0) AS alone FROM cl GROUP BY 1), k AS (SELECT image, count(DISTINCT x[1]) AS kinds FROM (SELECT image, unnest(s) AS x FROM cl) GROUP BY 1)
 SELECT image, claims, round((least(1.0, coalesce(kinds, 0) / 4) + grounded / claims + proved / claims + 1 - alone / claims) / 4, 6) AS grounding FROM n LEFT JOIN k USING (image)"""
)
def m8_grounding(spark, d):
    """How well each order's claims are grounded."""
    k = F.col("l_linenumber") % 4
    sources = F.when(k == 0, F.array(F.concat(F.lit("L"), F.col("l_suppkey").cast("string")))).when(k == 1, F.array(F.lit("V1"), F.lit("L2"))).when(k == 2, F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>"))
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), sources.alias("sources"), F.when(F.col("l_quantity") > 20, F.array(F.lit("seen"))).alias("evidence"))
    return rt.grounding(claims).withColumn("grounding", F.round("grounding", 6))


@query(
    """WITH r AS (SELECT user_id AS image, event_id AS t, event_type AS model, 'user ' || event_id AS caption, value / 500 AS score, CASE WHEN event_id % 3 = 0 THEN value / 500 END AS confidence FROM events),
 w AS (SELECT *, count(*) OVER p AS n, avg(length(model)) OVER p AS ml, avg(score) OVER p AS ms FROM r WINDOW p AS (PARTITION BY image ORDER BY t, caption ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT image, t AS "at", round(CASE WHEN n = 0 THEN 1 ELSE (least(1.0, abs(length(caption) - ml) / greatest(ml, 1.0)) + abs(coalesce(confidence, 0 - ms))) / 2 END, 6) AS novelty FROM w"""
)
def m8_novelty(spark, d):
    """How new each user's event is against the last five before it."""
    e = table(spark, d, "events")
    results = e.select(F.col("user_id").alias("image"), F.col("event_id").alias("at"), F.col("event_type").alias("model"), F.concat(F.lit("user "), F.col("event_id").cast("string")).alias("caption"), (F.col("value") / 500).alias("score"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 500).alias("confidence"))
    return rt.novelty(results).withColumn("novelty", F.round("novelty", 6))
