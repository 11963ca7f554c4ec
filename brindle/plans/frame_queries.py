"""Frames, regions and page layouts made from the tables of orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as fr
from .registry import query, table

_FLOW = "fl AS (SELECT user_id AS image, value / 20 AS magnitude, value / 10 AS max_magnitude, (event_id % 100) / 100 AS activity, CAST((event_id * 37 + user_id * 11) % 360 AS DOUBLE) AS angle, CAST((event_id * 37 + user_id * 11) % 360 // 45 AS INT) AS direction FROM events WHERE event_id % 7 <> user_id % 7)"


@query(
    f"""WITH {_FLOW}, me AS (SELECT image, count(*) AS frames, avg(magnitude) AS average_magnitude, max(max_magnitude) AS max_magnitude, avg(activity) AS motion_activity, avg(angle) AS ma FROM fl GROUP BY 1),
 vo AS (SELECT image, direction, count(*) AS n FROM fl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, direction) = 1),
 wr AS (SELECT image, magnitude - average_magnitude AS dm, angle - ma + CASE WHEN angle - ma > 180 THEN -360 WHEN angle - ma < -180 THEN 360 ELSE 0 END AS da FROM fl JOIN me USING (image)), sp AS (SELECT image, avg(da * da) AS t, avg(dm * dm) AS w FROM wr GROUP BY 1),
 al AS (SELECT *, n / frames AS direction_confidence, CASE WHEN frames < 2 THEN 1 ELSE greatest(0, 1 - sqrt(t) / 180) END AS direction_consistency, CASE WHEN frames < 2 OR average_magnitude < 0.01 THEN 1 ELSE greatest(0, 1 - sqrt(w) / average_magnitude) END AS temporal_consistency, average_magnitude > 0.5 OR motion_activity > 0.05 AS has_motion FROM me JOIN sp USING (image) JOIN vo USING (image))
 SELECT image, frames, round(average_magnitude, 6) AS average_magnitude, max_magnitude, round(motion_activity, 6) AS motion_activity, ['right', 'down-right', 'down', 'down-left', 'left', 'up-left', 'up', 'up-right', 'stationary'][direction + 1] AS direction, round(direction_confidence, 6) AS direction_confidence, round(direction_consistency, 6) AS direction_consistency, round(temporal_consistency, 6) AS temporal_consistency, has_motion,
  CASE WHEN NOT has_motion THEN 'static' WHEN direction_consistency < 0.3 THEN 'oscillating' WHEN motion_activity > 0.7 AND direction_consistency < 0.5 THEN 'radial' WHEN direction_consistency < 0.5 AND motion_activity > 0.3 THEN 'rotating' WHEN direction_consistency > 0.7 AND motion_activity > 0.5 THEN 'panning' WHEN motion_activity < 0.3 AND average_magnitude > 2 THEN 'object_motion' ELSE 'general' END AS motion_type FROM al"""
)
def m18_c13_motion(spark, d):
    """Each user's events as frames: directions, consistency, type of motion."""
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    angle = (i * 37 + u * 11) % 360
    flows = table(spark, d, "events").where(i % 7 != u % 7).select(u.alias("image"), (v / 20).alias("magnitude"), (v / 10).alias("max_magnitude"), (i % 100 / 100).alias("activity"), angle.cast("double").alias("angle"), F.floor(angle / 45).cast("int").alias("direction"))
    out = fr.motion(flows)
    return out.withColumns({c: F.round(c, 6) for c in ("average_magnitude", "motion_activity", "direction_confidence", "direction_consistency", "temporal_consistency")})


@query(
    """WITH f AS (SELECT l_suppkey AS image, l_orderkey * 10 + l_linenumber AS frame, max(l_discount * CASE WHEN l_quantity > 45 THEN 9 ELSE l_suppkey % 4 END) AS difference, max(l_quantity / 8) AS entropy, max(l_partkey % 256) AS r, max(l_orderkey % 256) AS g, max(l_linenumber * 30) AS b FROM lineitem GROUP BY 1, 2),
 c AS (SELECT *, sqrt((r - lag(r) OVER w) ** 2 + (g - lag(g) OVER w) ** 2 + (b - lag(b) OVER w) ** 2) / 441.67 AS colour FROM f WINDOW w AS (PARTITION BY image ORDER BY frame)),
 m AS (SELECT image, count(*) AS frames, avg(difference) AS diff, avg(colour) AS colour, stddev_pop(entropy) AS entropy FROM c GROUP BY 1), k AS (SELECT image, count(*) FILTER (round(difference, 9) > round(diff * 2.5, 9)) AS cuts FROM c JOIN m USING (image) GROUP BY 1),
 v AS (SELECT image, frames, diff, CASE WHEN frames <= 1 THEN 1 ELSE 1 - least(1, greatest(0, diff / 0.3)) END AS visual_stability, CASE WHEN frames <= 1 THEN 0 ELSE m.colour END AS color_variation, CASE WHEN frames <= 1 THEN 0 ELSE least(1, greatest(0, m.entropy / 2)) END AS entropy_variation, CASE WHEN frames <= 1 THEN 0 ELSE cuts END AS scene_changes FROM m JOIN k USING (image))
 SELECT image, frames, round(visual_stability, 6) AS visual_stability, round(color_variation, 6) AS color_variation, round(entropy_variation, 6) AS entropy_variation, scene_changes, CASE WHEN frames <= 1 THEN 'static' WHEN scene_changes > frames * 0.3 THEN 'slideshow' WHEN round(diff, 9) < 0.05 THEN 'simple-loop' WHEN round(diff, 9) < 0.15 THEN 'smooth-animation' ELSE 'complex-animation' END AS animation_type,
  round(least(1, greatest(0, 0.4 * (1 - visual_stability) + 0.3 * color_variation + 0.2 * entropy_variation + 0.1 * least(1, scene_changes / frames))), 6) AS complexity FROM v"""
)
def c12_animation_complexity(spark, d):
    """Each supplier's lines as frames: stability, variation, scene changes, type and complexity."""
    line = table(spark, d, "lineitem")
    difference = F.col("l_discount") * F.when(F.col("l_quantity") > 45, 9).otherwise(F.col("l_suppkey") % 4)
    frames = line.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame")).agg(
        F.max(difference).alias("difference"), F.max(F.col("l_quantity") / 8).alias("entropy"), F.max(F.col("l_partkey") % 256).alias("r"), F.max(F.col("l_orderkey") % 256).alias("g"), F.max(F.col("l_linenumber") * 30).alias("b"),
    )
    return fr.complexity(frames).withColumns({c: F.round(c, 6) for c in ("visual_stability", "color_variation", "entropy_variation", "complexity")})


@query()
def c14_merged_regions(spark, d):
    """Each supplier's lines as boxes: those that overlap as they grow are one region, the five strongest first."""
    i = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    boxes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), i.alias("region"), (F.col("l_partkey") * 7 % 4000).alias("x"), (F.col("l_orderkey") * 13 % 3000).alias("y"), (F.col("l_quantity") + 20).alias("width"), (F.col("l_linenumber") * 12 + 10).alias("height"), F.round(F.col("l_extendedprice"), 2).alias("magnitude"))
    return fr.merged_regions(boxes)


_SEGMENTS = "sg AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS segment, CASE WHEN l_returnflag = 'R' THEN 'table' WHEN l_linestatus = 'F' AND l_suppkey % 3 = 0 THEN 'image' WHEN l_suppkey % 7 = 0 THEN 'chart' ELSE 'text' END AS type, l_partkey * 17 % 700 AS x, l_suppkey * 31 % 900 AS y, CAST(l_quantity AS BIGINT) * 4 + 20 AS width, 40 AS height, 800 AS page_width FROM lineitem)"


def _segments(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "table").when((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 3 == 0), "image").when(F.col("l_suppkey") % 7 == 0, "chart").otherwise("text")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")).alias("segment"), kind.alias("type"), (F.col("l_partkey") * 17 % 700).alias("x"), (F.col("l_suppkey") * 31 % 900).alias("y"), (F.col("l_quantity").cast("long") * 4 + 20).alias("width"), F.lit(40).alias("height"), F.lit(800).alias("page_width"))


@query(f"WITH {_SEGMENTS} SELECT page, segment, type, x, y, width, height, page_width, CAST(row_number() OVER (PARTITION BY page ORDER BY y, x, segment, type, width, height) - 1 AS INT) AS z_order FROM sg")
def c16_reading_order(spark, d):
    """Segments of each page from the top left down."""
    return fr.reading_order(_segments(spark, d))


@query(
    f"""WITH {_SEGMENTS}, g AS (SELECT page, count(*) AS segments, count(*) FILTER (type = 'text') AS t, count(*) FILTER (type IN ('image', 'chart')) AS im, count(*) FILTER (type = 'table') AS tb, list([x + width // 2] ORDER BY segment, x + width // 2) FILTER (type = 'text') AS cs FROM sg GROUP BY 1),
 c AS (SELECT *, CAST(CASE WHEN cs IS NULL THEN 1 ELSE len(list_reduce(cs, lambda a, v: CASE WHEN len(list_filter(a, lambda o: abs(o - v[1]) < 320)) > 0 THEN a ELSE list_concat(a, v) END)) END AS INT) AS columns FROM g)
 SELECT page, segments, columns, CASE WHEN tb > segments * 0.5 THEN 'table-based' WHEN im > t * 2 THEN 'image-heavy' WHEN columns > 1 THEN 'multi-column' WHEN im > 0 OR tb > 0 THEN 'mixed' ELSE 'single-column' END AS layout FROM c"""
)
def c16_layout(spark, d):
    """Columns and layout of each page."""
    return fr.layout(_segments(spark, d))
