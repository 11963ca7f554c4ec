"""Image types, escalations and signals with provenance over the tables of parts and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import profiles as pr
from .registry import query, table
from .routing_queries import _split

_IMAGE = """p_partkey AS image, (p_partkey % 23) / 40e0 AS edges, (p_partkey % 17) / 2e0 AS entropy, (p_size % 11) / 10e0 AS straight, (p_partkey % 13) / 12e0 AS text, (p_size % 9) / 10e0 AS saturation, p_partkey % 5 = 0 AS gray, p_partkey % 12 AS n, (p_size * 13 % 70) * 1e0 AS p, p_partkey * 37 % 900 AS width, p_size * 41 % 700 AS height, (p_partkey * 7 % 900) * 1e0 AS sharpness"""
_NAMES = ["White", "Black", "Red", "Beige", "Dark Gray", "Blue"]
_COLOURS = "list_transform(range(0, n), lambda k: ['White', 'Black', 'Red', 'Beige', 'Dark Gray', 'Blue'][(k + image) % 6 + 1])"
_FIRST = "CASE WHEN n > 0 THEN p ELSE 0 END"


def _images(spark, d):
    names = F.array(*map(F.lit, _NAMES))
    places = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda k: k < F.col("n"))
    colours = F.transform(places, lambda k: F.struct(F.element_at(names, ((k + F.col("image")) % 6 + 1).cast("int")).alias("name"), F.when(k == 0, F.col("p")).otherwise(1.0).alias("percent")))
    return table(spark, d, "part").selectExpr(*_split(_IMAGE)).withColumn("colours", colours)


_TYPED = f"""im AS (SELECT {_IMAGE} FROM part), co AS (SELECT *, {_COLOURS} AS cs, {_FIRST} AS f FROM im),
 sc AS (SELECT *, list_transform([straight * 0.4 + text * 0.3 + CASE WHEN n >= 2 AND f > 40 THEN 0.2 ELSE 0 END - CASE WHEN gray THEN 0.1 ELSE 0 END,
  text * 0.5 + CASE WHEN gray OR saturation < 0.15 THEN 0.3 ELSE 0 END + CASE WHEN list_has_any(cs, ['White', 'Ivory', 'Beige']) AND list_has_any(cs, ['Black', 'Dark Gray']) THEN 0.2 ELSE 0 END,
  CASE WHEN NOT gray AND saturation > 0.15 THEN 0.3 ELSE 0 END + CASE WHEN entropy > 5 AND entropy < 7.5 THEN 0.2 ELSE 0 END + CASE WHEN edges > 0.1 AND edges < 0.5 THEN 0.2 ELSE 0 END + CASE WHEN straight < 0.4 THEN 0.15 ELSE 0 END + CASE WHEN text < 0.3 THEN 0.15 ELSE 0 END,
  straight * 0.3 + CASE WHEN n <= 6 AND f > 50 THEN 0.25 ELSE 0 END + CASE WHEN gray OR saturation < 0.2 THEN 0.15 ELSE 0 END + CASE WHEN text > 0.2 AND text < 0.6 THEN 0.15 ELSE 0 END + CASE WHEN edges > 0.2 THEN 0.15 ELSE 0 END,
  CASE WHEN NOT gray AND n BETWEEN 3 AND 8 THEN 0.3 ELSE 0 END + straight * 0.2 + CASE WHEN text > 0.1 AND text < 0.4 THEN 0.2 ELSE 0 END + CASE WHEN f > 30 THEN 0.15 ELSE 0 END,
  CASE WHEN width <= 256 AND height <= 256 THEN 0.4 WHEN width <= 512 AND height <= 512 THEN 0.2 ELSE 0 END + CASE WHEN n <= 6 THEN 0.2 ELSE 0 END + CASE WHEN edges > 0.3 THEN 0.2 ELSE 0 END], lambda x: round(x, 9)) AS scores FROM co),
 ty AS (SELECT *, CASE WHEN list_max(scores) < 0.3 THEN 'Unknown' ELSE ['Screenshot', 'ScannedDocument', 'Photo', 'Diagram', 'Chart', 'Icon'][list_position(scores, list_max(scores))] END AS type, CASE WHEN list_max(scores) < 0.3 THEN 0.5 ELSE least(1.0, list_max(scores) - list_reverse_sort(scores)[2] + 0.3) END AS confidence FROM sc)"""


@query(f"WITH {_TYPED} SELECT image, type, round(confidence, 6) AS confidence FROM ty")
def c6_image_types(spark, d):
    """Type of each part's image by six scores."""
    return pr.image_types(_images(spark, d)).select("image", "type", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH {_TYPED}, re AS (SELECT image, array_to_string(list_filter([CASE WHEN round(confidence, 6) < 0.7 THEN 'Low type confidence (' || round(round(confidence, 6) * 100)::BIGINT::VARCHAR || '%)' END, CASE WHEN sharpness < 300 THEN 'Blurry image (sharpness: ' || round(sharpness)::BIGINT::VARCHAR || ')' END, CASE WHEN text >= 0.4 THEN 'High text content (score: ' || printf('%.2f', round(text, 2)) || ')' END, CASE WHEN type IN ('Diagram', 'Chart') THEN 'Complex ' || lower(type) END], lambda x: x IS NOT NULL), ', ') AS reason FROM ty)
 SELECT image, reason FROM re WHERE reason <> ''"""
)
def pf14_escalation_reasons(spark, d):
    """Which images go to the larger model, and why."""
    images = _images(spark, d)
    typed = pr.image_types(images).select(F.col("image").alias("_image"), "type", F.round("confidence", 6).alias("confidence"))
    rows = images.join(typed, F.col("image") == F.col("_image"))
    return rows.select("image", pr.escalation(F.col("confidence"), F.col("sharpness"), F.col("text"), F.col("type")).alias("reason")).where("reason is not null")


_SIGNALS = "sg AS (SELECT user_id, event_type, floor(value / 25) AS value, (event_id * 7 % 100) / 100 AS confidence, 's' || (event_id % 4) AS source, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 END AS priority, ts, event_id AS o FROM events)"


def _signals(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") / 25).cast("double").alias("value"), (i * 7 % 100 / 100).alias("confidence"), F.concat(F.lit("s"), (i % 4).cast("string")).alias("source"), F.when(i % 3 != 0, i % 5).alias("priority"), "ts", i.alias("order"))


@query(f"WITH {_SIGNALS} SELECT user_id, event_type, arg_max(value, (confidence, -o)) AS value, round(avg(confidence), 6) AS confidence, list(source ORDER BY o) AS merged_from, count(*) AS original_count FROM sg GROUP BY 1, 2")
def a10_merged_with_provenance(spark, d):
    """Signals of a user and kind as one, with where they came from."""
    return pr.merged(_signals(spark, d), ["user_id", "event_type"]).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {_SIGNALS}, vo AS (SELECT user_id, event_type, value, count(*) AS n, min(o) AS f FROM sg GROUP BY ALL), wh AS (SELECT user_id, event_type, avg(value) AS mean, avg(confidence) AS c FROM sg GROUP BY ALL)
 SELECT 'priority' AS rule, user_id, event_type, arg_max(value, (coalesce(priority, 0), -o)) AS value, round(arg_max(confidence, (coalesce(priority, 0), -o)), 6) AS confidence, arg_max(source, (coalesce(priority, 0), -o)) AS source FROM sg GROUP BY ALL
 UNION ALL SELECT 'newer', user_id, event_type, arg_max(value, (ts, -o)), round(arg_max(confidence, (ts, -o)), 6), arg_max(source, (ts, -o)) FROM sg GROUP BY ALL
 UNION ALL SELECT 'highest', user_id, event_type, arg_max(value, (confidence, -o)), round(arg_max(confidence, (confidence, -o)), 6), arg_max(source, (confidence, -o)) FROM sg GROUP BY ALL
 UNION ALL SELECT 'average', user_id, event_type, round(mean, 6), round(c, 6), 'ConflictResolver' FROM wh
 UNION ALL SELECT 'consensus', user_id, event_type, (SELECT arg_max(value, (n, -f)) FROM vo WHERE vo.user_id = wh.user_id AND vo.event_type = wh.event_type), round(c, 6), 'ConflictResolver' FROM wh"""
)
def a10_resolved_conflicts(spark, d):
    """Conflicting signals of a user and kind by each of the five rules."""
    signals = _signals(spark, d)
    parts = [pr.resolved(signals, ["user_id", "event_type"], rule).select(F.lit(rule).alias("rule"), "user_id", "event_type", F.round("value", 6).alias("value"), F.round("confidence", 6).alias("confidence"), "source") for rule in pr.RULES]
    return reduce(lambda a, b: a.unionByName(b), parts)
