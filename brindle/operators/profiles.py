"""Profiles of images and their signals: type by six scores, escalation with its reasons, merged signals with provenance, resolved conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
IMAGE_TYPES = ["Screenshot", "ScannedDocument", "Photo", "Diagram", "Chart", "Icon"]
LIGHT, DARK = ["White", "Ivory", "Beige"], ["Black", "Dark Gray"]
LEAST_SCORE, UNKNOWN_CONFIDENCE, HEAD_START = 0.3, 0.5, 0.3
RULES = ["priority", "newer", "average", "consensus", "highest"]


def image_scores() -> list[Column]:
    """Scores of IMAGE_TYPES from edges, entropy, straight, text, saturation, gray, colours (name, percent; the most first), width, height."""
    c = F.col
    when = lambda on, n: F.when(on, n).otherwise(0.0)
    n, first = F.size("colours"), F.coalesce(F.get("colours", F.lit(0))["percent"], F.lit(0.0))
    has = lambda names: F.exists("colours", lambda x: x["name"].isin(names))
    pale = c("gray") | (c("saturation") < 0.15)
    return [
        c("straight") * 0.4 + c("text") * 0.3 + when((n >= 2) & (first > 40), 0.2) - when(c("gray"), 0.1),
        c("text") * 0.5 + when(pale, 0.3) + when(has(LIGHT) & has(DARK), 0.2),
        when(~c("gray") & (c("saturation") > 0.15), 0.3) + when((c("entropy") > 5) & (c("entropy") < 7.5), 0.2) + when((c("edges") > 0.1) & (c("edges") < 0.5), 0.2) + when(c("straight") < 0.4, 0.15) + when(c("text") < 0.3, 0.15),
        c("straight") * 0.3 + when((n <= 6) & (first > 50), 0.25) + when(c("gray") | (c("saturation") < 0.2), 0.15) + when((c("text") > 0.2) & (c("text") < 0.6), 0.15) + when(c("edges") > 0.2, 0.15),
        when(~c("gray") & n.between(3, 8), 0.3) + c("straight") * 0.2 + when((c("text") > 0.1) & (c("text") < 0.4), 0.2) + when(first > 30, 0.15),
        F.when((c("width") <= 256) & (c("height") <= 256), 0.4).when((c("width") <= 512) & (c("height") <= 512), 0.2).otherwise(0.0) + when(n <= 6, 0.2) + when(c("edges") > 0.3, 0.2),
    ]


def image_types(profiles: DataFrame, image: str = "image") -> DataFrame:
    """(image, type, confidence, scores): the highest score (ties: the first type); its lead over the second and .3 is the confidence, 1 at most. Below .3 the type is unknown (.5)."""
    rows = profiles.select(F.col(image).alias("image"), F.array(*[F.round(s, 9) for s in image_scores()]).alias("scores"))
    top = F.array_max("scores")
    second = F.element_at(F.sort_array("scores", False), 2)
    kind = F.element_at(F.array(*map(F.lit, IMAGE_TYPES)), F.array_position("scores", top).cast("int"))
    known = top >= LEAST_SCORE
    return rows.select(F.col("image").alias(image), F.when(known, kind).otherwise("Unknown").alias("type"), F.when(known, F.least(F.lit(1.0), top - second + HEAD_START)).otherwise(UNKNOWN_CONFIDENCE).alias("confidence"), "scores")


def escalation(confidence: Column, sharpness: Column, text: Column, kind: Column, least_confidence: float = 0.7, blurred: float = 300.0, much_text: float = 0.4) -> Column:
    """Why an image goes to the larger model, null if it does not: low confidence of its type, blur, much text, diagrams and charts."""
    reasons = F.array_compact(F.array(
        F.when(confidence < least_confidence, F.concat(F.lit("Low type confidence ("), F.round(confidence * 100).cast("long").cast("string"), F.lit("%)"))),
        F.when(sharpness < blurred, F.concat(F.lit("Blurry image (sharpness: "), F.round(sharpness).cast("long").cast("string"), F.lit(")"))),
        F.when(text >= much_text, F.concat(F.lit("High text content (score: "), F.format_string("%.2f", F.round(text, 2)), F.lit(")"))),
        F.when(kind.isin("Diagram", "Chart"), F.concat(F.lit("Complex "), F.lower(kind))),
    ))
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ", "))


def merged(signals: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, confidence, merged_from, original_count): the value of the most confident signal (ties: the first by order), the mean confidence, and the sources in their order.

    signals has value, confidence, source and order.
    """
    best = F.max_by("value", F.struct("confidence", -F.col("order")))
    return signals.groupBy(*by).agg(best.alias("value"), F.avg("confidence").alias("confidence"), F.transform(F.array_sort(F.collect_list(F.struct("order", "source"))), lambda x: x["source"]).alias("merged_from"), F.count("*").alias("original_count"))


def resolved(signals: DataFrame, by: list[str], rule: str) -> DataFrame:
    """(by, value, confidence, source) of conflicting signals (value double, confidence, source, priority, ts, order) by a rule of RULES.

    priority (missing counts zero), newer and highest take the first signal of the greatest
    priority, time or confidence. average and consensus (the most frequent value, ties: the
    first) merge all: the mean confidence, from the resolver.
    """
    if rule not in RULES:
        raise ValueError(f"rule has to be one of {RULES}")
    if rule in ("average", "consensus"):
        whole = signals.groupBy(*by).agg(F.avg("value").alias("mean"), F.avg("confidence").alias("confidence"))
        if rule == "average":
            return whole.select(*by, F.col("mean").alias("value"), "confidence", F.lit("ConflictResolver").alias("source"))
        votes = signals.groupBy(*by, "value").agg(F.count("*").alias("n"), F.min("order").alias("first"))
        chosen = votes.groupBy(*by).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
        return whole.join(chosen, by).select(*by, "value", "confidence", F.lit("ConflictResolver").alias("source"))
    key = {"priority": F.coalesce("priority", F.lit(0)), "newer": F.col("ts"), "highest": F.col("confidence")}[rule]
    best = signals.groupBy(*by).agg(F.max_by(F.struct("value", "confidence", "source"), F.struct(key, -F.col("order"))).alias("b"))
    return best.select(*by, "b.value", "b.confidence", "b.source")
