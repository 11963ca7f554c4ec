"""Routes of images through the analysis, with waves to skip and remembered routes; and discriminators of how well an analysis is grounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
COMPLEX = ["Diagram", "Chart", "ScannedDocument", "Screenshot"]
SKIP = {
    ("animated", "fast"): ["OcrWave", "AdvancedOcrWave", "OcrVerificationWave", "ClipEmbeddingWave", "FaceDetectionWave"],
    ("animated", "balanced"): ["AdvancedOcrWave", "OcrVerificationWave", "ClipEmbeddingWave"],
    ("caption", "fast"): ["OcrWave", "AdvancedOcrWave", "OcrVerificationWave", "TextDetectionWave", "ClipEmbeddingWave", "FaceDetectionWave"],
    ("static", "fast"): ["AdvancedOcrWave", "OcrVerificationWave", "ClipEmbeddingWave", "FaceDetectionWave"],
    ("light", "balanced"): ["AdvancedOcrWave", "OcrVerificationWave", "ClipEmbeddingWave"],
    ("static", "balanced"): ["ClipEmbeddingWave"],
}
REMEMBERED_HOURS = 24


def _points(rules: list[tuple[Column, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(on, n).otherwise(0) for on, n in rules])


def route_points() -> tuple[Column, Column]:
    """(quality, fast) points of a profile: animated, frames, pixels, text_likeliness, edge_density, content_type, text_coverage, text_regions, subtitles."""
    cover, regions, likely = F.col("text_coverage"), F.col("text_regions"), F.col("text_likeliness")
    by_cover = F.when(cover > 0.4, 3).when(cover > 0.2, 2).when(cover > 0.1, 1).otherwise(0)
    told = F.col("subtitles") & (cover < 0.15)
    quality = by_cover + _points([
        (regions > 10, 2), (F.col("animated") & (F.col("frames") > 3) & ~told, 2), ((likely > 0.5) & (cover < 0.05), 1), (F.col("content_type").isin(COMPLEX), 2),
        ((F.col("edge_density") > 0.15) & (regions > 5), 1), ((F.col("pixels") > 2_000_000) & (cover > 0.05), 1),
    ])
    fast = _points([
        ((cover < 0.1) & (regions <= 3), 2), (~F.col("animated") & (F.col("frames") <= 1) & (cover < 0.15), 1), ((regions == 0) & (likely < 0.1), 2),
        (told & ~F.contains("content_type", F.lit("Document")), 1), (F.col("pixels") < 100_000, 1),
    ])
    return quality, fast


def route(quality: Column, fast: Column) -> Column:
    """quality from three points; else fast from three, or from two without any for quality; else balanced."""
    return F.when(quality >= 3, "quality").when((fast >= 3) | ((fast >= 2) & (quality == 0)), "fast").otherwise("balanced")


def skipped(way: Column, tier: Column, animated: Column) -> Column:
    """The waves that a route leaves out; quality runs all."""
    waves = lambda key: F.array(*map(F.lit, SKIP[key]))
    fast = F.when(animated, waves(("animated", "fast"))).when(tier == "caption", waves(("caption", "fast"))).otherwise(waves(("static", "fast")))
    balanced = F.when(animated, waves(("animated", "balanced"))).when(tier.isin("caption", "moderate"), waves(("light", "balanced"))).otherwise(waves(("static", "balanced")))
    return F.when(way == "fast", fast).when(way == "balanced", balanced).otherwise(F.array().cast("array<string>"))


def routed(profiles: DataFrame, remembered: DataFrame | None = None, now: Column | None = None, hours: int = REMEMBERED_HOURS) -> DataFrame:
    """(image, route, quality, fast, from, skip) of profiles (image, hash, text_tier and those of route_points).

    remembered is (hash, route, at, kept): a route of the last hours goes before one that was
    stored with a profile (kept), whatever its age, and that before the points; of several the
    newest counts (ties: by name). A null hash is not looked up.
    """
    quality, fast = route_points()
    rows = profiles.withColumns({"quality": quality, "fast": fast}).withColumn("_route", route(F.col("quality"), F.col("fast")))
    if remembered is None:
        rows = rows.withColumns({"_old": F.lit(None).cast("string"), "_kind": F.lit(None).cast("string")})
    else:
        now = F.current_timestamp() if now is None else now
        recent = F.col("at") > now - F.expr(f"INTERVAL {hours} HOURS")
        usable = remembered.where("hash is not null").withColumn("_rank", F.when(~F.col("kept") & recent, 0).when(F.col("kept"), 1)).where("_rank is not null")
        best = usable.groupBy("hash").agg(F.min_by(F.struct("route", "_rank"), F.struct("_rank", -F.unix_micros(F.col("at").cast("timestamp")), "route")).alias("b"))
        known = best.select(F.col("hash").alias("_hash"), F.col("b.route").alias("_old"), F.when(F.col("b._rank") == 0, "cache").otherwise("profile").alias("_kind"))
        rows = rows.join(known, F.col("hash") == F.col("_hash"), "left").drop("_hash")
    way = F.coalesce("_old", "_route")
    return rows.select("image", way.alias("route"), "quality", "fast", F.coalesce("_kind", F.lit("points")).alias("from"), skipped(way, F.col("text_tier"), F.col("animated")).alias("skip"))


def _mean(parts: list[Column]) -> Column:
    """Mean of the parts that are not null; zero without any."""
    own = F.array_compact(F.array(*parts))
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)).otherwise(0.0)


def _mentions(caption: Column, words: list) -> Column:
    low = F.lower(caption)
    return reduce(lambda a, b: a | b, [F.contains(low, w if isinstance(w, Column) else F.lit(w)) for w in words])


def ocr_fidelity(likely: Column, text: Column, caption: Column) -> Column:
    """Of images with text: its likeliness, length (500 is full), share of plain words, and whether the caption speaks of text."""
    told = F.trim(F.coalesce(text, F.lit(""))) != ""
    words = F.filter(F.split(text, "[ \n\r\t]+"), lambda w: w != "")
    plain = F.size(F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{Nd}]{2,}$"))) / F.greatest(F.lit(1), F.size(words))
    parts = [likely, F.when(told, F.least(F.lit(1.0), F.length(text) / 500)), F.when(told, plain), F.when(told & caption.isNotNull(), F.when(_mentions(caption, ["text", "word", "caption", "label"]), 0.8).otherwise(0.3))]
    return F.when(likely < 0.2, 0.0).otherwise(_mean(parts))


def motion_agreement(confidence: Column, magnitude: Column, percent: Column, direction: Column, caption: Column) -> Column:
    """Of animations (confidence not null): confidence, magnitude (20 is full, up to 1 counts .2), share of moving frames, and whether the caption speaks of motion."""
    parts = [confidence, F.when(magnitude > 1, F.least(F.lit(1.0), magnitude / 20)).otherwise(0.2), percent / 100, F.when(caption.isNotNull(), F.when(_mentions(caption, ["animat", "moving", "motion", direction]), 0.9).otherwise(0.4))]
    return F.when(confidence.isNull(), 0.0).otherwise(_mean(parts))


def palette_consistency(colours: Column, saturation: Column, gray: Column, caption: Column) -> Column:
    """colours are (name, percent), the first most: the first three's share, saturation about one half (all of it in gray images), gray images .95 more, and whether the caption names colour."""
    some = F.size(F.coalesce(colours, F.array().cast("array<struct<name:string,percent:double>>"))) > 0
    top = F.aggregate(F.slice(colours, 1, 3), F.lit(0.0), lambda a, c: a + c["percent"]) / 100
    named = _mentions(caption, [F.lower(F.get(colours, F.lit(0))["name"]), "color"]) | (gray & _mentions(caption, ["gray", "black", "white"]))
    return _mean([F.when(some, top), F.when(gray, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(saturation - 0.5) * 2)), F.when(gray, 0.95), F.when(some & caption.isNotNull(), F.when(named, 0.85).otherwise(0.4))])


def structural_alignment(edges: Column, sharpness: Column, aspect: Column, entropy: Column) -> Column:
    """Edges (a tenth is full), sharpness in three steps, a sane aspect ratio, entropy of eight bits."""
    sharp = F.when(sharpness < 100, 0.2).when(sharpness < 500, 0.6).otherwise(F.least(F.lit(1.0), sharpness / 1000))
    return _mean([F.least(F.lit(1.0), edges * 10), sharp, F.when((aspect > 0.3) & (aspect < 3), 1.0).otherwise(0.5), F.least(F.lit(1.0), entropy / 8)])


def grounding(claims: DataFrame) -> DataFrame:
    """(image, claims, grounding) of claims (image, sources, evidence): kinds of sources (four are full), shares of claims with a source that is no synthesis (L), with evidence, and of those not of synthesis alone."""
    own = F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    synthetic = lambda s: F.upper(F.substring(s, 1, 1)) == "L"
    rows = claims.select("image", own.alias("s"), (F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0).alias("proved"))
    n = rows.groupBy("image").agg(
        F.count("*").alias("claims"), F.size(F.array_distinct(F.flatten(F.collect_set(F.transform("s", lambda s: F.substring(s, 1, 1)))))).alias("kinds"),
        F.count_if(F.exists("s", lambda s: ~synthetic(s))).alias("grounded"), F.count_if("proved").alias("proved"), F.count_if(F.forall("s", synthetic)).alias("alone"),
    )
    share = lambda c: F.col(c) / F.col("claims")
    return n.select("image", "claims", ((F.least(F.lit(1.0), F.col("kinds") / 4) + share("grounded") + share("proved") + 1 - share("alone")) / 4).alias("grounding"))


def novelty(results: DataFrame, limit: int = 5) -> DataFrame:
    """(image, at, novelty) of each result (image, at, model, caption, score, confidence) against the image's last ones before it.

    The mean of how far the caption's length is from the mean length of the prior models'
    names (one at most) and the confidence, or without one the distance to the prior mean
    score, as upstream has it; 1 for a first result. Ties of time by caption.
    """
    before = W.partitionBy("image").orderBy("at", "caption").rowsBetween(-limit, -1)
    prior = F.count("*").over(before)
    length = F.avg(F.length("model")).over(before)
    away = F.when(length.isNotNull(), F.least(F.lit(1.0), F.abs(F.length(F.coalesce("caption", F.lit(""))) - length) / F.greatest(length, F.lit(1.0))))
    delta = F.abs(F.coalesce(F.col("confidence"), F.lit(0.0) - F.avg("score").over(before)))
    return results.select("image", "at", F.when(prior == 0, 1.0).otherwise(_mean([away, delta])).alias("novelty"))
