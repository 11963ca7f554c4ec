"""Routing and discriminators on edge cases; the queries hold them to SQL on whole tables."""

import datetime as dt

from pyspark.sql import functions as F

from brindle.operators import routing

PROFILE = "image long, hash string, text_tier string, animated boolean, frames int, pixels long, text_likeliness double, edge_density double, content_type string, text_coverage double, text_regions int, subtitles boolean"
NOW = dt.datetime(2024, 1, 2)


def row(i, h=None, tier="substantial", animated=False, frames=1, pixels=500_000, likely=0.3, edges=0.1, kind="Photo", cover=0.12, regions=5, subtitles=False):
    return (i, h, tier, animated, frames, pixels, likely, edges, kind, cover, regions, subtitles)


def test_points_and_routes(spark):
    rows = [
        row(1, cover=0.45), row(2, cover=0.02, regions=0, likely=0.05), row(3), row(4, animated=True, frames=9, cover=0.12, subtitles=True), row(5, animated=True, frames=9, cover=0.12),
        row(6, cover=0.0, regions=0, likely=0.9), row(7, kind="Chart", edges=0.2, regions=6), row(8, tier="caption", cover=0.01, regions=1, pixels=10),
    ]
    got = {r.image: r for r in routing.routed(spark.createDataFrame(rows, PROFILE)).collect()}
    assert {i: (r.quality, r.fast, r.route) for i, r in got.items()} == {
        1: (3, 0, "quality"), 2: (0, 5, "fast"), 3: (1, 1, "balanced"), 4: (1, 1, "balanced"), 5: (3, 0, "quality"), 6: (1, 3, "fast"), 7: (4, 1, "quality"), 8: (0, 4, "fast"),
    }
    assert got[1].skip == [] and "OcrWave" not in got[2].skip and "OcrWave" in got[8].skip and got[4].skip == routing.SKIP["animated", "balanced"]


def test_remembered_routes(spark):
    hour = dt.timedelta(hours=1)
    kept = [("a", "fast", NOW - 30 * hour, False), ("b", "fast", NOW - 5 * hour, False), ("b", "quality", NOW - hour, False), ("b", "balanced", NOW, True), ("c", "quality", NOW - 900 * hour, True), (None, "fast", NOW, False)]
    remembered = spark.createDataFrame(kept, "hash string, route string, at timestamp, kept boolean")
    rows = [row(1, "a"), row(2, "b"), row(3, "c"), row(4, None), row(5, "z")]
    got = {r.image: (r.route, r["from"]) for r in routing.routed(spark.createDataFrame(rows, PROFILE), remembered, F.lit(NOW)).collect()}
    assert got == {1: ("balanced", "points"), 2: ("quality", "cache"), 3: ("quality", "profile"), 4: ("balanced", "points"), 5: ("balanced", "points")}


def test_discriminators_without_parts(spark):
    null = lambda t: F.lit(None).cast(t)
    r = spark.range(1).select(
        routing.ocr_fidelity(F.lit(0.1), F.lit("text"), F.lit("word")).alias("few"), routing.ocr_fidelity(F.lit(0.6), null("string"), F.lit("word")).alias("bare"), routing.motion_agreement(null("double"), F.lit(5.0), F.lit(50.0), F.lit("left"), F.lit("x")).alias("still"),
        routing.palette_consistency(null("array<struct<name:string,percent:double>>"), F.lit(0.5), F.lit(False), F.lit("red")).alias("plain"), routing.structural_alignment(F.lit(0.2), F.lit(2000.0), F.lit(5.0), F.lit(8.0)).alias("built"),
    ).first()
    assert (r.few, r.bare, r.still, r.plain, r.built) == (0.0, 0.6, 0.0, 1.0, 0.875)
    claims = spark.createDataFrame([(1, None, None), (1, ["L1"], ["seen"]), (1, ["V", "", None, "l2"], []), (2, ["M", "O", "S", "G", "V"], ["x"])], "image long, sources array<string>, evidence array<string>")
    got = {x.image: (x.claims, round(x.grounding, 6)) for x in routing.grounding(claims).collect()}
    assert got == {1: (3, round((3 / 4 + 1 / 3 + 1 / 3 + 1 - 2 / 3) / 4, 6)), 2: (1, 1.0)}
