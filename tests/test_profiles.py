"""Edge cases of image types, escalation and conflicts; the queries hold them to SQL on whole tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import profiles

IMAGE = "image long, edges double, entropy double, straight double, text double, saturation double, gray boolean, colours array<struct<name:string,percent:double>>, width int, height int"


def test_types_and_unknown(spark):
    rows = [
        (1, 0.2, 6.0, 0.1, 0.1, 0.5, False, [("Green", 20.0)], 2000, 1000), (2, 0.6, 3.0, 0.3, 0.0, 0.1, False, [("Red", 60.0)], 64, 64), (3, 0.05, 3.0, 0.2, 0.95, 0.05, True, [("White", 80.0), ("Black", 10.0)], 2000, 3000),
        (4, 0.05, 3.0, 0.4, 0.05, 0.15, False, [(str(k), 1.0) for k in range(12)], 2000, 2000),
    ]
    got = {r.image: (r.type, round(r.confidence, 6)) for r in profiles.image_types(spark.createDataFrame(rows, IMAGE)).collect()}
    assert got[1][0] == "Photo" and got[2][0] == "Icon" and got[3][0] == "ScannedDocument"
    assert got[3][1] == round(0.975 - 0.465 + 0.3, 6)  # the second is the screenshot
    assert got[4] == ("Unknown", 0.5)


def test_escalation(spark):
    r = spark.range(1).select(
        profiles.escalation(F.lit(0.9), F.lit(900.0), F.lit(0.1), F.lit("Photo")).alias("none"), profiles.escalation(F.lit(0.425), F.lit(12.4), F.lit(0.5), F.lit("Chart")).alias("all"), profiles.escalation(F.lit(None).cast("double"), F.lit(900.0), F.lit(0.1), F.lit(None).cast("string")).alias("null"),
    ).first()
    assert (r.none, r["all"], r.null) == (None, "Low type confidence (43%), Blurry image (sharpness: 12), High text content (score: 0.50), Complex chart", None)


def test_conflict_rules(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("k", 1.0, 0.2, "a", None, day, 1), ("k", 2.0, 0.9, "b", 3, day, 2), ("k", 1.0, 0.9, "c", 3, day + dt.timedelta(1), 3), ("k", 5.0, 0.4, "d", 1, day, 4)]
    df = spark.createDataFrame(rows, "key string, value double, confidence double, source string, priority int, ts timestamp, order long")
    got = {rule: tuple(profiles.resolved(df, ["key"], rule).select("value", "source").first()) for rule in profiles.RULES}
    assert got == {"priority": (2.0, "b"), "newer": (1.0, "c"), "average": (2.25, "ConflictResolver"), "consensus": (1.0, "ConflictResolver"), "highest": (2.0, "b")}
    m = profiles.merged(df, ["key"]).first()
    assert (m.value, round(m.confidence, 6), m.merged_from, m.original_count) == (2.0, 0.6, ["a", "b", "c", "d"], 4)
    with pytest.raises(ValueError):
        profiles.resolved(df, ["key"], "loudest")
    assert profiles.resolved(df.limit(0), ["key"], "consensus").collect() == []
