"""Frame sequences and page layouts: motion statistics, complexity of an animation, merged regions, reading order and columns.

An image's frames and a page's segments are grouped by their key; sums are aggregated
before the shuffle. Only the region merge needs an image's rows in order: they are
sorted within partitions, and one image's boxes at a time are held as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
DIRECTIONS = ["right", "down-right", "down", "down-left", "left", "up-left", "up", "up-right", "stationary"]
SCENE_FACTOR = 2.5
COLUMN_SHARE = 0.4
TOP_REGIONS = 5


def wrapped(angle: Column, mean: Column) -> Column:
    """The difference of two angles in degrees, turned once where it is over half a circle."""
    d = angle - mean
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def motion_type(moves: Column, consistency: Column, activity: Column, magnitude: Column) -> Column:
    kind = F.when(~moves, "static").when(consistency < 0.3, "oscillating").when((activity > 0.7) & (consistency < 0.5), "radial").when((consistency < 0.5) & (activity > 0.3), "rotating")
    return kind.when((consistency > 0.7) & (activity > 0.5), "panning").when((activity < 0.3) & (magnitude > 2), "object_motion").otherwise("general")


def motion(flows: DataFrame, image: str = "image") -> DataFrame:
    """One row an image of flows (image, magnitude, max_magnitude, activity, angle in degrees, direction 0 to 8).

    Means, the direction with most votes (ties: the first) and its share, the consistency
    of directions (1 less the deviation of angles from their mean, turned at half a
    circle, by 180) and of magnitudes over time (1 less the coefficient of variation),
    and the type of motion. One frame alone is consistent. Null measures count as missing.
    """
    f = flows.select(F.col(image).alias("image"), "magnitude", "max_magnitude", "activity", "angle", "direction")
    means = f.groupBy("image").agg(F.count("*").alias("frames"), F.avg("magnitude").alias("average_magnitude"), F.max("max_magnitude").alias("max_magnitude"), F.avg("activity").alias("motion_activity"), F.avg("angle").alias("_angle"), *[F.count_if(F.col("direction") == k).alias(f"_d{k}") for k in range(9)])
    away = wrapped(F.col("angle"), F.col("_angle"))
    spread = f.select("image", "angle", "magnitude").join(means.select("image", "_angle", "average_magnitude"), "image").groupBy("image").agg(F.avg(away * away).alias("_turn"), F.avg(F.pow(F.col("magnitude") - F.col("average_magnitude"), F.lit(2))).alias("_wide"))
    votes = F.array_max(F.array(*[F.struct(F.col(f"_d{k}").alias("n"), F.lit(-k).alias("k")) for k in range(9)]))
    rows = means.join(spread, "image").withColumn("_votes", votes)
    moves = (F.col("average_magnitude") > 0.5) | (F.col("motion_activity") > 0.05)
    alone = F.col("frames") < 2
    rows = rows.withColumns({
        "direction": F.when(F.col("_votes.n") > 0, F.element_at(F.array(*map(F.lit, DIRECTIONS)), 1 - F.col("_votes.k"))).otherwise("stationary"),
        "direction_confidence": F.col("_votes.n") / F.col("frames"),
        "direction_consistency": F.when(alone, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt("_turn") / 180)),
        "temporal_consistency": F.when(alone | (F.col("average_magnitude") < 0.01), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt("_wide") / F.col("average_magnitude"))),
    })
    kind = motion_type(moves, F.col("direction_consistency"), F.col("motion_activity"), F.col("average_magnitude"))
    return rows.select(F.col("image").alias(image), "frames", "average_magnitude", "max_magnitude", "motion_activity", "direction", "direction_confidence", "direction_consistency", "temporal_consistency", moves.alias("has_motion"), kind.alias("motion_type"))


def complexity(frames: DataFrame, image: str = "image", order: str = "frame") -> DataFrame:
    """One row an image of frames (image, frame, difference from the one before, entropy, r, g, b): stability, variation of colour and entropy, scene changes, type and the blend of them.

    Sums of doubles depend on their order, so differences and the mean meet their limits rounded to nine digits.
    """
    f = frames.select(F.col(image).alias("image"), F.col(order).alias("frame"), "difference", "entropy", "r", "g", "b")
    before = W.partitionBy("image").orderBy("frame")
    step = sum((F.pow(F.lag(c).over(before) - F.col(c), F.lit(2)) for c in ("r", "g", "b")), F.lit(0.0))
    f = f.withColumn("colour", F.sqrt(step) / 441.67)
    means = f.groupBy("image").agg(F.count("*").alias("frames"), F.avg("difference").alias("_diff"), F.avg("colour").alias("_colour"), F.stddev_pop("entropy").alias("_entropy"))
    cuts = f.select("image", "difference").join(means.select("image", "_diff"), "image").groupBy("image").agg(F.count_if(F.round("difference", 9) > F.round(F.col("_diff") * SCENE_FACTOR, 9)).alias("_cuts"))
    alone = F.col("frames") <= 1
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = means.join(cuts, "image").withColumns({
        "visual_stability": F.when(alone, 1.0).otherwise(1 - clamp(F.col("_diff") / 0.3)),
        "color_variation": F.when(alone, 0.0).otherwise(F.col("_colour")),
        "entropy_variation": F.when(alone, 0.0).otherwise(clamp(F.col("_entropy") / 2)),
        "scene_changes": F.when(alone, F.lit(0)).otherwise(F.col("_cuts")).cast("long"),
    })
    kind = F.when(alone, "static").when(F.col("scene_changes") > F.col("frames") * 0.3, "slideshow").when(F.round("_diff", 9) < 0.05, "simple-loop").when(F.round("_diff", 9) < 0.15, "smooth-animation").otherwise("complex-animation")
    blend = clamp(0.4 * (1 - F.col("visual_stability")) + 0.3 * F.col("color_variation") + 0.2 * F.col("entropy_variation") + 0.1 * clamp(F.col("scene_changes") / F.col("frames")))
    return rows.select(F.col("image").alias(image), "frames", "visual_stability", "color_variation", "entropy_variation", "scene_changes", kind.alias("animation_type"), blend.alias("complexity"))


def _grown(box: np.ndarray) -> list[tuple[int, int]]:
    """(row, region) of boxes (left, top, right, bottom) in their order: a region takes in every later free box that overlaps what it has grown to."""
    free = np.ones(len(box), bool)
    out = []
    for i in range(len(box)):
        if not free[i]:
            continue
        region, now, at = len(out) and out[-1][1] + 1, box[i].copy(), i + 1
        out.append((i, region))
        while at < len(box):
            rest = box[at:]
            meets = free[at:] & (now[0] < rest[:, 2]) & (now[2] > rest[:, 0]) & (now[1] < rest[:, 3]) & (now[3] > rest[:, 1])
            j = int(meets.argmax())
            if not meets[j]:
                break
            j += at
            free[j], at = False, j + 1
            now = np.concatenate([np.minimum(now[:2], box[j, :2]), np.maximum(now[2:], box[j, 2:])])
            out.append((j, region))
    return out


def merged_regions(regions: DataFrame, image: str = "image", order: str = "region", top: int = TOP_REGIONS) -> DataFrame:
    """(image, place, x, y, width, height, magnitude, parts): regions (image, region, x, y, width, height, magnitude) that overlap as one box with their mean magnitude, the strongest first.

    A region takes in, in their order, the later ones that overlap the box it has grown
    to; it does not go back. Ties of magnitude keep the order of the regions. One image's
    boxes are held at a time.
    """
    cols = ["image", "region", "x", "y", "width", "height", "magnitude"]
    kind = regions.schema[image].dataType.simpleString()
    slim = regions.select(F.col(image).alias("image"), F.col(order).cast("long").alias("region"), *[F.col(c).cast("double") for c in cols[2:]]).dropna()
    dealt = slim.repartition("image").sortWithinPartitions("image", "region", "x", "y", "width", "height", "magnitude")

    def merge(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        x, y, w, h, m = (table[c].to_numpy() for c in cols[2:])
        box = np.stack([x, y, x + w, y + h], 1)
        row, to = np.array(_grown(box)).T
        n = to.max() + 1
        edge = np.full((n, 4), np.inf)
        np.minimum.at(edge[:, :2], to, box[row, :2])
        edge[:, 2:] = -np.inf
        np.maximum.at(edge[:, 2:], to, box[row, 2:])
        parts = np.bincount(to, minlength=n)
        mean = np.bincount(to, m[row], n) / parts
        best = np.argsort(-mean, kind="stable")[:top]
        arrays = [pa.array([rows[0].column("image")[0].as_py()] * len(best), rows[0].schema.field("image").type), pa.array(np.arange(1, len(best) + 1, dtype=np.int32))]
        arrays += [pa.array(v[best]) for v in (edge[:, 0], edge[:, 1], edge[:, 2] - edge[:, 0], edge[:, 3] - edge[:, 1], mean, parts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["image", "place", "x", "y", "width", "height", "magnitude", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            images = batch.column("image").to_pylist()
            at = 0
            for end in range(1, len(images) + 1):
                if end < len(images) and images[end] == images[at]:
                    continue
                part = batch.slice(at, end - at)
                if waiting and waiting[0].column("image")[0].as_py() != images[at]:
                    yield merge(waiting)
                    waiting = []
                waiting.append(part)
                at = end
        if waiting:
            yield merge(waiting)

    out = dealt.mapInArrow(run, f"image {kind}, place int, x double, y double, width double, height double, magnitude double, parts long")
    return out.withColumnRenamed("image", image)


def reading_order(segments: DataFrame, page: str = "page", segment: str = "segment") -> DataFrame:
    """segments with z_order: from the top down, then from the left (ties by the segment, its type and size), from 0 in each page."""
    return segments.withColumn("z_order", F.row_number().over(W.partitionBy(page).orderBy("y", "x", segment, "type", "width", "height")) - 1)


def columns(centres: Column, width: Column) -> Column:
    """How many columns text blocks with these centres, in their order, make: a centre opens one if it is no nearer than two fifths of the page to the others that did."""
    def step(found: Column, c: Column) -> Column:
        return F.when(F.exists(found, lambda x: F.abs(x - c) < width * COLUMN_SHARE), found).otherwise(F.array_append(found, c))

    return F.greatest(F.lit(1), F.size(F.aggregate(centres, F.array().cast("array<long>"), step)))


def layout(segments: DataFrame, page: str = "page", segment: str = "segment") -> DataFrame:
    """(page, segments, columns, layout) of segments (page, segment, type, x, y, width, height) on pages of page_width.

    type is text, image, chart, table or another. The class is the first that fits: over
    half tables; over twice as many images and charts as text blocks; more columns than
    one; any image or table; a single column.
    """
    centre = F.floor(F.col("x") + F.floor(F.col("width") / 2)).cast("long")
    counted = segments.groupBy(F.col(page).alias("page")).agg(
        F.count("*").alias("n"), F.max("page_width").alias("page_width"), F.count_if(F.col("type") == "text").alias("text"), F.count_if(F.col("type").isin("image", "chart")).alias("image"),
        F.count_if(F.col("type") == "table").alias("table"), F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct(F.col(segment).alias("at"), centre.alias("c"))))).alias("blocks"),
    )
    rows = counted.withColumn("columns", columns(F.transform("blocks", lambda b: b["c"]), F.col("page_width")))
    kind = F.when(F.col("table") > F.col("n") * 0.5, "table-based").when(F.col("image") > F.col("text") * 2, "image-heavy").when(F.col("columns") > 1, "multi-column").when((F.col("image") > 0) | (F.col("table") > 0), "mixed").otherwise("single-column")
    return rows.select(F.col("page").alias(page), F.col("n").alias("segments"), "columns", kind.alias("layout"))
