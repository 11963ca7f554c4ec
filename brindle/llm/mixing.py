"""Mixing sources to target weights: whole documents, repeated by their source's rate.

Three passes, all DataFrame functions:

1. Each document's size in words, and the sum a source. Sizes are kept in the shared
   folder with two numbers hashed from id and text, so texts are read once.
2. Targets: all sizes' sum is shared by weight; a source stops at ``max_repeats`` times
   its size, and the excess goes to the others by weight, round by round, until none
   is above. Weights repeat over the sources in code-point order, null last; the order
   is that of sorted ranges, numbered as they lie, so any number of sources will do.
3. A source's rate is target / size. A document is taken floor(rate) times, and once
   more if its hash falls under the fraction (a Bernoulli draw). The draws of several
   seeds are summed by source in one aggregate, and the seed whose sum comes nearest to
   the target is the source's: a few very long documents then cannot carry a source
   far off its target.

Only sums by source are shuffled; a source with a third of all documents is
pre-aggregated where it lies. Sums by source are broadcast if they are at most
BROADCAST_ROWS rows, else joined by a shuffle that Spark splits where it is skewed.

A null text has size 0; so has a text of white space; they are taken by the source's
rate as any other, and add no words. Null and repeated ids are allowed: rows with equal
id and text draw alike. A null source is a source of its own, the last. A source
without words has target 0. An empty table gives no rows. Other columns are ignored by
``mixed`` and kept by ``emit``. Texts of any length are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEEDS = 32
BROADCAST_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"
#: One more than the largest draw.
DRAWS = 1 << 32


def _draw(key: Column, at: int) -> Column:
    """32 bits of an md5 text as a number."""
    return F.conv(F.substring(key, at, 8), 16, 10).cast("long")


def _measured(docs: DataFrame, doc_id: str, text: str, into: str) -> DataFrame:
    """docs with a struct column: words, and the two numbers that a document's draws come from."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(":"), body).cast("binary"))
    return docs.withColumn(into, F.struct(F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), _draw(key, 1).alias("first"), _draw(key, 9).alias("step")))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, first, step) of every document."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    return _measured(slim, "doc_id", "text", "m").select("doc_id", "source", "m.size", "m.first", "m.step")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with their number from 0 in code-point order, null last."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last()]
    lying = materialize(sources.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["_part"]: r["count"] for r in lying.groupBy(part.alias("_part")).count().collect()}  # one row a range
    shifts, total = [], 0
    for p in sorted(counts):
        shifts.append((p, total))
        total += counts[p]
    before = F.broadcast(sources.sparkSession.createDataFrame(shifts, "_part long, _before long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return lying.withColumn("_part", part).join(before, "_part").withColumn("number", F.col("_before") + place).drop("_at", "_part", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of sizes (source, size); materialised."""
    sums = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    rows = materialize(_numbered(sums).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("most")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    exact = "decimal(19,0)"
    full, left, shared = F.lit(False), total, None
    while True:  # each round stops one source at least
        found = rows.agg(F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        stopped, open_weight = found[0] or 0, found[1] or 0
        if (stopped, open_weight) == shared:
            break
        shared, left = (stopped, open_weight), total - stopped
        full = F.col("most").cast(exact) * F.lit(open_weight).cast(exact) <= F.col("weight").cast(exact) * F.lit(left).cast(exact)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(open_weight or 1))
    return materialize(rows.select("source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(share).alias("target")))


def _by_source(rows: DataFrame, of_source: DataFrame, few: bool) -> DataFrame:
    other = of_source.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _extra(first: Column, step: Column, seed: Column | int, fraction: Column) -> Column:
    """1 if the document's draw of that seed falls under its source's fraction (of all draws)."""
    return ((first + step * seed) % F.lit(DRAWS) < fraction).cast("long")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seeds: int = SEEDS) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, fraction, seed) of sized rows (materialised), and whether they are few."""
    of_source = targets(rows.select("source", "size"), weights, max_repeats)
    few = of_source.count() <= BROADCAST_ROWS
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of_source = of_source.withColumn("whole", F.floor(rate)).withColumn("fraction", (rate - F.floor(rate)) * F.lit(float(DRAWS)))
    drawn = [F.sum(_extra(F.col("first"), F.col("step"), k, F.col("fraction")) * F.col("size")).alias(f"s{k}") for k in range(seeds)]
    sums = _by_source(rows, of_source.select("source", "fraction"), few).groupBy("source").agg(*drawn)
    off = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).cast("long").alias("seed")) for k in range(seeds)]
    best = _by_source(of_source, sums, few)
    return materialize(best.select("source", "source_size", "target", "whole", "fraction", F.array_min(F.array(*off))["seed"].alias("seed"))), few


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seeds: int = SEEDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    rows = materialize(sized(docs, doc_id, text, source))
    times = (F.col("whole") + _extra(F.col("first"), F.col("step"), F.col("seed"), F.col("fraction"))).cast("int")
    out = _by_source(rows, *plan(rows, weights, max_repeats, seeds)).withColumn("copies", times)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seeds: int = SEEDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: docs (all columns), each row as often as it is taken; max_repeats bounds a row's copies."""
    of_source, few = plan(materialize(sized(docs, doc_id, text, source)), weights, max_repeats, seeds)
    own, one = "_brindle_measures", "_brindle_plan"
    while own in docs.columns or one in docs.columns:
        own, one = own + "_", one + "_"
    packed = of_source.select(F.struct(*of_source.columns).alias(one))
    found = _measured(docs, doc_id, text, own).join(F.broadcast(packed) if few else packed, F.col(f"`{source}`").eqNullSafe(F.col(f"{one}.source")))
    times = (F.col(f"{one}.whole") + _extra(F.col(f"{own}.first"), F.col(f"{own}.step"), F.col(f"{one}.seed"), F.col(f"{one}.fraction"))).cast("int")
    repeated = found.withColumn(own, F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same in DuckDB; the shares are found in order of size by weight, where each source that stops leaves more to the others.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k
  FROM documents),
drawn AS (SELECT doc_id, source, size, CAST('0x' || substr(k, 1, 8) AS BIGINT) AS first, CAST('0x' || substr(k, 9, 8) AS BIGINT) AS step FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
filling AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed),
stopped AS (SELECT *, 3 * source_size * open_weight <= weight * rest AS is_full FROM filling),
level AS (SELECT CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (is_full), 0) AS DOUBLE) AS rest, CAST(sum(weight) FILTER (NOT is_full) AS DOUBLE) AS open_weight FROM stopped),
aims AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE level.rest * weight / level.open_weight END AS target FROM stopped, level),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aims),
parts AS (SELECT source, source_size, target, floor(rate) AS whole, (rate - floor(rate)) * 4294967296.0 AS fraction FROM rates),
seeded AS (
  SELECT p.source, s.seed, abs(any_value(p.whole) * any_value(p.source_size) + sum(CASE WHEN (d.first + d.step * s.seed) % 4294967296 < p.fraction THEN d.size ELSE 0 END) - any_value(p.target)) AS off
  FROM drawn d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, (SELECT unnest(range(32)) AS seed) s GROUP BY p.source, s.seed),
best AS (SELECT source, seed FROM seeded QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * c.copies AS BIGINT) AS taken, c.copies
FROM drawn d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN best b ON d.source IS NOT DISTINCT FROM b.source,
  LATERAL (SELECT CAST(p.whole + CASE WHEN (d.first + d.step * b.seed) % 4294967296 < p.fraction THEN 1 ELSE 0 END AS INTEGER) AS copies) c
"""
