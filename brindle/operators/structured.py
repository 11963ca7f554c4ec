"""Structured map-reduce over documents: what was found in chunks is stitched together and reduced to a report.

The map step's outputs are tables: entities (doc_id, chunk, place, name, type,
description, aliases), facts (doc_id, chunk, place, statement, confidence 0 to 3), flows
(doc_id, chunk, place, steps, type) and chunks (doc_id, chunk, heading). Entities of the
same normalised name are one, and so are those that a chain of aliases connects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialize
from . import graph
from .judgement import overall_confidence

# Fixed values.
NEGATIONS = ["not ", "never ", "cannot ", "doesn't ", "isn't ", "won't ", "shouldn't "]
CONFIDENCE = ["Uncertain", "Low", "Medium", "High"]
TOP_FACTS, TOP_ENTITIES, TOP_FLOWS = 15, 10, 5


def normal_name(name: Column) -> Column:
    """Without leading underscores, trailing brackets and a signature, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), "^_+", ""), "[()]+$", "")
    return F.lower(F.when(F.instr(bare, "(") > 1, F.substring_index(bare, "(", 1)).otherwise(bare))


def stitched(entities: DataFrame) -> DataFrame:
    """(doc_id, name, type, chunks, aliases, description, types): the entities of each document, those known by common names together.

    name and type are of the first entity (chunk, place); chunks are counted once; aliases
    are all other names, in any case once; the longest description stays (ties: the first
    in the order of the text); types are all that were given, which conflict if there are
    several. Names join through shared aliases, however long the chain.
    """
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    rows = entities.where("name is not null").select("doc_id", "chunk", "place", "name", "type", "description", normal_name(F.col("name")).alias("key"), F.filter(aliases, lambda a: a.isNotNull()).alias("aliases"))
    node = lambda key: F.struct(F.col("doc_id"), key.alias("key"))
    said = rows.select("doc_id", "key", F.explode("aliases").alias("alias"))
    links = said.select(node(F.col("key")).alias("a"), node(normal_name(F.col("alias"))).alias("b")).where("a <> b")
    roots = graph.components(links).select(F.col("node.doc_id").alias("_doc"), F.col("node.key").alias("_key"), F.col("root.key").alias("root"))
    placed = rows.join(roots, (F.col("doc_id") == F.col("_doc")) & (F.col("key") == F.col("_key")), "left").withColumn("root", F.coalesce("root", "key"))
    first = F.min(F.struct("chunk", "place", "name", "type"))
    long = F.max(F.struct(F.length("description").alias("n"), (-F.col("chunk")).alias("c"), (-F.col("place")).alias("p"), "description"))
    names = F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("name"), F.col("aliases")))))
    merged = placed.groupBy("doc_id", "root").agg(first.alias("first"), F.array_sort(F.collect_set("chunk")).alias("chunks"), names.alias("names"), long.alias("long"), F.array_sort(F.collect_set("type")).alias("types"))
    lower = F.array_distinct(F.transform("names", lambda n: F.lower(n)))
    others = F.array_sort(F.filter(lower, lambda n: n != F.lower("first.name")))
    return merged.select("doc_id", F.col("first.name").alias("name"), F.col("first.type").alias("type"), "chunks", others.alias("aliases"), F.col("long.description").alias("description"), "types")


def collisions(merged: DataFrame) -> DataFrame:
    """(doc_id, name, chunks, reason) of stitched entities with conflicting types."""
    return merged.where(F.size("types") > 1).select("doc_id", "name", "chunks", F.concat(F.lit("Conflicting types: "), F.array_join("types", ", ")).alias("reason"))


def conflicts(facts: DataFrame) -> DataFrame:
    """(doc_id, a, b): statements of different chunks, one of which denies what the other does not, with two common words of five letters at least.

    Pairs meet on their common words; a word counts once in a statement.
    """
    low = F.lower("statement")
    signs = F.array(*[F.contains(low, F.lit(p)) for p in NEGATIONS])
    rows = materialize(facts.where("statement is not null").select("doc_id", "chunk", "place", F.struct("chunk", "place").alias("id"), signs.alias("signs"), F.array_distinct(F.filter(F.split(low, r"[^\p{L}\p{Nd}_]+"), lambda w: F.length(w) > 4)).alias("words")))
    each = rows.select("doc_id", "id", "chunk", "signs", F.explode("words").alias("w"))
    # only a statement that denies in some way can be one side: the other side lacks one of its signs
    denies = each.where(F.exists("signs", lambda s: s)).select("doc_id", "w", F.col("id").alias("x"), F.col("chunk").alias("cx"), F.col("signs").alias("sx"))
    other = each.select(F.col("doc_id"), "w", F.col("id").alias("y"), F.col("chunk").alias("cy"), F.col("signs").alias("sy"))
    met = denies.join(other, ["doc_id", "w"]).where((F.col("cx") != F.col("cy")) & (F.col("sx") != F.col("sy")))
    return met.groupBy("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count_distinct("w").alias("n")).where("n >= 2").select("doc_id", "a", "b")


def coverage(chunks: DataFrame, entities: DataFrame, facts: DataFrame, flows: DataFrame) -> DataFrame:
    """(doc_id, direct, inferred, uncovered, ratio) of headings: with facts or entities, with flows alone, with nothing; inferred ones count half."""
    has = lambda t, name: t.select(F.col("doc_id").alias("_d"), F.col("chunk").alias("_c")).distinct().withColumn(name, F.lit(True))
    rows = chunks.where(F.trim(F.coalesce("heading", F.lit(""))) != "").select("doc_id", "chunk", "heading")
    for t, name in ((entities, "e"), (facts, "f"), (flows, "w")):
        rows = rows.join(has(t, name), (F.col("doc_id") == F.col("_d")) & (F.col("chunk") == F.col("_c")), "left").drop("_d", "_c")
    direct = F.coalesce("e", "f", F.lit(False))
    inferred = ~direct & F.coalesce("w", F.lit(False))
    n = rows.groupBy("doc_id").agg(F.count_distinct(F.when(direct, F.col("heading"))).alias("direct"), F.count_distinct(F.when(inferred, F.col("heading"))).alias("inferred"), F.count_distinct(F.when(~direct & ~inferred, F.col("heading"))).alias("uncovered"))
    return n.withColumn("ratio", (F.col("direct") + F.col("inferred") * 0.5) / (F.col("direct") + F.col("inferred") + F.col("uncovered")))


def _lines(rows: DataFrame, order: list[Column], line: Column, most: int, name: str) -> DataFrame:
    """(doc_id, name): the first lines of each document as one array."""
    placed = rows.withColumn("_at", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where(F.col("_at") <= most)
    return placed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", line.alias("line")))), lambda x: x["line"]).alias(name))


def report(chunks: DataFrame, entities: DataFrame, facts: DataFrame, flows: DataFrame) -> DataFrame:
    """One row a document of chunks: entities, collisions, conflicts, coverage, confidence, and the lines that a summary is written from.

    Lines: up to 15 facts of medium confidence and more, the surest first; up to 10
    entities, those of most chunks first; up to 5 flows.
    """
    merged = materialize(stitched(entities))
    found = materialize(conflicts(facts))
    docs = chunks.select("doc_id").distinct()
    counts = merged.groupBy("doc_id").agg(F.count("*").alias("entities"), F.count_if(F.size("types") > 1).alias("collisions"))
    sure = facts.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("confidence") == 3).alias("sure"))
    against = found.groupBy("doc_id").agg(F.count("*").alias("conflicts"))
    cited = F.concat(F.lit("- "), "statement", F.lit(" ["), F.col("chunk").cast("string"), F.lit("] (confidence: "), F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence") + 1), F.lit(")"))
    told = [
        _lines(facts.where("confidence >= 2"), [F.desc("confidence"), F.col("chunk"), F.col("place")], cited, TOP_FACTS, "fact_lines"),
        _lines(merged, [F.size("chunks").desc(), F.col("name")], F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("type", F.lit("")), F.lit("): "), F.coalesce("description", F.lit("no description"))), TOP_ENTITIES, "entity_lines"),
        _lines(flows, [F.col("chunk"), F.col("place")], F.concat(F.lit("- "), F.array_join("steps", " -> "), F.lit(" ("), "type", F.lit(")")), TOP_FLOWS, "flow_lines"),
    ]
    out = docs
    for part in (counts, sure, against, coverage(chunks, entities, facts, flows).select("doc_id", F.col("ratio").alias("coverage")), *told):
        out = out.join(part, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("entities", "collisions", "facts", "sure", "conflicts")} | {"coverage": F.coalesce("coverage", F.lit(0.0))}
    out = out.withColumns(zero).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("fact_lines", "entity_lines", "flow_lines")})
    return out.withColumn("confidence", overall_confidence(F.col("facts"), F.col("sure"), F.col("conflicts"), F.col("coverage")))
