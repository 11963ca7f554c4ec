"""Questions over a corpus with a knowledge graph: entities, mentions, relations, communities and the three search modes.

Answers are extractive: the context that a language model would be given. chunks is
(chunk_id, text), mentions (chunk_id, entity), relations (source, relation, target,
weight), communities (community, entity, summary).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that choose a mode, fixed values; the first list that fits counts.
GLOBAL_WORDS = ("main theme", "summarize", "what topics", "overview")
DRIFT_WORDS = ("relate", "connect", "compare", "between")


def mode_of(question: Column) -> Column:
    q = F.lower(question)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w))
    return F.when(has(GLOBAL_WORDS), "global").when(has(DRIFT_WORDS), "drift").otherwise("local")


def truncated(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def contexts(hits: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame, edges: int = 3) -> DataFrame:
    """(chunk_id, score, source, entities, context) of hits (chunk_id, score), which are the few rows of a top-k.

    The context holds the text, the entities in order of their names, and the three
    heaviest relations from them (ties by source and target).
    """
    few = F.broadcast(hits)
    texts = chunks.join(few, "chunk_id").select("chunk_id", "score", "text")
    own = mentions.join(few.select("chunk_id"), "chunk_id").select("chunk_id", "entity").distinct()
    names = own.groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    place = W.partitionBy("chunk_id").orderBy(F.desc("weight"), "source", "target", "relation")
    lines = relations.join(own.select("chunk_id", F.col("entity").alias("source")), "source").withColumn("at", F.row_number().over(place)).where(F.col("at") <= edges)
    line = F.concat(F.lit("\n  "), "source", F.lit(" --["), "relation", F.lit("]--> "), "target")
    drawn = lines.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "").alias("drawn"))
    both = texts.join(names, "chunk_id", "left").join(drawn, "chunk_id", "left")
    named = F.when(F.col("entities").isNotNull(), F.concat(F.lit("\nEntities: "), F.array_join("entities", ", "))).otherwise("")
    context = F.concat(F.lit("--- Chunk (score: "), F.format_string("%.3f", "score"), F.lit(") ---\n"), "text", named, F.coalesce("drawn", F.lit("")))
    return both.select("chunk_id", "score", truncated(F.col("text")).alias("source"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), context.alias("context"))


def local_search(hits: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: answer, sources (in the order of score), entities (distinct), communities_used."""
    found = contexts(hits, chunks, mentions, relations)
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "chunk_id", "source", "entities", "context"))), lambda x: x)
    one = found.agg(rows.alias("r"))
    return one.select(
        F.array_join(F.transform("r", lambda x: x["context"]), "\n\n").alias("answer"), F.transform("r", lambda x: x["chunk_id"]).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda x: x["entities"])))).alias("entities"), F.lit(0).cast("long").alias("communities_used"),
    )


def global_search(terms: list[str], communities: DataFrame) -> DataFrame:
    """One row: the summaries that hold a term of the question, numbered in the order of the communities' names."""
    c = communities.where(F.coalesce(F.col("summary"), F.lit("")) != "").select("community", "summary").distinct()
    relevant = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower("summary"), t))
    kept = F.array_sort(F.collect_list(F.when(relevant, F.struct("community", "summary"))))
    lines = F.transform("kept", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["summary"]))
    answer = F.when(F.size("kept") > 0, F.array_join(lines, "\n\n")).otherwise("No relevant information found in community summaries.")
    return c.agg(kept.alias("kept"), F.count("*").alias("n")).select(answer.alias("answer"), F.array().cast("array<long>").alias("sources"), F.array().cast("array<string>").alias("entities"), F.col("n").alias("communities_used"))


def drift_search(local: DataFrame, communities: DataFrame) -> DataFrame:
    """local with the summaries of all communities that share an entity with it."""
    found = local.select(F.explode("entities").alias("entity"))
    shared = communities.where(F.coalesce(F.col("summary"), F.lit("")) != "").join(F.broadcast(found), "entity", "left_semi").select("community", "summary").distinct()
    themes = shared.agg(F.array_sort(F.collect_list(F.struct("community", "summary"))).alias("t"))
    lines = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["summary"])), "\n")
    return local.crossJoin(themes).select(F.concat(F.lit("Specific details:\n"), "answer", F.lit("\n\nBroader themes:\n"), lines).alias("answer"), "sources", "entities", F.size("t").cast("long").alias("communities_used"))  # one row each


def summaries(communities: DataFrame, mentions: DataFrame, top: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """communities (community, entity) with summary: the entities of most mentions, ties by name. counts (entity, n): the entities' mentions, where they are known."""
    counts = mentions.groupBy("entity").agg(F.countDistinct("chunk_id").alias("n")) if counts is None else counts
    placed = communities.join(counts, "entity", "left").withColumn("at", F.row_number().over(W.partitionBy("community").orderBy(F.desc_nulls_last("n"), "entity")))
    named = placed.where(F.col("at") <= top).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]).alias("names"))
    return communities.join(named.select("community", F.array_join("names", ", ").alias("summary")), "community")


def community_context(members: DataFrame, relations: DataFrame, entities: int = 15, heads: int = 8, edges: int = 3, lines: int = 10) -> DataFrame:
    """(community, entity_lines, relation_lines): what a summary of a community is written from.

    members is (community, entity, type, description); the first entities by name, for
    the first of them their heaviest relations, and of those lines the first distinct ones.
    """
    place = W.partitionBy("community").orderBy("entity")
    few = members.withColumn("at", F.row_number().over(place)).where(F.col("at") <= entities)
    line = F.concat(F.lit("- "), "entity", F.lit(" ("), "type", F.lit("): "), F.coalesce("description", F.lit("no desc")))
    named = few.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("entity_lines"))
    first = few.where(F.col("at") <= heads).select("community", "at", F.col("entity").alias("head"))
    ends = relations.select(F.col("source").alias("head"), "source", "relation", "target", "weight").union(relations.where("source <> target").select(F.col("target"), "source", "relation", "target", "weight"))
    drawn = first.join(ends, "head").withColumn("e", F.row_number().over(W.partitionBy("community", "at").orderBy(F.desc("weight"), "source", "target", "relation"))).where(F.col("e") <= edges)
    text = F.concat(F.lit("- "), "source", F.lit(" --["), "relation", F.lit("]--> "), "target")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "e", text.alias("line")))), lambda x: x["line"])
    joined = drawn.groupBy("community").agg(F.array_join(F.slice(F.array_distinct(ordered), 1, lines), "\n").alias("relation_lines"))
    return named.join(joined, "community", "left").select("community", "entity_lines", F.coalesce("relation_lines", F.lit("")).alias("relation_lines"))


def parse_rows(answers: DataFrame, chunk_id: str = "chunk_id", text: str = "text", least: int = 2, most: int = 100) -> DataFrame:
    """(chunk_id, n, name, type, description) from lines ``name | type | description`` or one JSON object a line; other lines give nothing."""
    lines = answers.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    parts = F.split("line", r"\|")
    js = F.from_json("line", "name string, type string, desc string")
    is_json = F.col("line").startswith("{")
    name = F.when(is_json, js["name"]).otherwise(F.regexp_replace(F.trim(parts[0]), r"^[-* ]+", ""))
    kind = F.lower(F.when(is_json, js["type"]).otherwise(F.trim(F.get(parts, F.lit(1)))))
    told = F.when(is_json, js["desc"]).otherwise(F.trim(F.get(parts, F.lit(2))))
    made = lines.select("chunk_id", "n", name.alias("name"), kind.alias("type"), told.alias("description"))
    return made.where(F.col("type").isNotNull() & F.length("name").between(least, most))


def parse_relations(answers: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(source, type, target, description, chunks): lines ``source | type | target | description``, the same ones of all chunks together."""
    lines = answers.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    parts = F.split("line", r"\|")
    rows = lines.where(F.size(parts) >= 3).select("chunk_id", "n", F.regexp_replace(F.trim(parts[0]), r"^[-* ]+", "").alias("source"), F.replace(F.lower(F.trim(parts[1])), F.lit(" "), F.lit("_")).alias("type"), F.trim(parts[2]).alias("target"), F.trim(F.get(parts, F.lit(3))).alias("description"))
    return rows.groupBy("source", "type", "target").agg(F.min_by("description", F.struct("chunk_id", "n")).alias("description"), F.countDistinct("chunk_id").alias("chunks"))


def signal_type(signals: Column) -> Column:
    """The type that an entity's signals give it, the strongest first; null without any of them."""
    return F.when(F.array_contains(signals, "inline_code"), "code").when(F.array_contains(signals, "heading"), "concept").when(F.array_contains(signals, "high_idf"), "technology")


def link_edges(links: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, new entities) of links (source, target, relation, chunk_id): targets outside become entities, and unknown sources concepts.

    A target without a prefix blog:, github: or site: has to be an entity (name) already.
    """
    from ..functions.text import entity_id

    prefix = F.regexp_extract("target", "^(blog|github|site):", 1)
    known = entities.select(F.lower("name").alias("known")).distinct()
    grouped = links.groupBy("source", "target", "relation").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunks")).withColumn("prefix", prefix)
    held = grouped.join(known, F.lower("target") == F.col("known"), "left").where("prefix <> '' or known is not null").drop("known")
    held = held.join(known, F.lower("source") == F.col("known"), "left")
    edges = held.select(entity_id(F.col("source")).alias("source_id"), entity_id(F.col("target")).alias("target_id"), "relation", F.size("chunks").cast("long").alias("chunks"))
    kind = F.when(F.col("prefix") == "blog", "document").when(F.col("prefix") == "github", "repository").otherwise("website")
    new = held.where("prefix <> ''").select(F.col("target").alias("name"), kind.alias("type")).union(held.where("known is null").select("source", F.lit("concept"))).distinct()
    return edges, new.select(entity_id(F.col("name")).alias("entity_id"), "name", "type")


#: Words of a question that are not looked for, besides the usual ones; fixed values.
ASKING = "what how why who which when where are is was does did the and for with between main theme themes topics overview summarize compare relate connect there".split()
CHUNK_WORDS = 50


def chunks_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = CHUNK_WORDS) -> DataFrame:
    """(chunk_id, doc_id, text): texts cut after so many words; chunk_id is ``<doc_id>:<number>``. Texts without words give none."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    each = docs.select(F.col(doc_id).alias("doc_id"), parts.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int"))
    cut = each.select("doc_id", F.explode(F.transform(starts, lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", k * words + 1, words), " ").alias("text")))).alias("c"))
    return cut.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("c.k").cast("string")).alias("chunk_id"), "doc_id", "c.text")


#: Up to so many names (counted) they are broadcast.
FEW_NAMES = 500_000


def graph_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, mentions, relations, communities) of documents; chunks, communities and the numbers that mentions and relations are made of are kept.

    Entities are the significant candidates; a mention is a chunk that holds one as a
    token; two entities of a chunk are related, from ``least`` common chunks on. Chunks
    are short, so a chunk's pairs are bounded. Communities are those of the relations'
    graph, with the entities of most mentions as summary. Entities are numbered in the
    order of their names, and pairs of numbers are counted.
    """
    from ..functions import text as tx
    from ..sources.storage import materialize
    from . import communities as cm
    from . import graph as gr
    from .pairs import both_ways, common_pairs, unpacked
    from .rank import ranked

    chunks = materialize(chunks_of(docs, doc_id, text))
    found = gr.significant(gr.candidates(docs, doc_id, text)).select(F.col("name").alias("entity"), F.lit(0).alias("none"))
    names = materialize(ranked(found, "none", "entity").select("entity", (F.col("rank") - 1).cast("int").alias("id")))
    small = F.broadcast if names.count() <= FEW_NAMES else lambda x: x
    words = chunks.select("chunk_id", F.explode(F.array_distinct(tx.tokens(F.col("text"), 3))).alias("entity"))
    own = materialize(words.join(small(names), "entity").groupBy("chunk_id").agg(F.array_sort(F.collect_set("id")).alias("own")))
    mentions = own.select("chunk_id", F.explode("own").alias("id")).join(small(names), "id").select("chunk_id", "entity")
    lists = materialize(own.groupBy("own").agg(F.count("*").alias("copies")))
    pairs = common_pairs(lists, least)
    ends = [small(names.select(F.col("id").alias(x), F.col("entity").alias(name))) for x, name in (("a", "source"), ("b", "target"))]
    relations = unpacked(pairs).join(ends[0], "a").join(ends[1], "b").select("source", F.lit("related_to").alias("relation"), "target", F.col("weight").cast("long"))
    communities = cm.louvain(both_ways(pairs)).join(names, F.col("node") == F.col("id")).select("community", "entity")
    counts = lists.select(F.explode("own").alias("id"), "copies").groupBy("id").agg(F.sum("copies").alias("n")).join(names, "id").select("entity", "n")
    return chunks, mentions, relations, materialize(summaries(communities, mentions, counts=counts))


def asked_words(question: str) -> list[str]:
    """The words that a question is searched by: three letters at least, none of the usual ones, each once in their order."""
    from .multivector import STOP

    return [w for w in dict.fromkeys(re.findall(r"\w{3,}", question.lower())) if w not in STOP and w not in ASKING]


def ask(question: str, index: tuple[DataFrame, DataFrame, DataFrame, DataFrame], top: int = 5) -> DataFrame:
    """One row: question, mode, answer, sources, entities, communities_used; found by the question's own words in the mode that they choose.

    A question without words to look for finds nothing.
    """
    from .rank import bm25, top_k

    chunks, mentions, relations, communities = index
    mode = chunks.sparkSession.range(1).select(mode_of(F.lit(question)).alias("m")).first()["m"]
    words = asked_words(question)
    if mode == "global":
        found = global_search(words or ["\x00"], communities)
    else:
        scored = bm25(chunks, words, "chunk_id", "text") if words else chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
        scored = scored.withColumnRenamed("doc_id", "chunk_id")
        hits = top_k(scored.select("chunk_id", F.round("score", 6).alias("score")), top, "score", "chunk_id")
        found = local_search(hits, chunks.select("chunk_id", "text"), mentions, relations)
        found = drift_search(found, communities) if mode == "drift" else found
    return found.select(F.lit(question).alias("question"), F.lit(mode).alias("mode"), "answer", F.transform("sources", lambda s: s.cast("string")).alias("sources"), "entities", "communities_used")
