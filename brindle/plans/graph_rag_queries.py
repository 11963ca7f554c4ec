"""Graph questions over the documents: long rare words are entities, neighbours in a document's list of them are related."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import communities as cm
from ..operators import graph as gr
from ..operators import graph_rag as rag
from ..operators import rank as rk
from ..sources.storage import materialize
from .registry import query, table
from .retrieval import TERMS, _BM25

_WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+'), lambda x: length(x) >= 8)"
_GRAPH = f"""tok AS (SELECT doc_id, lang, unnest(list_distinct({_WORDS})) AS entity FROM documents),
 ent AS (SELECT entity, count(*) AS n FROM tok GROUP BY 1 HAVING count(*) BETWEEN 3 AND 30),
 men AS (SELECT doc_id, entity, lang, n FROM tok JOIN ent USING (entity)),
 ld AS (SELECT doc_id, entity AS source, lead(entity) OVER (PARTITION BY doc_id ORDER BY entity) AS target FROM men),
 rel AS (SELECT source, 'next_to' AS relation, target, count(*) AS weight FROM ld WHERE target IS NOT NULL GROUP BY 1, 3),
 lc AS (SELECT entity, lang, n, count(*) AS c FROM men WHERE lang IS NOT NULL GROUP BY ALL),
 com AS (SELECT entity, n, lang AS community FROM lc QUALIFY row_number() OVER (PARTITION BY entity ORDER BY c DESC, lang) = 1),
 su AS (SELECT community, string_agg(entity, ', ' ORDER BY n DESC, entity) AS summary FROM (SELECT * FROM com QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, entity) <= 5) GROUP BY 1)"""


def _graph(spark, d):
    """mentions, relations, communities (the language that an entity is used in most)."""
    docs = table(spark, d, "documents")
    words = docs.select(F.col("doc_id").alias("chunk_id"), "lang", F.explode(F.array_distinct(tx.tokens(F.col("text"), 8))).alias("entity"))
    rare = words.groupBy("entity").agg(F.count("*").alias("n")).where("n between 3 and 30")
    mentions = materialize(words.join(rare.select("entity"), "entity").select("chunk_id", "entity", "lang"))  # every part of the graph reads them again
    pairs = mentions.select(F.col("entity").alias("source"), F.lead("entity").over(W.partitionBy("chunk_id").orderBy("entity")).alias("target")).where("target is not null")
    relations = pairs.groupBy("source", F.lit("next_to").alias("relation"), "target").agg(F.count("*").alias("weight"))
    most = mentions.where("lang is not null").groupBy("entity", "lang").agg(F.count("*").alias("c")).groupBy("entity").agg(F.min_by("lang", F.struct(-F.col("c"), "lang")).alias("community"))
    return mentions.select("chunk_id", "entity"), relations, rag.summaries(most, mentions)


_LOCAL = f"""{_BM25}, {_GRAPH}, hit AS (SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 5),
 nm AS (SELECT doc_id, list(entity ORDER BY entity) AS entities FROM men WHERE doc_id IN (SELECT doc_id FROM hit) GROUP BY 1),
 dr AS (SELECT doc_id, string_agg(chr(10) || '  ' || source || ' --[' || relation || ']--> ' || target, '' ORDER BY pos) AS drawn FROM (SELECT m.doc_id, r.*, row_number() OVER (PARTITION BY m.doc_id ORDER BY weight DESC, source, target) AS pos FROM rel r JOIN men m ON m.entity = r.source WHERE m.doc_id IN (SELECT doc_id FROM hit)) WHERE pos <= 3 GROUP BY 1),
 cx AS (SELECT doc_id, score, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS source, coalesce(entities, []) AS entities, '--- Chunk (score: ' || printf('%.3f', score) || ') ---' || chr(10) || text || CASE WHEN entities IS NOT NULL THEN chr(10) || 'Entities: ' || array_to_string(entities, ', ') ELSE '' END || coalesce(drawn, '') AS context FROM hit JOIN documents USING (doc_id) LEFT JOIN nm USING (doc_id) LEFT JOIN dr USING (doc_id)),
 lo AS (SELECT string_agg(context, chr(10) || chr(10) ORDER BY score DESC, doc_id) AS answer, list(doc_id ORDER BY score DESC, doc_id) AS sources, list_sort(list_distinct(flatten(list(entities)))) AS entities, 0 AS communities_used FROM cx)"""


def _hits(spark, d):
    """The five best documents, found once: texts, names and relations are joined to them."""
    return materialize(rk.top_k(rk.bm25(table(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score")), 5, "score", "doc_id").withColumnRenamed("doc_id", "chunk_id"))


def _local(spark, d, mentions, relations):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return rag.local_search(_hits(spark, d), chunks, mentions, relations)


@query(f"WITH {_LOCAL} SELECT doc_id AS chunk_id, score, source, entities, context FROM cx")
def kg14_chunk_contexts(spark, d):
    """Chunk, entities and three relations of each of the five best documents."""
    mentions, relations, _ = _graph(spark, d)
    return rag.contexts(_hits(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), mentions, relations)


@query(
    f"""WITH {_LOCAL}, gl AS (SELECT coalesce(string_agg('[' || i || '] ' || summary, chr(10) || chr(10) ORDER BY i), 'No relevant information found in community summaries.') AS answer FROM (SELECT summary, row_number() OVER (ORDER BY community) AS i FROM su WHERE contains(summary, 'tion') OR contains(summary, 'ung'))),
 th AS (SELECT string_agg('- ' || summary, chr(10) ORDER BY community) AS lines, count(*) AS n FROM su WHERE community IN (SELECT community FROM com WHERE list_contains((SELECT entities FROM lo), entity)))
 SELECT 'what is in the texts' AS question, 'local' AS mode, answer, sources, entities, communities_used FROM lo
 UNION ALL SELECT 'what topics are there', 'global', answer, [], [], (SELECT count(*) FROM su) FROM gl
 UNION ALL SELECT 'how do they relate', 'drift', 'Specific details:' || chr(10) || answer || chr(10) || chr(10) || 'Broader themes:' || chr(10) || coalesce(lines, ''), sources, entities, n FROM lo, th"""
)
def kg13_three_modes(spark, d):
    """Three questions, each answered in the mode that its words choose."""
    mentions, relations, communities = _graph(spark, d)
    local, communities = materialize(_local(spark, d, mentions, relations)), materialize(communities)  # two of the modes read each
    answers = {"local": local, "global": rag.global_search(["tion", "ung"], communities), "drift": rag.drift_search(local, communities)}
    out = None
    for question in ("what is in the texts", "what topics are there", "how do they relate"):
        mode = spark.range(1).select(rag.mode_of(F.lit(question)).alias("m")).first()["m"]
        part = answers[mode].select(F.lit(question).alias("question"), F.lit(mode).alias("mode"), "answer", "sources", "entities", "communities_used")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_GRAPH}, me AS (SELECT community, entity, row_number() OVER (PARTITION BY community ORDER BY entity) AS pos FROM com),
 el AS (SELECT community, string_agg('- ' || entity || ' (word): ' || CASE WHEN length(entity) > 12 THEN 'long' ELSE 'no desc' END, chr(10) ORDER BY pos) AS entity_lines FROM me WHERE pos <= 15 GROUP BY 1),
 en AS (SELECT source AS head, * FROM rel UNION ALL SELECT target, * FROM rel WHERE source <> target),
 dr AS (SELECT community, pos, row_number() OVER (PARTITION BY community, pos ORDER BY weight DESC, source, target) AS e, '- ' || source || ' --[' || relation || ']--> ' || target AS line FROM me JOIN en ON head = entity WHERE pos <= 8),
 di AS (SELECT community, line, min((pos, e)) AS o FROM dr WHERE e <= 3 GROUP BY 1, 2), li AS (SELECT community, string_agg(line, chr(10) ORDER BY o) AS relation_lines FROM (SELECT * FROM di QUALIFY row_number() OVER (PARTITION BY community ORDER BY o) <= 10) GROUP BY 1)
 SELECT community, entity_lines, coalesce(relation_lines, '') AS relation_lines FROM el LEFT JOIN li USING (community)"""
)
def kg12_community_context(spark, d):
    """What each community's summary is written from."""
    _, relations, communities = _graph(spark, d)
    members = communities.select("community", "entity", F.lit("word").alias("type"), F.when(F.length("entity") > 12, "long").alias("description"))
    return rag.community_context(members, relations)


@query(
    r"""WITH q AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*'')', 1)) AS q FROM pages), h AS (SELECT page_id, trim(substr(q, 2, length(q) - 2)) AS href FROM q), l AS (SELECT DISTINCT page_id, 'p' || page_id % 50 AS source, CASE WHEN regexp_matches(href, '^/[a-m]') THEN 'blog:' || substr(href, 2) WHEN regexp_matches(href, '^/[n-s]') THEN substr(href, 2) WHEN contains(href, 'github.com/') THEN 'github:' || href ELSE 'site:' || href END AS target FROM h WHERE href <> ''),
 k AS (SELECT DISTINCT 'nd' AS name UNION SELECT 'of' UNION SELECT 'p7'), g AS (SELECT source, target, count(DISTINCT page_id) AS chunks FROM l GROUP BY 1, 2), e AS (SELECT * FROM g WHERE regexp_matches(target, '^(blog|github|site):') OR lower(target) IN (SELECT name FROM k)), n AS (SELECT DISTINCT target AS name, CASE WHEN starts_with(target, 'blog:') THEN 'document' WHEN starts_with(target, 'github:') THEN 'repository' ELSE 'website' END AS type FROM e WHERE regexp_matches(target, '^(blog|github|site):') UNION SELECT DISTINCT source, 'concept' FROM e WHERE lower(source) NOT IN (SELECT name FROM k))
 SELECT 'edge' AS what, 'e_' || regexp_replace(lower(source), '[^a-z0-9]', '_', 'g') AS id, 'e_' || regexp_replace(lower(target), '[^a-z0-9]', '_', 'g') AS other, 'references' AS kind, chunks FROM e UNION ALL SELECT 'entity', 'e_' || regexp_replace(lower(name), '[^a-z0-9]', '_', 'g'), name, type, NULL FROM n"""
)
def kg6_link_edges(spark, d):
    """Edges from links, with the entities that they bring about."""
    links = gr.link_relations(table(spark, d, "pages")).where("href <> ''")
    name = F.substring("href", F.lit(2), F.length("href"))
    target = F.when(F.col("href").rlike("^/[a-m]"), F.concat(F.lit("blog:"), name)).when(F.col("href").rlike("^/[n-s]"), name).when(F.contains("href", F.lit("github.com/")), F.concat(F.lit("github:"), "href")).otherwise(F.concat(F.lit("site:"), "href"))
    rows = links.select(F.col("page_id").alias("chunk_id"), F.concat(F.lit("p"), (F.col("page_id") % 50).cast("string")).alias("source"), target.alias("target"), F.lit("references").alias("relation"))
    edges, new = rag.link_edges(rows, spark.createDataFrame([("nd",), ("of",), ("p7",)], "name string"))
    return edges.select(F.lit("edge").alias("what"), F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.col("relation").alias("kind"), "chunks").union(new.select(F.lit("entity"), "entity_id", "name", "type", F.lit(None).cast("long")))


_ANSWERS = "an AS (SELECT p_partkey AS chunk_id, '- ' || p_name || ' | ' || upper(p_brand) || ' | ' || p_type || chr(10) || '{\"name\": \"' || p_name || '\", \"type\": \"Tool\", \"desc\": \"' || p_name || '\"}' || chr(10) || 'no row' || chr(10) || 'x | y' AS text FROM part)"


@query(rf"WITH {_ANSWERS}, l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM an), r AS (SELECT chunk_id, n, starts_with(line, '{{') AS js, line, string_split(line, '|') AS p FROM l) SELECT chunk_id, n, CASE WHEN js THEN line->>'$.name' ELSE regexp_replace(trim(p[1]), '^[-* ]+', '') END AS name, lower(CASE WHEN js THEN line->>'$.type' ELSE trim(p[2]) END) AS type, CASE WHEN js THEN line->>'$.desc' ELSE trim(p[3]) END AS description FROM r WHERE (js OR len(p) >= 2) AND length(CASE WHEN js THEN line->>'$.name' ELSE regexp_replace(trim(p[1]), '^[-* ]+', '') END) BETWEEN 2 AND 100")
def kg8_parse_entities(spark, d):
    """Entities from a model's answers: rows with bars and JSON lines."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("- "), "p_name", F.lit(" | "), F.upper("p_brand"), F.lit(" | "), "p_type", F.lit('\n{"name": "'), "p_name", F.lit('", "type": "Tool", "desc": "'), "p_name", F.lit('"}\nno row\nx | y'))
    return rag.parse_rows(p.select(F.col("p_partkey").alias("chunk_id"), text.alias("text")))


@query("WITH a AS (SELECT p_partkey AS chunk_id, p_brand AS source, lower(string_split(p_type, ' ')[1]) AS type, string_split(p_type, ' ')[-1] AS target, p_type AS description FROM part) SELECT source, type, target, arg_min(description, chunk_id) AS description, count(DISTINCT chunk_id) AS chunks FROM a GROUP BY 1, 2, 3")
def kg8_parse_relations(spark, d):
    """Relations from a model's answers, the same ones together."""
    text = F.concat(F.lit("* "), "p_brand", F.lit(" | "), F.element_at(F.split("p_type", " "), 1), F.lit(" | "), F.element_at(F.split("p_type", " "), -1), F.lit(" | "), "p_type", F.lit("\nno | row"))
    return rag.parse_relations(table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), text.alias("text")))


@query("WITH s AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN 'high_idf' END, CASE WHEN p_size % 3 = 0 THEN 'heading' END, CASE WHEN p_size % 5 = 0 THEN 'inline_code' END], lambda x: x IS NOT NULL) AS s FROM part) SELECT p_partkey, CASE WHEN list_contains(s, 'inline_code') THEN 'code' WHEN list_contains(s, 'heading') THEN 'concept' WHEN list_contains(s, 'high_idf') THEN 'technology' END AS type FROM s")
def kg4_types_by_signals(spark, d):
    """Types of entities by their signals."""
    size = F.col("p_size")
    signals = F.array_compact(F.array(F.when(size % 2 == 0, "high_idf"), F.when(size % 3 == 0, "heading"), F.when(size % 5 == 0, "inline_code")))
    return table(spark, d, "part").select("p_partkey", rag.signal_type(signals).alias("type"))


@query()
def kg10_louvain(spark, d):
    """Communities of suppliers and parts by modularity."""
    from .graph_queries import _edges

    return cm.louvain(materialize(gr.undirected(_edges(spark, d), weight=None)))


@query()
def p3_graph_pipeline(spark, d):
    """Documents to entity candidates, co-occurrences, communities and their summaries: community, size, summary."""
    communities = rag.graph_index(table(spark, d, "documents"))[3]
    return communities.groupBy("community", "summary").agg(F.count("*").alias("size"))


@query()
def kg13_question_answers(spark, d):
    """Questions answered by their own words over the documents' graph, one in each mode."""
    index = rag.graph_index(table(spark, d, "documents"))
    out = None
    for question in ("What is edoution of the verein?", "Give an overview of threlyes, édoution and ciónción", "How does edoution relate to ciónción?"):
        row = rag.ask(question, index)
        out = row if out is None else out.unionByName(row)
    return out
