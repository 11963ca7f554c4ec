"""Structured map-reduce over conversations: a conversation is a document, its turns are chunks.

Long words are entities, known also by their first eight letters; sentences are facts
(each third one denied), and the very long words of a turn, in their order, are a flow.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import structured as st
from .registry import query, table

_LONG = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+')"
_MAPPED = rf"""tw AS (SELECT conv_id, turn, text, coalesce(role, '') || ' ' || (turn % 3) AS heading, {_LONG} AS w FROM conversations),
 ew AS (SELECT conv_id, turn, unnest(list_filter(w, lambda x: length(x) >= 9)) AS name, generate_subscripts(list_filter(w, lambda x: length(x) >= 9), 1) - 1 AS place FROM tw),
 ent AS (SELECT conv_id AS doc_id, turn AS chunk, place, name, CASE WHEN turn % 2 = 0 THEN 'Concept' ELSE 'Technology' END AS type, CASE WHEN length(name) > 11 THEN name || ' of ' || turn END AS description, substr(name, 1, 8) AS alias FROM ew),
 sw AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), '. ')) AS s, generate_subscripts(string_split(coalesce(text, ''), '. '), 1) - 1 AS place FROM tw),
 fact AS (SELECT conv_id AS doc_id, turn AS chunk, place, CASE WHEN place % 3 = 1 THEN 'not ' || s ELSE s END AS statement, length(s) % 4 AS confidence FROM sw WHERE s <> ''),
 flow AS (SELECT conv_id AS doc_id, turn AS chunk, 0 AS place, list_filter(w, lambda x: length(x) >= 12) AS steps, 'Workflow' AS type FROM tw WHERE len(list_filter(w, lambda x: length(x) >= 12)) >= 2)"""
_STITCHED = """link AS (SELECT DISTINCT doc_id, name AS a, alias AS b FROM ent WHERE name <> alias),
 both_ways AS (SELECT * FROM link UNION SELECT doc_id, b, a FROM link),
 reach AS (SELECT doc_id, a AS node, a AS other FROM both_ways UNION SELECT r.doc_id, r.node, e.b FROM reach r JOIN both_ways e ON e.doc_id = r.doc_id AND e.a = r.other),
 root AS (SELECT doc_id, node, min(other) AS root FROM reach GROUP BY 1, 2),
 pl AS (SELECT e.*, coalesce(r.root, e.name) AS root FROM ent e LEFT JOIN root r ON r.doc_id = e.doc_id AND r.node = e.name),
 mg AS (SELECT doc_id, root, arg_min(name, (chunk, place)) AS name, arg_min(type, (chunk, place)) AS type, list_sort(list_distinct(list(chunk))) AS chunks, list_distinct(list_concat(list(name), list(alias))) AS names,
   arg_min(description, (-length(description), chunk, place)) FILTER (description IS NOT NULL) AS description, list_sort(list_distinct(list(type))) AS types FROM pl GROUP BY 1, 2),
 st AS (SELECT doc_id, name, type, chunks, list_sort(list_filter(names, lambda n: n <> name)) AS aliases, description, types FROM mg)"""
_SIGNS = ", ".join(f"contains(lower(statement), '{p.replace(chr(39), chr(39) * 2)}')" for p in st.NEGATIONS)
_CONFLICTS = rf"""fs AS (SELECT doc_id, chunk, place, [{_SIGNS}] AS signs, list_distinct(list_filter(regexp_split_to_array(lower(statement), '[^\p{{L}}\p{{Nd}}_]+'), lambda w: length(w) > 4)) AS words FROM fact),
 cf AS (SELECT a.doc_id, a.chunk AS chunk_a, a.place AS place_a, b.chunk AS chunk_b, b.place AS place_b FROM fs a JOIN fs b ON a.doc_id = b.doc_id AND a.chunk < b.chunk AND a.signs <> b.signs AND len(list_intersect(a.words, b.words)) >= 2)"""


def _mapped(spark, d):
    """chunks, entities, facts, flows of the conversations."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "text", F.concat(F.coalesce("role", F.lit("")), F.lit(" "), (F.col("turn") % 3).cast("string")).alias("heading"), tx.tokens(F.col("text")).alias("w"))
    name = F.col("name")
    each = c.select("doc_id", "chunk", F.posexplode(F.filter("w", lambda x: F.length(x) >= 9)).alias("place", "name"))
    entities = each.select("doc_id", "chunk", "place", "name", F.when(F.col("chunk") % 2 == 0, "Concept").otherwise("Technology").alias("type"), F.when(F.length(name) > 11, F.concat(name, F.lit(" of "), F.col("chunk").cast("string"))).alias("description"), F.array(F.substring(name, 1, 8)).alias("aliases"))
    facts = c.select("doc_id", "chunk", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ", -1)).alias("place", "statement")).where("statement <> ''").withColumn("confidence", F.length("statement") % 4)
    facts = facts.withColumn("statement", F.when(F.col("place") % 3 == 1, F.concat(F.lit("not "), "statement")).otherwise(F.col("statement")))
    steps = F.filter("w", lambda x: F.length(x) >= 12)
    flows = c.where(F.size(steps) >= 2).select("doc_id", "chunk", F.lit(0).alias("place"), steps.alias("steps"), F.lit("Workflow").alias("type"))
    return c.select("doc_id", "chunk", "heading"), entities, facts, flows


@query(f"WITH RECURSIVE {_MAPPED}, {_STITCHED} SELECT * FROM st")
def a13_stitched_entities(spark, d):
    """Entities of each conversation, those that names and aliases connect together."""
    return st.stitched(_mapped(spark, d)[1])


@query(f"WITH RECURSIVE {_MAPPED}, {_STITCHED} SELECT doc_id, name, chunks, 'Conflicting types: ' || array_to_string(types, ', ') AS reason FROM st WHERE len(types) > 1")
def a14_type_collisions(spark, d):
    """Entities that are given several types."""
    return st.collisions(st.stitched(_mapped(spark, d)[1]))


@query(f"WITH {_MAPPED}, {_CONFLICTS} SELECT * FROM cf")
def x26_denied_statements(spark, d):
    """Sentences of different turns, one of which denies what the other does not."""
    return st.conflicts(_mapped(spark, d)[2]).select("doc_id", F.col("a.chunk").alias("chunk_a"), F.col("a.place").alias("place_a"), F.col("b.chunk").alias("chunk_b"), F.col("b.place").alias("place_b"))


@query(
    f"""WITH RECURSIVE {_MAPPED}, {_STITCHED}, {_CONFLICTS},
 co AS (SELECT doc_id, count(*) AS entities, count(*) FILTER (len(types) > 1) AS collisions FROM st GROUP BY 1), su AS (SELECT doc_id, count(*) AS facts, count(*) FILTER (confidence = 3) AS sure FROM fact GROUP BY 1), ag AS (SELECT doc_id, count(*) AS conflicts FROM cf GROUP BY 1),
 hd AS (SELECT conv_id AS doc_id, heading, (conv_id, turn) IN (SELECT (doc_id, chunk) FROM ent) OR (conv_id, turn) IN (SELECT (doc_id, chunk) FROM fact) AS direct, (conv_id, turn) IN (SELECT (doc_id, chunk) FROM flow) AS flows FROM tw WHERE trim(heading) <> ''),
 cv AS (SELECT doc_id, count(DISTINCT heading) FILTER (direct) AS di, count(DISTINCT heading) FILTER (NOT direct AND flows) AS inf, count(DISTINCT heading) FILTER (NOT direct AND NOT flows) AS un FROM hd GROUP BY 1),
 fl AS (SELECT doc_id, list('- ' || statement || ' [' || chunk || '] (confidence: ' || ['Uncertain', 'Low', 'Medium', 'High'][confidence + 1] || ')' ORDER BY i) AS fact_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, chunk, place) AS i FROM fact WHERE confidence >= 2) WHERE i <= 15 GROUP BY 1),
 el AS (SELECT doc_id, list('- ' || name || ' (' || type || '): ' || coalesce(description, 'no description') ORDER BY i) AS entity_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(chunks) DESC, name) AS i FROM st) WHERE i <= 10 GROUP BY 1),
 wl AS (SELECT doc_id, list('- ' || array_to_string(steps, ' -> ') || ' (' || type || ')' ORDER BY i) AS flow_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk, place) AS i FROM flow) WHERE i <= 5 GROUP BY 1),
 al AS (SELECT d.doc_id, coalesce(entities, 0) AS entities, coalesce(collisions, 0) AS collisions, coalesce(facts, 0) AS facts, coalesce(sure, 0) AS sure, coalesce(conflicts, 0) AS conflicts, coalesce((di + inf * 0.5) / (di + inf + un), 0) AS coverage, coalesce(fact_lines, []) AS fact_lines, coalesce(entity_lines, []) AS entity_lines, coalesce(flow_lines, []) AS flow_lines
   FROM (SELECT DISTINCT conv_id AS doc_id FROM tw) d LEFT JOIN co USING (doc_id) LEFT JOIN su USING (doc_id) LEFT JOIN ag USING (doc_id) LEFT JOIN cv USING (doc_id) LEFT JOIN fl USING (doc_id) LEFT JOIN el USING (doc_id) LEFT JOIN wl USING (doc_id)),
 sc AS (SELECT *, sure / nullif(facts, 0) - least(conflicts * 0.1, 0.3) + coverage * 0.2 AS s FROM al)
 SELECT * EXCLUDE (s), CASE WHEN facts = 0 THEN 'Low' WHEN s >= 0.7 THEN 'High' WHEN s >= 0.4 THEN 'Medium' WHEN s >= 0.2 THEN 'Low' ELSE 'Uncertain' END AS confidence FROM sc"""
)
def p2_structured_report(spark, d):
    """Map, stitch, reduce: a report on each conversation."""
    return st.report(*_mapped(spark, d))
