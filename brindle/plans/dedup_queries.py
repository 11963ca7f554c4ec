"""Duplicate detection over documents, parts and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup as dd
from .registry import query, table


def _hashes(spark, d):
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0.05, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return table(spark, d, "embeddings").select("vec_id", bits.alias("h"))


@query(r"WITH h AS (SELECT doc_id, substr(sha256(lower(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')))), 1, 16) AS hash FROM documents) SELECT hash, min(doc_id) AS keeper, count(*) AS copies FROM h GROUP BY 1 HAVING copies > 1")
def sd6_exact_duplicates(spark, d):
    return dd.exact_groups(table(spark, d, "documents"), "doc_id", "text")


@query("WITH v AS (SELECT vec_id AS k, list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0.05 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END), lambda x, y: x + y) AS h FROM embeddings), g AS (SELECT min(k) AS k, h FROM v GROUP BY h) SELECT a.k AS a, b.k AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM g a JOIN g b ON a.k < b.k WHERE bit_count(xor(a.h, b.h)) <= 12")
def sd7_hamming_pairs(spark, d):
    """Links between the representatives of equal hashes; sd7_hamming_members has who stands behind them."""
    return dd.hamming_pairs(_hashes(spark, d), "vec_id", "h", 12)


@query("WITH v AS (SELECT vec_id, list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0.05 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END), lambda x, y: x + y) AS h FROM embeddings), g AS (SELECT min(vec_id) AS representative, h FROM v GROUP BY h) SELECT vec_id, representative FROM v JOIN g USING (h)")
def sd7_hamming_members(spark, d):
    return dd.hamming_members(_hashes(spark, d), "vec_id", "h")


@query()
def sd7_sd8_leaders(spark, d):
    return dd.hamming_leaders(_hashes(spark, d), "vec_id", "h", 12)


@query("WITH n AS (SELECT min(p_partkey) AS k, lower(p_name) AS s FROM part GROUP BY lower(p_name)) SELECT a.k AS a, b.k AS b, round(1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) AS similarity FROM n a JOIN n b ON a.k < b.k WHERE 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) >= 0.75")
def sd8_sd12_similar_names(spark, d):
    names = table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    return dd.similar_names(names, "k", "name", 0.75).withColumn("similarity", F.round("similarity", 6))


@query("WITH g AS (SELECT source, n_chars, row_number() OVER (PARTITION BY substr(sha256(text), 1, 16) ORDER BY doc_id) AS n, doc_id FROM documents) SELECT doc_id, CASE WHEN n = 1 THEN 'keep' ELSE 'duplicate' END AS action FROM g")
def sd15_dedup_actions(spark, d):
    """The first of each group stays; groups meet as minima only."""
    docs = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").select("doc_id", F.when(F.col("doc_id") == F.col("first"), "keep").otherwise("duplicate").alias("action"))


@query("WITH g AS (SELECT substr(sha256(text), 1, 16) AS h, count(*) AS n, sum(n_chars) AS s, min(n_chars) AS m FROM documents GROUP BY 1 HAVING n > 1) SELECT count(*) AS groups, sum(n - 1)::BIGINT AS duplicates, sum(s - m)::BIGINT AS wasted FROM g")
def a21_dedup_summary(spark, d):
    g = table(spark, d, "documents").groupBy(tx.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"), F.min("n_chars").alias("m")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum(F.col("s") - F.col("m")).alias("wasted"))


@query(r"WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM w) SELECT conv_id, turn, round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 6) AS jaccard FROM p WHERE v IS NOT NULL AND len(w) + len(v) > 0")
def sd4_jaccard(spark, d):
    """Word-set similarity of neighbouring turns."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(tx.tokens(F.col("text"), 1)).alias("w"))
    p = w.withColumn("v", F.lag("w").over(W.partitionBy("conv_id").orderBy("turn"))).where("v is not null and size(w) + size(v) > 0")
    return p.select("conv_id", "turn", F.round(tx.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))
