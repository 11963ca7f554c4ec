"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..operators import blocks as bl
from ..operators import rank as rk
from .registry import query, table

TERMS = ["the", "ing", "der", "inthe"]
#: A fixed query vector of 64 places.
QUERY = [((7 * i) % 13 - 6) / 10 for i in range(64)]
_Q = "[" + ",".join(f"{v!r}::DOUBLE" for v in QUERY) + "]"
_WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+'), lambda x: length(x) > 1)"
_BM25 = f"""w AS (SELECT doc_id, n_chars, {_WORDS} AS words FROM documents),
 n AS (SELECT count(*) AS total, avg(len(words)) AS mean FROM w),
 q AS (SELECT unnest({TERMS}) AS term),
 tf AS (SELECT doc_id, len(words) AS n, term, len(list_filter(words, lambda x: x = term)) AS tf FROM w, q),
 df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
 bm AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln((total - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) ELSE 0 END) AS score FROM tf JOIN df USING (term), n GROUP BY doc_id HAVING score > 0)"""
_DENSE = f"de AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS similarity FROM embeddings WHERE embedding IS NOT NULL)"


def _bm25(spark, d):
    return rk.bm25(table(spark, d, "documents"), TERMS)


def _dense(spark, d):
    return rk.cosine_scores(table(spark, d, "embeddings"), QUERY)


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def r1_bm25_topk(spark, d):
    scored = _bm25(spark, d).select("doc_id", F.round("score", 6).alias("score"))
    return rk.top_k(scored, 20, "score", "doc_id")


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def r2_bm25_all(spark, d):
    return _bm25(spark, d).select("doc_id", F.round("score", 6).alias("score"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \n.,;:!?()]+'), lambda x: length(x) > 2 AND NOT list_contains(['the','and','for','with','der','die','und'], x))) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), ln AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1), a AS (SELECT avg(n) AS mean FROM ln), c AS (SELECT count(*) AS total FROM documents),
 df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ('that','tion','dass') GROUP BY 1)
 SELECT doc_id, round(sum(ln((total - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN ln USING (doc_id), a, c GROUP BY 1"""
)
def r3_simple_bm25(spark, d):
    stop = ["the", "and", "for", "with", "der", "die", "und"]
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.filter(F.split(F.lower("text"), "[ \n.,;:!?()]+"), lambda x: (F.length(x) > 2) & ~x.isin(stop)).alias("words"))
    terms = ["that", "tion", "dass"]
    counted = words.select("doc_id", F.size("words").alias("n"), *[rk.count_of("words", t).alias(t) for t in terms])
    stats = counted.agg(F.count("*").alias("total"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean"), *[F.count_if(F.col(t) > 0).alias("df_" + t) for t in terms])
    both = counted.crossJoin(F.broadcast(stats))
    parts = [F.when(F.col(t) > 0, F.log((F.col("total") - F.col("df_" + t) + 0.5) / (F.col("df_" + t) + 0.5) + 1) * F.col(t) * 2.5 / (F.col(t) + 1.5 * (0.25 + 0.75 * F.col("n") / F.col("mean")))).otherwise(0.0) for t in terms]
    return both.select("doc_id", F.round(sum(parts, F.lit(0.0)), 6).alias("score")).where("score > 0")


_RRF3 = f"""WITH {_BM25}, {_DENSE}, sa AS (SELECT doc_id, least(n_chars / 2000, 1) AS salience FROM documents),
 l AS (SELECT vec_id AS doc_id, 1 / (60 + row_number() OVER (ORDER BY similarity DESC, vec_id)) AS p FROM de UNION ALL SELECT doc_id, 1 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM bm UNION ALL SELECT doc_id, 1 / (60 + row_number() OVER (ORDER BY salience DESC, doc_id)) FROM sa)
 SELECT doc_id, round(sum(p), 6) AS rrf_score FROM l GROUP BY doc_id ORDER BY rrf_score DESC, doc_id LIMIT 25"""


def _three_lists(spark, d):
    dense = _dense(spark, d).select(F.col("vec_id").alias("doc_id"), "similarity")
    salience = table(spark, d, "documents").select("doc_id", F.least(F.col("n_chars") / 2000, F.lit(1.0)).alias("salience"))
    return dense, _bm25(spark, d), salience


@query(_RRF3)
def r4_hybrid_rrf(spark, d):
    dense, sparse, salience = _three_lists(spark, d)
    lists = [rk.ranked(dense, "similarity", "doc_id"), rk.ranked(sparse, "score", "doc_id"), rk.ranked(salience, "salience", "doc_id")]
    fused = rk.rrf(lists, "doc_id").select("doc_id", F.round("rrf_score", 6).alias("rrf_score"))
    return rk.top_k(fused, 25, "rrf_score", "doc_id")


@query(
    f"""WITH {_BM25}, {_DENSE}, d20 AS (SELECT vec_id AS doc_id, similarity FROM de ORDER BY similarity DESC, vec_id LIMIT 20), b20 AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20),
 l AS (SELECT doc_id, 1 / (60 + row_number() OVER (ORDER BY similarity DESC, doc_id)) AS p FROM d20 UNION ALL SELECT doc_id, 1 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM b20)
 SELECT doc_id, round(sum(p), 6) AS rrf_score FROM l GROUP BY 1 ORDER BY rrf_score DESC, doc_id LIMIT 10"""
)
def r5_graph_hybrid(spark, d):
    dense = rk.top_k(_dense(spark, d), 20, "similarity", "vec_id").select(F.col("vec_id").alias("doc_id"), "similarity")
    sparse = rk.top_k(_bm25(spark, d), 20, "score", "doc_id")
    one = lambda s: W.orderBy(F.desc(s), "doc_id")  # noqa: E731  twenty rows
    lists = [dense.withColumn("rank", F.row_number().over(one("similarity"))), sparse.withColumn("rank", F.row_number().over(one("score")))]
    fused = rk.rrf(lists, "doc_id").select("doc_id", F.round("rrf_score", 6).alias("rrf_score"))
    return rk.top_k(fused, 10, "rrf_score", "doc_id")


@query(
    f"""WITH {_DENSE}, l AS (SELECT vec_id, 1 / (60 + row_number() OVER (ORDER BY similarity DESC, vec_id)) AS p FROM de UNION ALL SELECT vec_id, 1 / (60 + row_number() OVER (ORDER BY label DESC, vec_id)) FROM embeddings)
 SELECT vec_id, round(sum(p), 6) AS rrf_score FROM l GROUP BY 1 ORDER BY rrf_score DESC, vec_id LIMIT 25"""
)
def r6_two_list_rrf(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null")
    lists = [rk.ranked(_dense(spark, d), "similarity", "vec_id"), rk.ranked(e.select("vec_id", F.col("label").cast("double").alias("salience")), "salience", "vec_id")]
    return rk.top_k(rk.rrf(lists, "vec_id").select("vec_id", F.round("rrf_score", 6).alias("rrf_score")), 25, "rrf_score", "vec_id")


@query(f"WITH {_DENSE} SELECT vec_id, round(0.6 * similarity + 0.4 * label / 10, 6) AS score FROM de JOIN embeddings USING (vec_id) WHERE similarity >= 0.05 ORDER BY score DESC, vec_id LIMIT 25")
def r7_linear_blend(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null")
    scored = e.select("vec_id", vx.cosine(F.col("embedding"), vx.literal(QUERY)).alias("similarity"), (F.col("label") / 10).alias("salience"))
    return rk.top_k(rk.blended(scored, 0.6, 0.05).select("vec_id", F.round("score", 6).alias("score")), 25, "score", "vec_id")


@query(
    f"""WITH {_DENSE}, t AS (SELECT vec_id, similarity FROM de ORDER BY similarity DESC, vec_id LIMIT 15), f AS (SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM t) ORDER BY label DESC, vec_id LIMIT 5)
 SELECT vec_id, 'retrieved' AS bucket FROM t UNION ALL SELECT vec_id, 'fallback' FROM f"""
)
def r8_retrieve_with_fallback(spark, d):
    top = rk.top_k(_dense(spark, d), 15, "similarity", "vec_id").select("vec_id", F.lit("retrieved").alias("bucket"))
    rest = table(spark, d, "embeddings").join(F.broadcast(top.select("vec_id")), "vec_id", "left_anti")  # fifteen rows
    return top.union(rk.top_k(rest, 5, "label", "vec_id").select("vec_id", F.lit("fallback"))).orderBy("vec_id")


@query(f"WITH {_DENSE} SELECT vec_id, round(1 / (60 + row_number() OVER (ORDER BY similarity DESC, vec_id)), 6) AS score FROM de")
def r9_semantic_rank_score(spark, d):
    return rk.ranked(_dense(spark, d), "similarity", "vec_id").select("vec_id", F.round(1 / (60 + F.col("rank")), 6).alias("score"))


@query("SELECT doc_id, substr(concat_ws(' ', source, source, source, source, lang, lang, text), 1, 2000) AS embed_text FROM documents")
def r10_embed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.concat_ws(" ", *["source"] * 4, *["lang"] * 2, "text"), 1, 2000).alias("embed_text"))


@query(
    """WITH old AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE source <> 'src5')
 SELECT d.doc_id, old.h IS NULL OR old.h <> sha256(d.text) AS needs_reindex FROM documents d LEFT JOIN old USING (doc_id)"""
)
def r11_needs_reindex(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("source <> 'src5'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return docs.join(old, "doc_id", "left").select("doc_id", (~F.col("h").eqNullSafe(F.sha2("text", 256))).alias("needs_reindex"))


@query(f"WITH {_DENSE} SELECT vec_id, round(similarity, 6) AS similarity FROM de ORDER BY similarity DESC, vec_id LIMIT 10")
def t1_cosine_topk(spark, d):
    return rk.top_k(_dense(spark, d).select("vec_id", F.round("similarity", 6).alias("similarity")), 10, "similarity", "vec_id")


@query(f"WITH {_DENSE} SELECT vec_id, round(similarity, 6) AS similarity FROM de JOIN embeddings USING (vec_id) WHERE label = 3 ORDER BY similarity DESC, vec_id LIMIT 10")
def t2_cosine_topk_filtered(spark, d):
    scored = rk.cosine_scores(table(spark, d, "embeddings").where("label = 3"), QUERY)
    return rk.top_k(scored.select("vec_id", F.round("similarity", 6).alias("similarity")), 10, "similarity", "vec_id")


@query(
    """WITH q AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q_id, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id <> q_id)
 SELECT q_id, vec_id, similarity FROM s WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id) <= 5"""
)
def t3_related_items(spark, d):
    """Stored vectors as queries: every row whose id is divisible by 20 against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))
    found = bl.meet(bl.packed(q, "q_id", "v"), bl.packed(e, "vec_id", "embedding"), partial(bl.nearest, n=5, least=0.2), "q_id long, vec_id long, similarity double")
    scored = found.withColumn("similarity", F.round("similarity", 6)).where("similarity >= 0.2")
    return rk.per_group_top(scored, ["q_id"], "similarity", "vec_id", 5)


@query(f"WITH {_DENSE}, v AS (SELECT vec_id, similarity, CASE label % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'visual' WHEN 2 THEN 'color' ELSE 'motion' END AS vector_type FROM de JOIN embeddings USING (vec_id)) SELECT vector_type, vec_id, round(similarity, 6) AS similarity FROM v QUALIFY row_number() OVER (PARTITION BY vector_type ORDER BY similarity DESC, vec_id) <= 5")
def t4_multi_vector_search(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["text", "visual", "color", "motion"])), (F.col("label") % 4 + 1).cast("int"))
    e = table(spark, d, "embeddings").where("embedding is not null")
    scored = e.select(kind.alias("vector_type"), "vec_id", vx.cosine(F.col("embedding"), vx.literal(QUERY)).alias("similarity"))
    return rk.per_group_top(scored, ["vector_type"], "similarity", "vec_id", 5).withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, least(100, greatest(15, ceil(n * 0.05)))::INT AS k, least(100, greatest(15, ceil(ceil(n * 0.05) * 1.5)))::INT AS k_narrative, least(100, greatest(10, floor(n * 0.15)))::INT AS target FROM s"""
)
def t5_adaptive_topk(spark, d):
    n = F.col("n")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", rk.adaptive_k(n).alias("k"), rk.adaptive_k(n, narrative=True).alias("k_narrative"), rk.extraction_target(n).alias("target"))


@query("WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM p GROUP BY 1) SELECT label, i::INT AS at, round(m / n, 6) AS x FROM p JOIN n USING (label)")
def a17_centroids(spark, d):
    found = rk.centroids(table(spark, d, "embeddings"), "label")
    return found.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).alias("at"), F.round("x", 6).alias("x"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS cosine, round(list_distance(embedding::DOUBLE[], {_Q}), 6) AS euclid, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS dot, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def m1_m2_vector_math(spark, d):
    v, q = F.col("embedding"), vx.literal(QUERY)
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.cosine(v, q), 6).alias("cosine"), F.round(vx.euclidean(v, q), 6).alias("euclid"), F.round(vx.dot(v, q), 6).alias("dot"), F.round(vx.norm(v), 6).alias("norm"))


@query()
def r14_mmr_salience(spark, d):
    e = table(spark, d, "embeddings").withColumn("weight", F.when(F.col("vec_id") % 10 == 0, 1.5).otherwise(1.0))
    return rk.mmr(e, "label", "vec_id", "embedding", "weight")


@query()
def r16_topic_anchors(spark, d):
    return rk.anchors(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(f"WITH {_BM25}, r AS (SELECT doc_id, round(score, 6) AS score, source FROM bm JOIN documents USING (doc_id)) SELECT source, doc_id, score FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 3")
def w2_top_per_section(spark, d):
    scored = _bm25(spark, d).withColumn("score", F.round("score", 6)).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rk.per_group_top(scored, ["source"], "score", "doc_id", 3).select("source", "doc_id", "score")


@query(
    f"""WITH {_BM25}, t AS (SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 8) SELECT doc_id, text AS chunk FROM t JOIN documents USING (doc_id) WHERE NOT regexp_matches(lower(text), 'project gutenberg|all rights reserved|table of contents') ORDER BY score DESC, doc_id LIMIT 5"""
)
def r23_chunks_without_boilerplate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    top = rk.top_k(_bm25(spark, d).withColumn("score", F.round("score", 6)), 8, "score", "doc_id")
    found = docs.join(F.broadcast(top), "doc_id").where(~F.lower("text").rlike("project gutenberg|all rights reserved|table of contents"))
    return rk.top_k(found, 5, "score", "doc_id").select("doc_id", F.col("text").alias("chunk"))


@query("SELECT source, substr(sha256('v1_' || string_agg(substr(sha256(text), 1, 16), '_' ORDER BY substr(sha256(text), 1, 16))), 1, 32) AS cache_key FROM documents GROUP BY source")
def r25_cache_keys(spark, d):
    hashes = table(spark, d, "documents").select("source", tx.content_hash(F.col("text")).alias("h"))
    key = F.sha2(F.concat_ws("_", F.lit("v1"), F.array_sort(F.collect_list("h"))), 256)
    return hashes.groupBy("source").agg(F.substring(key, 1, 32).alias("cache_key"))


@query("WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]+')) AS words FROM documents) SELECT doc_id, words, CASE WHEN words >= 20000 THEN 'Hierarchical' WHEN words < 150 THEN 'Iterative' WHEN words < 800 THEN 'Hybrid' ELSE 'Retrieval' END AS mode FROM w")
def r26_mode_selection(spark, d):
    n = F.col("words")
    mode = F.when(n >= 20000, "Hierarchical").when(n < 150, "Iterative").when(n < 800, "Hybrid").otherwise("Retrieval")
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words")).withColumn("mode", mode)
