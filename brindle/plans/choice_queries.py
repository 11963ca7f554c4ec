"""Searches by vector type, choices of segments and sentences, and claims that say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as cl
from ..operators import multivector as mv
from ..operators import prefilter as pf
from ..operators import sections as sc
from .registry import oracle_text, query, table
from .retrieval import QUERY, _Q
from .section_queries import _markdown, x10_x11_typed_segments

_COLOUR, _PHASH = "c81e728d9d4c2f636f067f89cc14862c", "eccbc87e4b5ce2fe"  # md5 of 2; of 3, its first half
_ENTRIES = "en AS (SELECT vec_id AS doc_id, 'text' AS type, embedding::DOUBLE[] AS vector, NULL AS hash FROM embeddings UNION ALL SELECT vec_id, 'image', list_reverse(embedding::DOUBLE[]), NULL FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 'color_hash', NULL, md5(label::VARCHAR) FROM embeddings UNION ALL SELECT vec_id, 'perceptual_hash', NULL, substr(md5(label::VARCHAR), 1, 14) || lpad((vec_id % 100)::VARCHAR, 2, '0') FROM embeddings)"


def _entries(spark, d):
    e = table(spark, d, "embeddings")
    v, i = F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id").alias("doc_id")
    none, no_hash = F.lit(None).cast("array<double>"), F.lit(None).cast("string")
    digest = F.md5(F.col("label").cast("string").cast("binary"))
    near = F.concat(F.substring(digest, 1, 14), F.lpad((F.col("vec_id") % 100).cast("string"), 2, "0"))
    parts = [e.select(i, F.lit("text").alias("type"), v.alias("vector"), no_hash.alias("hash")), e.where("vec_id % 2 = 0").select(i, F.lit("image"), F.reverse(v), no_hash), e.select(i, F.lit("color_hash"), none, digest), e.select(i, F.lit("perceptual_hash"), none, near)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _scores(kind, k, threshold):
    if kind == "color_hash":
        return f"SELECT 'color_hash' AS type, doc_id, 1.0 AS score FROM en WHERE type = 'color_hash' AND hash = '{_COLOUR}' ORDER BY doc_id LIMIT {k}"
    if kind == "perceptual_hash":
        same = f"len(list_filter(range(1, 17), lambda i: hash[i] = '{_PHASH}'[i]))"
        return f"SELECT 'perceptual_hash' AS type, doc_id, {same} / 16 AS score FROM en WHERE type = 'perceptual_hash' AND {same} / 16 >= 0.85 ORDER BY score DESC, doc_id LIMIT {k}"
    return f"SELECT '{kind}' AS type, doc_id, list_cosine_similarity(vector, {_Q}) AS score FROM en WHERE type = '{kind}' AND vector IS NOT NULL AND list_cosine_similarity(vector, {_Q}) >= {threshold} ORDER BY score DESC, doc_id LIMIT {k}"


_ALL = " UNION ALL ".join(f"SELECT * FROM ({_scores(t, 10, 0.2)})" for t in ("image", "text", "color_hash", "perceptual_hash"))
_QUERIES = {"image": QUERY, "text": QUERY, "color_hash": _COLOUR, "perceptual_hash": _PHASH}


@query(f"WITH {_ENTRIES} SELECT type, doc_id, round(score::DOUBLE, 6) AS score FROM ({_ALL})")
def r12_search_by_type(spark, d):
    """Ten best of each vector type: cosine, equal hashes, alike hashes."""
    entries, out = _entries(spark, d), None
    for kind, q in _QUERIES.items():
        part = mv.search_type(entries, kind, q, 10, 0.2).select(F.lit(kind).alias("type"), "doc_id", F.round(F.col("score").cast("double"), 6).alias("score"))
        out = part if out is None else out.union(part)
    return out


@query(
    f"""WITH {_ENTRIES}, h AS (SELECT event_type AS intent, ['image', 'text', 'color_hash', 'perceptual_hash'][event_id % 4 + 1] AS type, (event_id % 17) / 17 AS score, event_id % 3 AS results FROM events),
 rec AS (SELECT type FROM h WHERE intent = (SELECT min(event_type) FROM events) GROUP BY type ORDER BY avg(score) * avg((results > 0)::INT) DESC, list_position(['image', 'text', 'face', 'color_hash', 'perceptual_hash'], type) LIMIT 1),
 a AS ({_ALL}), st AS (SELECT type, count(*) AS n, avg(score) AS mean FROM a GROUP BY 1), r AS (SELECT rec.type, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean FROM rec LEFT JOIN st USING (type)),
 pick AS (SELECT CASE WHEN n >= 5 AND mean >= 0.2 THEN r.type ELSE coalesce((SELECT type FROM st WHERE st.type <> r.type AND st.mean > r.mean ORDER BY st.mean DESC, list_position(['image', 'text', 'face', 'color_hash', 'perceptual_hash'], st.type) LIMIT 1), r.type) END AS type FROM r)
 SELECT type, doc_id, round(score::DOUBLE, 6) AS score FROM a WHERE type = (SELECT type FROM pick)"""
)
def r13_adaptive_search(spark, d):
    """The type that did best for the intent, or a better one if its results are few or poor."""
    ev = table(spark, d, "events")
    kinds = F.array(*[F.lit(t) for t in ("image", "text", "color_hash", "perceptual_hash")])
    history = ev.select(F.col("event_type").alias("intent"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("type"), ((F.col("event_id") % 17) / 17).alias("score"), (F.col("event_id") % 3).alias("results"))
    intent = ev.agg(F.min("event_type")).first()[0]
    found = mv.search_adaptive(_entries(spark, d), _QUERIES, history, intent, 10, 0.2)
    return found.select("type", "doc_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query()
def r15_mmr_sentences(spark, d):
    """Marginal relevance to each label's target, in rounds over all labels at once."""
    e = table(spark, d, "embeddings").where("embedding is not null").withColumn("w", F.when(F.col("vec_id") % 5 == 0, 1.2).otherwise(1.0))
    return mv.mmr_top(e, "label", "vec_id", "embedding", "w")


_STOP = "[" + ", ".join(f"'{w}'" for w in mv.STOP) + "]"


@query(
    rf"""WITH seg AS ({oracle_text(x10_x11_typed_segments)}), pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, heading, type ORDER BY n) AS f, row_number() OVER (PARTITION BY doc_id, heading, type ORDER BY n DESC) AS l, row_number() OVER (PARTITION BY doc_id, type ORDER BY n) AS q FROM seg),
 rs AS (SELECT *, CASE WHEN type = 'heading' AND length(text) < 100 AND level <= 3 THEN 'heading' WHEN type = 'sentence' AND heading <> '' AND f = 1 THEN 'first' WHEN type = 'sentence' AND heading <> '' AND l = 1 THEN 'last' WHEN type = 'sentence' AND regexp_matches(text, '{mv.BINDING}') THEN 'binding' WHEN type = 'quote' AND q <= 5 THEN 'quote' WHEN type = 'code' AND heading <> '' AND f = 1 THEN 'code' END AS reason FROM pl),
 wo AS (SELECT doc_id, n, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))) AS term FROM seg), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM wo GROUP BY ALL),
 sz AS (SELECT doc_id, count(*) AS segments, count(DISTINCT heading) AS sections FROM seg GROUP BY 1), pt AS (SELECT doc_id, term, sum(tf) AS tf, count(*) AS df FROM tf GROUP BY 1, 2),
 qu AS (SELECT doc_id, term, round(pt.tf * ln(segments / (df + 1)), 9) AS weight FROM pt JOIN sz USING (doc_id) WHERE df < 0.8 * segments QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 30),
 sco AS (SELECT doc_id, n, round(sum(weight), 6) AS score FROM tf JOIN qu USING (doc_id, term) GROUP BY 1, 2),
 al AS (SELECT doc_id, n, heading, reason, coalesce(score, 0) AS score, sections, row_number() OVER (PARTITION BY doc_id, heading ORDER BY coalesce(score, 0) DESC, n) AS inside FROM rs JOIN sz USING (doc_id) LEFT JOIN sco USING (doc_id, n)),
 he AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reason IS NULL, score DESC, n) AS place FROM al WHERE reason IS NOT NULL OR inside <= greatest(10, floor(12 / greatest(sections, 1))))
 SELECT doc_id, n, coalesce(reason, 'score') AS reason FROM he WHERE reason IS NOT NULL OR place <= 12"""
)
def r17_prefilter(spark, d):
    """Segments that may not go, and the best of the rest by a pseudo-query, twelve a document."""
    return mv.prefilter(sc.segments(_markdown(spark, d)), 12)


@query()
def r17_semantic_prefilter(spark, d):
    """Guaranteed and sampled segments of the Markdown documents, then the best by BM25 in each section, then the most alike: sixty a document."""
    return pf.semantic_prefilter(sc.segments(_markdown(spark, d)), 60, 30)


_CLAIMS = "va AS (SELECT item_id * 3 + v AS claim_id, CASE v WHEN 0 THEN text WHEN 1 THEN substr(text, 1, greatest(length(text) - 40, 1)) ELSE substr(text, 20) END AS text, 't' || (item_id % 3) AS topic, 1 + (item_id + v) % 3 AS weight, CASE v WHEN 2 THEN [item_id, item_id + 1] ELSE [item_id + v] END AS evidence FROM benchmark, range(3) r(v) WHERE text IS NOT NULL)"


def _claims(spark, d):
    b = table(spark, d, "benchmark").where("text is not null").withColumn("v", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    i, v = F.col("item_id"), F.col("v")
    text = F.when(v == 0, F.col("text")).when(v == 1, F.substring("text", F.lit(1), F.greatest(F.length("text") - 40, F.lit(1)))).otherwise(F.substring("text", F.lit(20), F.length("text")))
    return b.select((i * 3 + v).alias("claim_id"), text.alias("text"), F.concat(F.lit("t"), (i % 3).cast("string")).alias("topic"), (1 + (i + v) % 3).alias("weight"), F.when(v == 2, F.array(i, i + 1)).otherwise(F.array(i + v)).alias("evidence"))


@query(
    rf"""WITH {_CLAIMS}, pn AS (SELECT *, trim(regexp_replace(lower(text), '[^\w\s]', '', 'g')) AS p FROM va), g AS (SELECT *, list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS grams FROM pn),
 j AS (SELECT a.claim_id AS a, b.claim_id AS b, round(least(1, len(list_intersect(a.grams, b.grams)) / sqrt(len(a.grams) * len(b.grams)) + CASE WHEN a.topic = b.topic THEN 0.1 ELSE 0 END + 0.05 * len(list_intersect(a.evidence, b.evidence))), 9) AS similarity FROM g a JOIN g b ON a.claim_id < b.claim_id WHERE len(a.grams) > 0 AND len(b.grams) > 0)
 SELECT a, b, similarity FROM j WHERE similarity >= 0.75"""
)
def sd9_similar_claims(spark, d):
    """Pairs of claims that say the same, by bigrams, topic and shared evidence."""
    return cl.similar_claims(_claims(spark, d))


@query()
def sd9_claim_dedup(spark, d):
    """Clusters of claims around leaders, with the best claim and all evidence."""
    return cl.deduplicated(_claims(spark, d))
