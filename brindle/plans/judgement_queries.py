"""Rule tables and judgements over documents, parts, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import judgement as jd
from .registry import query, table

#: Phrases that give the invented prose something to judge, by id; fixed values.
_PHRASES = ["she said and he replied: love", "function class api code json error", "abstract study findings table 3 data", "revenue budget client strategy kpi", "whereas the party shall; liability", "officials announced today in a statement", "how to: step 1, see also the guide", ""]


def _sql_list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _type_sql():
    parts = []
    for i, (name, patterns) in enumerate(jd.DOCUMENT_TYPES.items()):
        terms = []
        for p, w in patterns:
            q = p.replace("'", "''")
            terms.append(f"{w} * least(len(regexp_extract_all(low, '{q}')), 3) + CASE WHEN regexp_matches(heads, '{q}') THEN {w * 0.5} ELSE 0 END")
        parts.append(f"{{'score': round(({' + '.join(terms)})::DOUBLE, 9), 'at': {-i}, 'type': '{name}'}}")
    return f"""WITH t AS (SELECT doc_id, lower(substr(text, 1) || ' ' || {_sql_list(_PHRASES)}[doc_id % 8 + 1]) AS low, lower({_sql_list(_PHRASES)}[doc_id % 8 + 1]) AS heads FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, [{", ".join(parts)}] AS r FROM t), b AS (SELECT doc_id, list_max(r) AS b, list_sum(list_transform(r, lambda x: x.score)) AS total FROM s),
 c AS (SELECT *, CASE WHEN total > 0 THEN b.score / total ELSE 0 END AS share FROM b)
 SELECT doc_id, CASE WHEN b.score < 0.5 OR share < 0.3 THEN 'Unknown' ELSE b.type END AS type, round(CASE WHEN b.score < 0.5 OR share < 0.3 THEN share ELSE least(share, 0.95) END, 6) AS confidence FROM c"""


@query(_type_sql())
def c1_document_types(spark, d):
    """All seven document types over whole texts."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % 8 + 1).cast("int"))
    found = table(spark, d, "documents").where("text is not null").select("doc_id", jd.document_scores(F.concat("text", F.lit(" "), phrase), phrase).alias("r"))
    return found.select("doc_id", jd.document_type(F.col("r")).alias("t")).select("doc_id", "t.type", F.round("t.confidence", 6).alias("confidence"))


_NAMES = ["his brother", "The town", "Anna", "anna ", "**Bold Name**", "[chunk-3]", "12th", "unknown man", "no one", "They", "young Tom", "London (city)", "N/A", "a", "as mentioned", "Mr. Darcy`"]


@query(
    rf"""WITH n AS (SELECT p_partkey % 20 AS g, p_partkey AS o, {_sql_list(_NAMES)}[p_partkey % 16 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || (p_partkey % 7) END AS name FROM part),
 a AS (SELECT g, o, regexp_replace(regexp_replace(trim(regexp_replace(trim(name), '^[*\[\]"''()-]+|[*\[\]"''()-]+$', '', 'g')), '[*`]', '', 'g'), '\[chunk-\d+\]', '', 'g') AS x FROM n),
 c AS (SELECT g, o, CASE WHEN length(x) < 2 OR starts_with(lower(x), 'no ') OR starts_with(lower(x), 'likely') OR starts_with(lower(x), 'possibly') OR starts_with(lower(x), 'implied') OR contains(lower(x), 'unnamed') OR contains(lower(x), 'unknown') OR contains(lower(x), 'not mentioned') OR contains(lower(x), 'none') THEN '' ELSE x END AS name FROM a),
 k AS (SELECT * FROM c WHERE length(trim(name)) >= 2 {" ".join("AND NOT regexp_matches(name, '(?i)" + p + "')" for p in jd.NO_ENTITY)}),
 f AS (SELECT g, lower(name) AS low, min(o) AS o, arg_min(name, o) AS name FROM k GROUP BY 1, 2) SELECT g, n, name FROM (SELECT g, name, row_number() OVER (PARTITION BY g ORDER BY o, low) AS n FROM f) WHERE n <= 10"""
)
def pf13_entity_filters(spark, d):
    """All nine filters, cleaning, distinct names in any case, ten a group."""
    i = F.col("p_partkey")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (i % 16 + 1).cast("int")), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" "), (i % 7).cast("string"))))
    return jd.valid_entities(table(spark, d, "part").select((i % 20).alias("g"), i.alias("o"), name.alias("name")), "g", "name", "o")


_CAPTIONS = ["A dog running on the beach with various toys", "Based on the picture, this appears to be a cat", "", "Two people walking; it seems to rain", "The image shows some kind of lamp that might be old"]


@query(
    f"""WITH c AS (SELECT p_partkey, {_sql_list(_CAPTIONS)}[p_partkey % 5 + 1] || CASE WHEN p_partkey % 5 <> 2 THEN ' ' || p_name ELSE '' END AS cap, 'dog, cat;' || split_part(p_name, ' ', 1) AS subj, p_size % 2 = 0 AS anim FROM part),
 s AS (SELECT *, lower(cap) AS low, list_filter(regexp_split_to_array(lower(subj), '[,; ]+'), lambda x: x <> '') AS su FROM c)
 SELECT p_partkey, round(CASE WHEN trim(cap) = '' THEN 0.1 ELSE greatest(0, least(1, 0.5 + 0.15 * least(1, length(cap) / 125) - CASE WHEN len(list_filter({_sql_list(jd.LEAKS)}, lambda w: contains(low, w))) > 0 THEN 0.2 ELSE 0 END + least(0.2, 0.05 * len(list_filter(su, lambda x: contains(low, x)))) + CASE WHEN anim AND len(list_filter({_sql_list(jd.ACTIONS)}, lambda w: contains(low, w))) > 0 THEN 0.1 ELSE 0 END - 0.05 * len(list_filter({_sql_list(jd.VAGUE)}, lambda w: contains(low, w))))) END::DOUBLE, 6) AS quality FROM s"""
)
def c8_caption_scores(spark, d):
    """Caption quality with leakage, subjects, actions and vague phrases."""
    i = F.col("p_partkey")
    caption = F.concat(F.element_at(F.array(*[F.lit(x) for x in _CAPTIONS]), (i % 5 + 1).cast("int")), F.when(i % 5 != 2, F.concat(F.lit(" "), "p_name")).otherwise(""))
    subjects = F.concat(F.lit("dog, cat;"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    return table(spark, d, "part").select("p_partkey", F.round(jd.caption_quality(caption, "alttext", subjects, F.col("p_size") % 2 == 0), 6).alias("quality"))


#: Keys of signals and values that they may have, by the event's number; fixed values.
_SIGNALS = [("content.ocr_text", ["a text of more than twenty letters", "xxqzkrtw", "", "ok", "#### !!!!"]), ("vision.caption", ["no text here", "a cat", "it doesn't contain any text"]), ("content.text_likeliness", ["0.9", "0.2"]), ("color.is_grayscale", ["true", "false"]), ("color.mean_saturation", ["0.5", "0.1"]), ("content.type", ["Screenshot", "Icon", "Photo"]), ("quality.noise_level", ["0.3", "0.05"]), ("ocr.confidence", ["0.95", "0.5"]), ("faces.count", ["2", "0"]), ("forensics.has_exif", ["true", "false"]), ("identity.format", ["png", "JPEG"]), ("quality.sharpness", ["100", "900"]), ("quality.edge_density", ["0.6", "0.1"])]
_VALUES = ", ".join(f"[{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in vs)}]" for _, vs in _SIGNALS)


@query(
    rf"""WITH s AS (SELECT user_id, {_sql_list([k for k, _ in _SIGNALS])}[event_id % 13 + 1] AS k, ([{_VALUES}][event_id % 13 + 1])[(event_id // 13) % len([{_VALUES}][event_id % 13 + 1]) + 1] AS v, (event_id % 10) / 10 AS c FROM events),
 t AS (SELECT user_id, k, c, min(v) AS v FROM s GROUP BY ALL), b AS (SELECT user_id, k, arg_max(v, c) AS v, max(c) AS c FROM t GROUP BY 1, 2),
 r AS (SELECT * FROM (VALUES ('ocr_vs_vision_text', 'Warning', 'content.ocr_text', 'vision.caption'), ('text_likeliness_vs_ocr', 'Warning', 'content.text_likeliness', 'content.ocr_text'), ('grayscale_vs_colors', 'Info', 'color.is_grayscale', 'color.mean_saturation'), ('screenshot_vs_photo_noise', 'Warning', 'content.type', 'quality.noise_level'), ('ocr_quality_vs_content', 'Warning', 'ocr.confidence', 'content.ocr_text'), ('face_vs_icon', 'Warning', 'faces.count', 'content.type'), ('exif_format_mismatch', 'Warning', 'forensics.has_exif', 'identity.format'), ('blur_vs_edges', 'Info', 'quality.sharpness', 'quality.edge_density')) x(rule, severity, ka, kb)),
 j AS (SELECT a.user_id, rule, severity, a.v AS a, y.v AS b, coalesce(y.v, '') AS bb FROM r JOIN b a ON a.k = ka LEFT JOIN b y ON y.k = kb AND y.user_id = a.user_id WHERE a.c >= 0.5 AND coalesce(y.c, 1) >= 0.5)
 SELECT user_id, rule, severity FROM j WHERE CASE rule WHEN 'ocr_vs_vision_text' THEN length(a) > 20 AND (contains(lower(b), 'no text') OR contains(lower(b), 'without text') OR (contains(lower(b), 'doesn''t contain') AND contains(lower(b), 'text'))) WHEN 'text_likeliness_vs_ocr' THEN try_cast(a AS DOUBLE) > 0.7 AND trim(bb) = '' WHEN 'grayscale_vs_colors' THEN lower(a) = 'true' AND try_cast(b AS DOUBLE) > 0.2 WHEN 'screenshot_vs_photo_noise' THEN lower(a) = 'screenshot' AND try_cast(b AS DOUBLE) > 0.1 WHEN 'ocr_quality_vs_content' THEN try_cast(a AS DOUBLE) > 0.8 AND (length(bb) < 5 OR trim(bb) = '' OR regexp_matches(bb, '[^\p{{L}}\p{{Nd}}\s]{{4}}') OR regexp_matches(regexp_replace(bb, '[^\p{{L}}]', '', 'g'), '[^aeiouAEIOU]{{6}}') OR length(regexp_replace(bb, '[\p{{L}}\p{{Nd}}\s]', '', 'g')) > 0.3 * length(bb)) WHEN 'face_vs_icon' THEN try_cast(a AS DOUBLE) > 0 AND lower(b) IN ('icon', 'diagram') WHEN 'exif_format_mismatch' THEN lower(a) = 'true' AND upper(b) IN ('PNG', 'GIF', 'BMP') ELSE try_cast(a AS DOUBLE) < 300 AND try_cast(b AS DOUBLE) > 0.3 END"""
)
def m11_contradiction_rules(spark, d):
    """The ten default rules on the best signals of each owner."""
    e = F.col("event_id")
    at = (e % 13 + 1).cast("int")
    key = F.element_at(F.array(*[F.lit(k) for k, _ in _SIGNALS]), at)
    values = F.element_at(F.array(*[F.array(*[F.lit(v) for v in vs]) for _, vs in _SIGNALS]), at)
    value = F.element_at(values, (F.floor(e / 13) % F.size(values) + 1).cast("int"))
    signals = table(spark, d, "events").select("user_id", key.alias("key"), value.alias("value"), ((e % 10) / 10).alias("confidence"))
    return jd.contradictions(signals, "user_id")


_W3 = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+'), lambda x: length(x) > 1)"


@query(
    f"""WITH c AS (SELECT doc_id AS claim_id, list_distinct({_W3.format("text")}) AS terms, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [doc_id - 1] WHEN 2 THEN [doc_id + 1, doc_id] ELSE [CASE WHEN doc_id % 8 = 3 THEN -5 ELSE doc_id END] END AS cited FROM documents WHERE text IS NOT NULL),
 j AS (SELECT c.*, k.terms AS ct FROM c LEFT JOIN (SELECT doc_id, list_distinct({_W3.format("text")}) AS terms FROM documents WHERE text IS NOT NULL) k ON k.doc_id = c.cited[1]), s AS (SELECT *, len(list_intersect(terms, ct)) / len(terms) AS share FROM j)
 SELECT claim_id, CASE WHEN len(cited) = 0 THEN 'Low' WHEN len(cited) >= 2 THEN 'High' WHEN ct IS NULL THEN 'Uncertain' WHEN len(terms) = 0 THEN 'Low' WHEN share > 0.5 THEN 'High' WHEN share > 0.3 THEN 'Medium' ELSE 'Low' END AS confidence FROM s"""
)
def x24_claim_confidence(spark, d):
    """Claims by their citations and the overlap with the cited chunk."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null")
    terms = F.array_distinct(tx.tokens(F.col("text")))
    cited = F.when(i % 4 == 0, F.array().cast("array<bigint>")).when(i % 4 == 1, F.array(i - 1)).when(i % 4 == 2, F.array(i + 1, i)).otherwise(F.array(F.when(i % 8 == 3, F.lit(-5).cast("long")).otherwise(i)))
    claims = docs.select(i.alias("claim_id"), terms.alias("terms"), cited.alias("cited"))
    return jd.claim_confidence(claims, docs.select(i.alias("chunk_id"), terms.alias("terms"))).select("claim_id", "confidence")


@query("WITH n AS (SELECT p_partkey, p_size AS terms, p_partkey % 9 AS fact, p_size % 11 AS colour, (p_partkey % 10) / 10 AS sim FROM part) SELECT p_partkey, CASE WHEN terms = 0 OR colour > 2 * fact THEN 'Colour' WHEN fact > colour THEN 'Fact' WHEN sim > 0.7 THEN 'Fact' ELSE 'Inference' END AS type FROM n")
def x24_claim_types(spark, d):
    """Fact, inference or colour by the importance of a claim's terms."""
    i, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", jd.claim_type(i % 9, size % 11, size, (i % 10) / 10).alias("type"))


_OUT = "m AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(source, '') || ' ' || (doc_id % 17) END AS heading, CASE WHEN doc_id % 17 < 8 THEN 1 ELSE 0 END AS facts, CASE WHEN doc_id % 17 = 9 THEN 2 ELSE 0 END AS entities, CASE WHEN doc_id % 17 > 12 THEN 1 ELSE 0 END AS flows FROM documents)"


def _outputs(spark, d):
    i = F.col("doc_id")
    heading = F.when(i % 13 == 0, "").otherwise(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), (i % 17).cast("string")))
    return table(spark, d, "documents").select(i.alias("chunk_id"), heading.alias("heading"), F.when(i % 17 < 8, 1).otherwise(0).alias("facts"), F.when(i % 17 == 9, 2).otherwise(0).alias("entities"), F.when(i % 17 > 12, 1).otherwise(0).alias("flows"))


@query(f"WITH {_OUT} SELECT lower(CASE WHEN trim(heading) = '' THEN 'General' ELSE heading END) AS topic, list(chunk_id ORDER BY chunk_id) AS chunks FROM m GROUP BY 1")
def a15_coverage_map(spark, d):
    """Chunks by topic."""
    return jd.coverage_map(_outputs(spark, d))


@query(f"WITH {_OUT}, n AS (SELECT count(DISTINCT heading) FILTER (facts > 0 OR entities > 0) AS direct, count(DISTINCT heading) FILTER (facts = 0 AND entities = 0 AND flows > 0) AS inferred, count(DISTINCT heading) FILTER (facts = 0 AND entities = 0 AND flows = 0) AS uncovered FROM m WHERE trim(heading) <> '') SELECT *, round((direct + 0.5 * inferred) / (direct + inferred + uncovered), 6) AS ratio FROM n")
def a15_coverage_report(spark, d):
    """Headings covered directly, by inference, and not."""
    return jd.coverage_report(_outputs(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("WITH p AS (SELECT p_partkey, p_size % 5 AS facts, least(p_size % 5, p_partkey % 4) AS high, p_partkey % 6 AS contra, (p_partkey % 11) / 10 AS cover FROM part), s AS (SELECT *, high / nullif(facts, 0) - least(contra * 0.1, 0.3) + cover * 0.2 AS score FROM p) SELECT p_partkey, CASE WHEN facts = 0 THEN 'Low' WHEN round(score, 9) >= 0.7 THEN 'High' WHEN round(score, 9) >= 0.4 THEN 'Medium' WHEN round(score, 9) >= 0.2 THEN 'Low' ELSE 'Uncertain' END AS confidence FROM s")
def x27_overall_confidence(spark, d):
    """Confidence from sure facts, contradictions and coverage."""
    i, facts = F.col("p_partkey"), F.col("p_size") % 5
    return table(spark, d, "part").select("p_partkey", jd.overall_confidence(facts, F.least(facts, i % 4), i % 6, (i % 11) / 10).alias("confidence"))


@query("WITH f AS (SELECT p_brand AS name, [split_part(p_type, ' ', 1)] AS i, [p_name] AS o FROM part), e AS (SELECT name AS source, unnest(list_concat(i, o)) AS target FROM f UNION ALL SELECT unnest(s[1:-2]), unnest(s[2:]) FROM (SELECT string_split(p_type, ' ') AS s FROM part) WHERE len(s) > 1) SELECT lower(source) AS source, lower(target) AS target, count(*) AS times FROM e GROUP BY 1, 2")
def a16_reference_graph(spark, d):
    """Functions to what they take and give, steps of flows to the next."""
    p = table(spark, d, "part")
    functions = p.select(F.col("p_brand").alias("name"), F.array(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("inputs"), F.array("p_name").alias("outputs"))
    return jd.reference_graph(functions, p.select(F.split("p_type", " ").alias("steps")))


@query("WITH c AS (SELECT lang AS topic, CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN [doc_id] ELSE [doc_id, doc_id + 1] END AS evidence FROM documents) SELECT topic, count(*) AS claims, sum(len(evidence)) AS citations, count(*) FILTER (len(evidence) > 0) AS cited, round(count(*) FILTER (len(evidence) > 0) / count(*), 6) AS rate FROM c GROUP BY 1")
def a12_citation_rates(spark, d):
    """Claims, citations and the share of cited claims by topic."""
    i = F.col("doc_id")
    evidence = F.when(i % 3 == 0, F.array().cast("array<bigint>")).when(i % 3 == 1, F.array(i)).otherwise(F.array(i, i + 1))
    return jd.claims_by_topic(table(spark, d, "documents").select(F.col("lang").alias("topic"), evidence.alias("evidence"))).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH t AS (SELECT p_partkey, (p_partkey % 40) / 100 AS cover, 'Finally the ' || p_name || ' ends, in the end. ' AS s FROM part), b AS (SELECT *, {"regexp_replace(" * 5}s{"".join(f", '{p}', '', 'gi')" for p in jd.BANNED)} AS bare FROM t)
 SELECT p_partkey, rtrim(CASE WHEN cover >= 0.05 THEN s ELSE 'Based on sampled sections only (~' || printf('%.1f%%', cover * 100) || '), the excerpt suggests:' || chr(10) || trim(bare) END) || chr(10) || chr(10) || 'Coverage: ' || printf('%.1f%%', cover * 100) || ' (' || CASE WHEN cover < 0.05 THEN 'sampled scenes' ELSE 'document segments covered' END || ')' || chr(10) || 'Confidence: ' || CASE WHEN cover < 0.05 THEN 'Low' WHEN cover < 0.15 THEN 'Medium' ELSE 'High' END AS summary FROM b"""
)
def x28_coverage_guard(spark, d):
    """Summaries guarded by their coverage."""
    text = F.concat(F.lit("Finally the "), "p_name", F.lit(" ends, in the end. "))
    return table(spark, d, "part").select("p_partkey", jd.coverage_guard(text, (F.col("p_partkey") % 40) / 100).alias("summary"))


@query(
    "WITH t AS (SELECT p_partkey, string_split('intro' || chr(10) || '- no' || chr(10) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '## Open questions' || chr(10) END || '- what of ' || p_name || chr(10) || 'plain' || chr(10) || '  -- and ' || p_brand || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '## Next' || chr(10) ELSE '' END || '- last', chr(10)) AS l FROM part), s AS (SELECT *, list_position(list_transform(l, lambda x: contains(lower(x), 'open questions')), true) AS a FROM t), e AS (SELECT *, list_min(list_filter(range(1, len(l) + 1), lambda i: i > a AND starts_with(l[i], '##'))) AS z FROM s) SELECT p_partkey, CASE WHEN a IS NULL OR a = 0 THEN [] ELSE list_transform(list_filter(l[a + 1:coalesce(z - 1, len(l))], lambda x: starts_with(ltrim(x), '-')), lambda x: regexp_replace(x, '^[- ]+', '')) END AS questions FROM e"
)
def x28_open_questions(spark, d):
    """Open questions of answers."""
    i = F.col("p_partkey")
    text = F.concat(F.lit("intro\n- no\n"), F.when(i % 4 == 0, "").otherwise("## Open questions\n"), F.lit("- what of "), "p_name", F.lit("\nplain\n  -- and "), "p_brand", F.lit("\n"), F.when(i % 3 == 0, "## Next\n").otherwise(""), F.lit("- last"))
    return table(spark, d, "part").select("p_partkey", jd.open_questions(text).alias("questions"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\r\n]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\r\n]+'), lambda x: x <> ''), 1) AS i FROM conversations),
 v AS (SELECT *, lag(w) OVER (PARTITION BY conv_id, turn ORDER BY i) AS prev FROM w), big AS (SELECT prev, w, count(*) / sum(count(*)) OVER (PARTITION BY prev) AS prob FROM v WHERE prev IS NOT NULL AND conv_id % 2 = 0 GROUP BY 1, 2),
 k AS (SELECT conv_id * 1000 + turn AS k, i, v.prev, prob, CASE WHEN v.prev IS NOT NULL THEN coalesce(prob, 0.5) END AS p FROM v LEFT JOIN big ON big.prev = v.prev AND big.w = v.w), f AS (SELECT *, coalesce(p, 1) * coalesce(lead(p) OVER (PARTITION BY k ORDER BY i), 1) AS score FROM k),
 g AS (SELECT k, count(*) AS words, count(prob) AS known, count(*) FILTER (prob < 0.001) AS bad, sum(ln(p)) AS l, count(*) FILTER (score < 0.01) AS unusual FROM f GROUP BY 1),
 h AS (SELECT *, CASE WHEN words < 2 THEN 0 WHEN bad > 0 THEN 1000.0 * bad WHEN known > (words - 1) // 2 THEN exp(-l / (words - 1)) ELSE 50 END::DOUBLE AS perplexity FROM g) SELECT k, words, round(perplexity, 5) AS perplexity, perplexity < 100 AS valid, unusual FROM h"""
)
def m14_context_scores(spark, d):
    """Perplexity and unusual words of turns by the bigrams of every other conversation."""
    c = table(spark, d, "conversations")
    words = c.where("conv_id % 2 = 0").select(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\r\n]+"), lambda w: w != "").alias("w")).where(F.size("w") > 1)
    n = F.size("w")
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), n - 1).alias("prev"), F.slice("w", F.lit(2), n - 1).alias("cur"))).alias("x")).groupBy("x.prev", "x.cur").agg(F.count("*").alias("n"))
    bigrams = pairs.join(pairs.groupBy("prev").agg(F.sum("n").alias("all")), "prev").select("prev", "cur", (F.col("n") / F.col("all")).alias("prob"))
    found = jd.context_scores(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text"), bigrams, "k", "text")
    return found.withColumn("perplexity", F.round("perplexity", 5))


_PROSE = "pr AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '\"Come,\" said Mr. Ellis. He looked away. ' || coalesce(text, '') || ' \"No.\" she cried. Chapter two begins.' WHEN 1 THEN 'Install the server and configure the client API. It calls getName() -> my_value. ' || coalesce(text, '') ELSE coalesce(text, '') END AS text, CASE WHEN doc_id % 7 = 1 THEN 3 ELSE doc_id % 2 END AS blocks FROM documents)"
_ONE = lambda words: " + ".join(f"contains(lo, '{w}')::INT" for w in words)


@query(
    rf"""WITH {_PROSE}, st AS (SELECT doc_id, blocks, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM pr),
 tx AS (SELECT *, regexp_replace(array_to_string(s, ' '), '[^\x00-\x7F]', 'x', 'g') AS t, CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: regexp_matches(x, '^["''“”]'))) / len(s) ELSE 0 END AS dialogue FROM st), lw AS (SELECT *, lower(t) AS lo FROM tx),
 sc AS (SELECT doc_id, blocks, dialogue, dialogue * 10 + least(5, len(regexp_extract_all(lo, '{jd.SPEECH}')) / 3) + least(5, len(regexp_extract_all(lo, '{jd.NARRATIVE}')) / 2) + CASE WHEN contains(lo, 'chapter') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '{jd.TITLED}') THEN 2 ELSE 0 END AS fiction,
   least(5, blocks) + {_ONE(jd.TECHNICAL)} + least(5, len(regexp_extract_all(t, '{jd.CODE_LIKE}')) / 5) + CASE WHEN {_ONE(jd.STRUCTURE)} > 0 THEN 2 ELSE 0 END AS technical FROM lw)
 SELECT doc_id, round(fiction, 6) AS fiction, round(technical, 6) AS technical, CASE WHEN fiction > technical + 3 THEN 'narrative' WHEN technical > fiction + 3 THEN 'expository' WHEN dialogue > 0.15 THEN 'narrative' WHEN blocks > 2 THEN 'expository' ELSE 'unknown' END AS type FROM sc"""
)
def r21_content_type(spark, d):
    """Narrative or expository, by the scores of the whole text; a fifth of the texts each are set in a story or a manual."""
    i, own = F.col("doc_id"), F.coalesce("text", F.lit(""))
    text = F.when(i % 5 == 0, F.concat(F.lit('"Come," said Mr. Ellis. He looked away. '), own, F.lit(' "No." she cried. Chapter two begins.'))).when(i % 5 == 1, F.concat(F.lit("Install the server and configure the client API. It calls getName() -> my_value. "), own)).otherwise(own)
    docs = table(spark, d, "documents").select("doc_id", tx.sentences(text).alias("s"), F.when(i % 7 == 1, 3).otherwise(i % 2).alias("blocks"))
    fiction, technical, _, kind = jd.content_type(F.col("s"), F.col("blocks"))
    return docs.select("doc_id", F.round(fiction, 6).alias("fiction"), F.round(technical, 6).alias("technical"), kind.alias("type"))
