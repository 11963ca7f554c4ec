"""Chunking, parsing and text scalars over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import texts as ops
from .registry import query, table

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+')"
_TOK = f"list_filter({_W}, lambda x: length(x) > 1)"


@query(r"WITH l AS (SELECT page_id, unnest(string_split(html, '<')) AS line FROM pages) SELECT page_id, count(*) FILTER (regexp_matches(line, '^h[1-6]')) AS headings, count(*) FILTER (line LIKE 'p>%') AS paragraphs FROM l GROUP BY 1")
def x1_headings_and_sections(spark, d):
    parts = F.split("html", "<")
    return table(spark, d, "pages").select("page_id", F.size(F.filter(parts, lambda x: x.rlike("^h[1-6]"))).cast("long").alias("headings"), F.size(F.filter(parts, lambda x: x.startswith("p>"))).cast("long").alias("paragraphs"))


@query(r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n, CASE WHEN length(s) > 80 THEN substr(s, 1, 77) || '...' ELSE s END AS heading, para FROM (SELECT *, string_split(para, '. ')[1] AS s FROM p WHERE trim(para) <> '')")
def x2_paragraphs(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "para")).where("trim(para) <> ''")
    first = F.split_part("para", F.lit(". "), F.lit(1))
    return p.select("doc_id", (F.col("at") + 1).cast("long").alias("n"), tx.title_of(first, 80).alias("heading"), "para")


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def x5_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query()
def x3_x6_budget_chunks(spark, d):
    return ops.budget_chunks(table(spark, d, "documents"), "doc_id", "text", 512)


@query()
def x7_line_chunks(spark, d):
    return ops.budget_chunks(table(spark, d, "documents"), "doc_id", "text", 128, separator="\n")


@query("SELECT doc_id, i AS at, substr(text, i * 400 + 1, 500) AS chunk FROM documents, range(0, 1000) r(i) WHERE i < CASE WHEN length(text) <= 500 THEN 1 ELSE ceil((length(text) - 500) / 400) + 1 END")
def x8_overlapping_windows(spark, d):
    w = tx.windows(F.col("text"), 500, 100)
    return table(spark, d, "documents").select("doc_id", F.posexplode(w).alias("at", "chunk")).select("doc_id", F.col("at").cast("long").alias("at"), "chunk")


@query(r"WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 10)) AS sentence FROM documents) SELECT * FROM s")
def x9_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"), 10)).alias("sentence"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '[^/]*//([^/]+)', 1) AS host FROM pages")
def x12_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "[^/]*//([^/]+)", 1).alias("host"))


@query(r"SELECT doc_id, trim(regexp_replace(translate(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '‘’“”–—•', '''''""--*'), '[ \t\n\v\f\r]+', ' ', 'g')) AS cleaned FROM documents")
def x13_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, len({_TOK}) AS n, len(list_distinct({_TOK})) AS n_distinct, {_TOK}[1] AS first FROM documents")
def x14_tokenise(spark, d):
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def x16_levenshtein(spark, d):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.levenshtein(a, b).cast("long").alias("distance"), F.round(tx.levenshtein_similarity(a, b), 6).alias("similarity"))


@query()
def x17_jaro_winkler(spark, d):
    return ops.name_similarity(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b")), "a", "b").select("p_partkey", "jaro_winkler")


@query("WITH g AS (SELECT p_partkey, list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2)) AS a, list_transform(range(1, length(p_type)), lambda i: substr(p_type, i, 2)) AS b FROM part) SELECT p_partkey, round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g")
def x18_ngram_jaccard(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(tx.jaccard(tx.ngrams(F.col("p_name")), tx.ngrams(F.col("p_type"))), 6).alias("jaccard"))


@query()
def x19_combined_similarity(spark, d):
    return ops.name_similarity(table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b")), "a", "b").select("p_partkey", "combined")


_TF = f"t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS total FROM documents)"


@query(f"WITH {_TF}, s AS (SELECT doc_id, term, round(tf * ln(total / df), 6) AS score FROM tf JOIN df USING (term), c) SELECT doc_id, term, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 3")
def x20_distinctive_terms(spark, d):
    return ops.tfidf(table(spark, d, "documents"), "doc_id", "text", 3)


@query(f"WITH {_TF} SELECT term, df, CASE WHEN df / total > 0.5 THEN 'Fact' WHEN df / total > 0.2 THEN 'Inference' ELSE 'Colour' END AS importance, round(ln((total - df + 0.5) / (df + 0.5) + 1), 6) AS bm25_idf, round(ln(total / df), 6) AS idf FROM df, c WHERE df >= 5")
def a4_a5_document_frequency(spark, d):
    docs = table(spark, d, "documents")
    df = docs.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")
    both = df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("total"))))
    share = F.col("df") / F.col("total")
    kind = F.when(share > 0.5, "Fact").when(share > 0.2, "Inference").otherwise("Colour")
    return both.select("term", "df", kind.alias("importance"), F.round(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("bm25_idf"), F.round(F.log(F.col("total") / F.col("df")), 6).alias("idf"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '\b(may|might|perhaps|possibly|the)\b')) AS hedges, round(greatest(0, 1 - 0.05 * len(regexp_extract_all(lower(text), '\b(may|might|perhaps|possibly|the)\b'))), 6)::DOUBLE AS score FROM documents")
def x22_hedging_penalty(spark, d):
    n = F.regexp_count(F.lower("text"), F.lit(r"\b(may|might|perhaps|possibly|the)\b"))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("hedges"), F.round(F.greatest(F.lit(0.0), 1 - 0.05 * n), 6).alias("score"))


@query(r"WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(text || ' [chunk-' || doc_id % 5 || '] x [chunk-9] [note]', '\[chunk-(\d+)\]', 1), lambda x: x::INT) AS ids FROM documents) SELECT doc_id, len(ids) AS total, len(list_filter(ids, lambda x: x > 3)) AS invalid, len(list_filter(ids, lambda x: x > 3)) = 0 AND len(ids) > 0 AS valid FROM c")
def x23_citations(spark, d):
    cited = F.concat("text", F.lit(" [chunk-"), (F.col("doc_id") % 5).cast("string"), F.lit("] x [chunk-9] [note]"))
    return ops.validate_citations(table(spark, d, "documents").select("doc_id", cited.alias("answer")), "answer", 4).select("doc_id", "total", "invalid", "valid")


@query(f"WITH s AS (SELECT conv_id, turn, text, list_distinct(list_filter({_W}, lambda x: length(x) > 4)) AS w, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}])(not|no|never|cannot|nicht|pas)($|[^\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}])') AS neg FROM conversations) SELECT a.conv_id, a.turn AS a, b.turn AS b FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE a.neg <> b.neg AND len(list_intersect(a.w, b.w)) >= 2")
def x26_fact_contradictions(spark, d):
    """One side denies by a whole word (of letters of any script), and two longer words at least are shared: found by their common words."""
    s = table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").rlike(r"(^|[^\p{L}\p{Mn}\p{Nd}\p{Pc}])(not|no|never|cannot|nicht|pas)($|[^\p{L}\p{Mn}\p{Nd}\p{Pc}])").alias("neg"), F.explode(F.array_distinct(tx.tokens(F.col("text"), 5))).alias("w"))
    yes, no = s.where("not neg").select("conv_id", "w", F.col("turn").alias("x")), s.where("neg").select("conv_id", "w", F.col("turn").alias("y"))
    j = yes.join(no, ["conv_id", "w"]).groupBy("conv_id", "x", "y").count().where("count >= 2 and x <> y")
    return j.select("conv_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^(Sure|Certainly|Here is)[^:]*:', ''), '```[a-z]*', '', 'g')) AS cleaned FROM conversations")
def x30_response_cleaner(spark, d):
    out = F.regexp_replace(F.regexp_replace("text", "^(Sure|Certainly|Here is)[^:]*:", ""), "```[a-z]*", "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.trim(out).alias("cleaned"))


@query(f"SELECT doc_id, len({_W}) AS words, ceil(len({_W}) / 200)::INT AS minutes, n_chars FROM documents")
def x33_reading_stats(spark, d):
    n = tx.word_count(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("words"), F.ceil(n / 200).cast("int").alias("minutes"), "n_chars")


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN strpos(substr(text, 1, 100), ' ') > 0 THEN substr(text, 1, 100 - strpos(reverse(substr(text, 1, 100)), ' ')) ELSE substr(text, 1, 100) END AS short FROM documents")
def x34_truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate_at_word(F.col("text"), 100).alias("short"))


@query(f"SELECT doc_id, CASE WHEN list_contains(['code','function','class','api'], {_TOK}[1]) THEN 0.2 WHEN n_chars < 80 THEN round(0.3 + 0.7 * n_chars / 80, 6) WHEN n_chars < 500 THEN round(1 + 0.1 * (n_chars - 80) / 420, 6) ELSE 1.1 END AS weight FROM documents")
def r20_content_weight(spark, d):
    n, first = F.col("n_chars"), F.get(tx.tokens(F.col("text")), F.lit(0))
    curve = F.when(n < 80, F.round(0.3 + 0.7 * n / 80, 6)).when(n < 500, F.round(1 + 0.1 * (n - 80) / 420, 6)).otherwise(1.1)
    return table(spark, d, "documents").select("doc_id", F.when(first.isin("code", "function", "class", "api"), 0.2).otherwise(curve).alias("weight"))


@query("WITH b AS (SELECT text AS t, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n, conv_id, turn FROM conversations) SELECT conv_id, turn, length(n) - length(t) AS step FROM b WHERE n IS NOT NULL")
def m14_adjacent_context(spark, d):
    from pyspark.sql import Window as W

    n = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.length(n) - F.length("text")).cast("long").alias("step")).where("step is not null")
