"""Rule tables and judgements: document types, claims, coverage, entity filters, captions, contradictions, word contexts."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Document types with patterns and weights, in order of declaration; fixed values.
DOCUMENT_TYPES = {
    "Fiction": [(r"\b(said|replied|whispered|shouted|asked)\b", 0.3), (r"\b(he|she|they)\s+(walked|ran|looked|felt|thought)\b", 0.25), (r"\b(chapter|prologue|epilogue)\s*\d*\b", 0.4), (r"[\"'][^\"']{20,}[\"']", 0.2), (r"\b(mr\.|mrs\.|miss|lady|lord|sir)\s+[a-z]+\b", 0.25), (r"\b(smiled|frowned|sighed|laughed|cried)\b", 0.2), (r"\b(heart|soul|love|passion|desire)\b", 0.15)],
    "Technical": [(r"\b(function|class|method|api|interface|module)\b", 0.35), (r"\b(parameter|argument|return|async|await)\b", 0.3), (r"```|\bcode\b|`[^`]+`", 0.4), (r"\b(install|configure|setup|deploy|build)\b", 0.25), (r"\b(error|exception|debug|log|trace)\b", 0.2), (r"\b(version|v\d+\.\d+|release)\b", 0.2), (r"\b(http|https|url|endpoint|request|response)\b", 0.25), (r"\b(json|xml|yaml|config|schema)\b", 0.25), (r"\b(vhdl|verilog|hdl|rtl|fpga|asic|cpld)\b", 0.5), (r"\b(flip.?flop|latch|register|counter|decoder|multiplexer|mux)\b", 0.4), (r"\b(logic gate|and gate|or gate|nand|nor|xor|inverter)\b", 0.4), (r"\b(signal|port|entity|architecture|component|process)\b", 0.35), (r"\b(clock|reset|enable|input|output|inout)\b", 0.25), (r"\b(std_logic|std_logic_vector|integer|boolean)\b", 0.45), (r"\b(synthesis|simulation|testbench|waveform)\b", 0.35), (r"\b(timing|propagation delay|setup time|hold time)\b", 0.35), (r"\b(combinational|sequential|synchronous|asynchronous)\b", 0.3), (r"\b(truth table|karnaugh|boolean algebra|state machine|fsm)\b", 0.4), (r"\b(bit|byte|word|bus|address|memory|ram|rom)\b", 0.25), (r"\b(react|component|props|state|hooks?|usestate|useeffect)\b", 0.45), (r"\b(jsx|tsx|webpack|babel|npm|yarn)\b", 0.35), (r"\b(dom|virtual dom|render|mount|unmount)\b", 0.3)],
    "Academic": [(r"\b(abstract|introduction|methodology|conclusion|references)\b", 0.4), (r"\b(hypothesis|findings|results|analysis|discussion)\b", 0.3), (r"\b(study|research|paper|journal|publication)\b", 0.25), (r"\([a-z]+,?\s*\d{4}\)", 0.35), (r"\b(et al\.?|ibid|op\.?\s*cit)\b", 0.4), (r"\b(figure|table|appendix)\s*\d+", 0.25), (r"\b(significant|correlation|variable|sample|data)\b", 0.2)],
    "Business": [(r"\b(executive summary|overview|objectives|deliverables)\b", 0.35), (r"\b(revenue|profit|margin|budget|cost|roi)\b", 0.3), (r"\b(stakeholder|client|vendor|partner|customer)\b", 0.25), (r"\b(q[1-4]|fy\d{2,4}|fiscal|quarter)\b", 0.3), (r"\b(strategy|initiative|roadmap|milestone)\b", 0.25), (r"\b(kpi|metric|target|goal|benchmark)\b", 0.25)],
    "Legal": [(r"\b(whereas|hereby|herein|thereof|pursuant)\b", 0.4), (r"\b(party|parties|agreement|contract|clause)\b", 0.3), (r"\b(shall|must|may not|is prohibited)\b", 0.25), (r"\b(liability|indemnify|warranty|damages)\b", 0.3), (r"\b(section|article|paragraph)\s*\d+", 0.25), (r"\b(plaintiff|defendant|court|jurisdiction)\b", 0.35)],
    "News": [(r"\b(reported|announced|according to|sources say)\b", 0.35), (r"\b(yesterday|today|monday|tuesday|wednesday|thursday|friday)\b", 0.2), (r"\b(officials?|spokesperson|minister|president|ceo)\b", 0.25), (r"\b(breaking|update|developing|exclusive)\b", 0.3), (r"\b(interview|statement|press|conference)\b", 0.2)],
    "Reference": [(r"\b(step\s*\d+|first,?|next,?|then,?|finally)\b", 0.25), (r"\b(how to|guide|tutorial|learn|example)\b", 0.35), (r"\b(tip|note|warning|important|see also)\b", 0.25), (r"\b(definition|overview|summary|quick\s*start)\b", 0.25), (r"\b(faq|frequently asked|common questions)\b", 0.3)],
}


#: Words of lower-case texts: what lies between ASCII characters that are no word's, so that what comes before and after decides nothing.
_BETWEEN = r"[\x00-/:-@\[-^`{-\x7F]+"
#: Patterns of whole words alone, each with its words.
_WHOLE = {p: [x for w in m[1].split("|") for x in ((w[:-2], w[:-1]) if w.endswith("?") else (w,))] for kind in DOCUMENT_TYPES.values() for p, _ in kind if (m := re.fullmatch(r"\\b\(((?:[a-z_]+\??\|?)+)\)\\b", p))}
_WORDS = sorted({w for own in _WHOLE.values() for w in own})
#: The other patterns with what a text needs for them: runs of a to z, one of which it has, or single marks and parts; fixed values.
_NEEDS = {
    r"\b(he|she|they)\s+(walked|ran|looked|felt|thought)\b": "walked ran looked felt thought", r"\b(chapter|prologue|epilogue)\s*\d*\b": "chapter prologue epilogue", r"[\"'][^\"']{20,}[\"']": "\" '", r"\b(mr\.|mrs\.|miss|lady|lord|sir)\s+[a-z]+\b": "mr mrs miss lady lord sir",
    r"```|\bcode\b|`[^`]+`": "code `", r"\b(version|v\d+\.\d+|release)\b": "version v release", r"\b(flip.?flop|latch|register|counter|decoder|multiplexer|mux)\b": "*flop latch register counter decoder multiplexer mux", r"\b(logic gate|and gate|or gate|nand|nor|xor|inverter)\b": "gate nand nor xor inverter",
    r"\b(timing|propagation delay|setup time|hold time)\b": "timing delay setup hold", r"\b(truth table|karnaugh|boolean algebra|state machine|fsm)\b": "truth karnaugh algebra machine fsm", r"\b(dom|virtual dom|render|mount|unmount)\b": "dom render mount unmount",
    r"\([a-z]+,?\s*\d{4}\)": "(", r"\b(et al\.?|ibid|op\.?\s*cit)\b": "al ibid cit opcit", r"\b(figure|table|appendix)\s*\d+": "figure table appendix",
    r"\b(executive summary|overview|objectives|deliverables)\b": "executive overview objectives deliverables", r"\b(q[1-4]|fy\d{2,4}|fiscal|quarter)\b": "q fy fiscal quarter",
    r"\b(shall|must|may not|is prohibited)\b": "shall must may prohibited", r"\b(section|article|paragraph)\s*\d+": "section article paragraph", r"\b(reported|announced|according to|sources say)\b": "reported announced according sources",
    r"\b(step\s*\d+|first,?|next,?|then,?|finally)\b": "step first next then finally", r"\b(how to|guide|tutorial|learn|example)\b": "how guide tutorial learn example", r"\b(tip|note|warning|important|see also)\b": "tip note warning important also", r"\b(definition|overview|summary|quick\s*start)\b": "definition overview summary start quickstart", r"\b(faq|frequently asked|common questions)\b": "faq frequently common",
}
_RUNS = sorted({w for needs in _NEEDS.values() for w in needs.split() if w.isalpha()})


def _read(low: Column) -> Column:
    """struct(low, words, runs): a lower-case text, its words that a pattern of whole words can fit, a line each, and its runs of letters that another pattern needs."""
    # of the words with other than ASCII characters only those with more than letters and digits can hold one of ASCII letters
    fits = lambda t: t.isin(_WORDS) | ((F.octet_length(t) > F.length(t)) & t.rlike(r"[^\p{L}\p{Nd}_]") & t.rlike(rf"\b(?:{'|'.join(_WORDS)})\b"))
    words = F.array_join(F.filter(F.split(low, _BETWEEN), fits), "\n")
    return F.struct(low.alias("low"), words.alias("words"), F.array_distinct(F.filter(F.split(low, "[^a-z]+"), lambda t: t.isin(_RUNS))).alias("runs"))


def _may_hold(read: Column, p: str) -> Column:
    needs = _NEEDS[p].split()
    runs, parts = [w for w in needs if w.isalpha()], [w.lstrip("*") for w in needs if not w.isalpha()]
    return functools.reduce(operator.or_, ([F.arrays_overlap(read["runs"], F.array(*map(F.lit, runs)))] if runs else []) + [F.contains(read["low"], F.lit(x)) for x in parts])


def _count(read: Column, p: str, most: int) -> Column:
    if p in _WHOLE:
        return F.when(read["words"] == "", 0).otherwise(F.least(F.regexp_count(read["words"], F.lit(p)), F.lit(most)))
    whole = F.least(F.regexp_count(read["low"], F.lit(p)), F.lit(most))
    return F.when(_may_hold(read, p), whole).otherwise(0) if p in _NEEDS else whole


def document_scores(text: Column, headings: Column) -> Column:
    """array of struct(score, at, type): every type's weighted pattern counts, at most three a pattern, and half a weight for a pattern in the headings.

    A text is cut into words once. Patterns of whole words then read only the words that one
    of them names; the others read the text where it has what they need. No count changes.
    """

    def scores(both: Column) -> Column:
        sums = [sum((F.lit(w) * _count(both["text"], p, 3) + F.when(_count(both["heads"], p, 1) > 0, F.lit(w * 0.5)).otherwise(0.0) for p, w in patterns), F.lit(0.0)) for patterns in DOCUMENT_TYPES.values()]
        return F.array(*[F.struct(F.round(s, 9).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("type")) for i, (name, s) in enumerate(zip(DOCUMENT_TYPES, sums, strict=True))])

    # the lambdas' variables hold each text and what was read of it once
    low = F.array(F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("text"), F.lower(F.coalesce(headings, F.lit(""))).alias("heads")))
    read = F.transform(low, lambda x: F.struct(_read(x["text"]).alias("text"), _read(x["heads"]).alias("heads")))
    return F.get(F.transform(read, scores), F.lit(0))


def document_type(rows: Column) -> Column:
    """struct(type, confidence) of document_scores, a column of its own that is computed once: Unknown below .5 or below .3 of all scores; ties go to the type declared first."""
    best, total = F.array_max(rows), F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["score"])
    share = F.when(total > 0, best["score"] / total).otherwise(0.0)
    unclear = (best["score"] < 0.5) | (share < 0.3)
    return F.struct(F.when(unclear, "Unknown").otherwise(best["type"]).alias("type"), F.when(unclear, share).otherwise(F.least(share, F.lit(0.95))).alias("confidence"))


#: What an entity's name may not look like, in any case; fixed values.
NO_ENTITY = [r"^(his|her|their|its|my|your|our)\s", r"^(he|she|they|it|we|you)\b", r"^(a|an|the|some|any|this|that)\s", r"\b(brother|sister|mother|father|family|wife|husband)\b", r"^(young|old|younger|older|eldest)\s", r"^\d+\s*(st|nd|rd|th)?\s*$", r"^\[.*\]$", r"^(none|n/a|unknown|unnamed|not specified)$", r"(mentioned|described|referred)"]
#: Starts and parts of names that are no names; fixed values.
NO_START, NO_PART = ("no ", "likely", "possibly", "implied"), ("unnamed", "unknown", "not mentioned", "none")


def clean_name(name: Column) -> Column:
    """A name without marks and citations; empty for what is no name."""
    bare = F.trim(F.regexp_replace(F.trim(name), r"^[*\[\]\"'()-]+|[*\[\]\"'()-]+$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"[*`]", ""), r"\[chunk-\d+\]", "")
    low = F.lower(bare)
    bad = F.length(bare) < 2
    for s in NO_START:
        bad = bad | low.startswith(s)
    for s in NO_PART:
        bad = bad | F.contains(low, F.lit(s))
    return F.when(bad, "").otherwise(bare)


def is_entity(name: Column) -> Column:
    ok = F.length(F.trim(name)) >= 2
    for p in NO_ENTITY:
        ok = ok & ~name.rlike("(?i)" + p)
    return ok


def valid_entities(names: DataFrame, group: str, name: str, order: str, most: int = 10) -> DataFrame:
    """(group, n, name): cleaned valid names, each once in any case, the first ones of each group in their order."""
    kept = names.select(group, F.col(order).alias("o"), clean_name(F.col(name)).alias("name")).where(is_entity(F.col("name")))
    first = kept.groupBy(group, F.lower("name").alias("low")).agg(F.min(F.struct("o", "name")).alias("x"))
    return first.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("x.o", "low"))).where(F.col("n") <= most).select(group, "n", F.col("x.name").alias("name"))


#: Wanted caption lengths by purpose, and phrases of bad captions; fixed values.
CAPTION_LENGTHS = {"alttext": 125, "caption": 200, "verbose": 500}
LEAKS = ["based on the", "i can see", "the image shows", "this appears to be", "looking at", "from what i can"]
ACTIONS = ["moving", "walking", "running", "jumping", "waving", "dancing", "falling"]
VAGUE = ["various", "some kind of", "appears to", "seems to", "might be"]


def caption_quality(caption: Column, purpose: str, subjects: Column, animated: Column) -> Column:
    """0 to 1: length, prompt leakage, subjects named, actions of animated images, vague phrases; .1 without a caption."""
    low = F.lower(caption)
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    named = F.size(F.filter(F.filter(F.split(F.lower(F.coalesce(subjects, F.lit(""))), "[,; ]+"), lambda s: s != ""), lambda s: F.contains(low, s)))
    vague = F.size(F.filter(F.array(*[F.lit(w) for w in VAGUE]), lambda w: F.contains(low, w)))
    score = 0.5 + 0.15 * F.least(F.lit(1.0), F.length(caption) / CAPTION_LENGTHS.get(purpose, 200)) - F.when(some(LEAKS), 0.2).otherwise(0.0) + F.least(F.lit(0.2), 0.05 * named) + F.when(animated & some(ACTIONS), 0.1).otherwise(0.0) - 0.05 * vague
    return F.when(F.trim(F.coalesce(caption, F.lit(""))) == "", 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def garbled(text: Column) -> Column:
    """Four special characters in a row, six consonants without a vowel letter between, or over 30 % special characters; blank texts too."""
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s]", ""))
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | text.rlike(r"[^\p{L}\p{Nd}\s]{4}") | letters.rlike("[^aeiouAEIOU]{6}") | (special > 0.3 * F.length(text))


def contradictions(signals: DataFrame, owner: str = "image_id", key: str = "key", value: str = "value", confidence: str = "confidence", least: float = 0.5) -> DataFrame:
    """(owner, rule, severity): the ten default rules on each owner's best signal of a key (ties of confidence: the smaller value).

    A rule is passed over if one of its signals has a confidence below least.
    """
    least_value = signals.groupBy(owner, F.col(key).alias("k"), F.col(confidence).alias("c")).agg(F.min(value).alias("v"))
    best = least_value.groupBy(owner, "k").agg(F.max_by("v", "c").alias("v"), F.max("c").alias("top"))
    held = best.groupBy(owner).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("v", F.col("top").alias("c"))))).alias("m"))

    def rule(name: str, severity: str, a: str, b: str, test, without_b: bool = False) -> Column:
        x, y = F.col("m")[a], F.col("m")[b]
        sure = (F.coalesce(x["c"], F.lit(1.0)) >= least) & (F.coalesce(y["c"], F.lit(1.0)) >= least)
        there = x["v"].isNotNull() & (F.lit(True) if without_b else y["v"].isNotNull())
        return F.when(F.coalesce(sure & there & test(x["v"], y["v"]), F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))

    number = lambda v: v.try_cast("double")
    says_none = lambda v: F.contains(F.lower(v), F.lit("no text")) | F.contains(F.lower(v), F.lit("without text")) | (F.contains(F.lower(v), F.lit("doesn't contain")) & F.contains(F.lower(v), F.lit("text")))
    rules = [
        rule("ocr_vs_vision_text", "Warning", "content.ocr_text", "vision.caption", lambda a, b: (F.length(a) > 20) & says_none(b)),
        rule("text_likeliness_vs_ocr", "Warning", "content.text_likeliness", "content.ocr_text", lambda a, b: (number(a) > 0.7) & (F.trim(F.coalesce(b, F.lit(""))) == ""), True),
        rule("grayscale_vs_colors", "Info", "color.is_grayscale", "color.mean_saturation", lambda a, b: (F.lower(a) == "true") & (number(b) > 0.2)),
        rule("screenshot_vs_photo_noise", "Warning", "content.type", "quality.noise_level", lambda a, b: (F.lower(a) == "screenshot") & (number(b) > 0.1)),
        rule("llm_vs_heuristic_type", "Info", "content.type", "vision.detected_type", lambda a, b: F.lit(False)),  # has no value sets by default, so it never fires
        rule("clip_vs_caption_mismatch", "Info", "vision.clip.embedding_hash", "vision.caption", lambda a, b: F.lit(False)),  # no check by default either
        rule("ocr_quality_vs_content", "Warning", "ocr.confidence", "content.ocr_text", lambda a, b: (number(a) > 0.8) & ((F.length(F.coalesce(b, F.lit(""))) < 5) | garbled(F.coalesce(b, F.lit("")))), True),
        rule("face_vs_icon", "Warning", "faces.count", "content.type", lambda a, b: (number(a) > 0) & F.lower(b).isin("icon", "diagram")),
        rule("exif_format_mismatch", "Warning", "forensics.has_exif", "identity.format", lambda a, b: (F.lower(a) == "true") & F.upper(b).isin("PNG", "GIF", "BMP")),
        rule("blur_vs_edges", "Info", "quality.sharpness", "quality.edge_density", lambda a, b: (number(a) < 300) & (number(b) > 0.3)),
    ]
    return held.select(owner, F.explode(F.array_compact(F.array(*rules))).alias("r")).select(owner, "r.rule", "r.severity")


def claim_confidence(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims (claim_id, terms, cited) with confidence; chunks is (chunk_id, terms).

    Low without a citation, High with two; with one by the share of the claim's terms in
    the chunk: over .5 High, over .3 Medium, else Low; Uncertain if the chunk is unknown.
    """
    first = claims.withColumn("chunk_id", F.get("cited", F.lit(0)))
    both = first.join(chunks.select("chunk_id", F.col("terms").alias("chunk_terms")), "chunk_id", "left")
    share = F.size(F.array_intersect("terms", "chunk_terms")) / F.size("terms")
    n = F.size("cited")
    level = F.when(n == 0, "Low").when(n >= 2, "High").when(F.col("chunk_terms").isNull(), "Uncertain").when(F.size("terms") == 0, "Low").when(share > 0.5, "High").when(share > 0.3, "Medium").otherwise("Low")
    return both.select(*claims.columns, level.alias("confidence"))


def claim_type(fact: Column, colour: Column, terms: Column, similarity: Column) -> Column:
    """Colour if such terms are over twice the fact terms, Fact if those are more, else by similarity to the source (over .7 Fact)."""
    return F.when((terms == 0) | (colour > 2 * fact), "Colour").when(fact > colour, "Fact").when(similarity > 0.7, "Fact").otherwise("Inference")


def coverage_map(outputs: DataFrame) -> DataFrame:
    """(topic, chunks): chunk ids of each heading in any case; General without one. outputs is (chunk_id, heading, facts, entities, flows)."""
    topic = F.when(F.trim(F.coalesce("heading", F.lit(""))) == "", "General").otherwise(F.col("heading"))
    return outputs.groupBy(F.lower(topic).alias("topic")).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))


def coverage_report(outputs: DataFrame) -> DataFrame:
    """One row: headings covered directly, inferred from flows, and not; ratio (direct + half of the inferred) of all."""
    h = outputs.where(F.trim(F.coalesce("heading", F.lit(""))) != "")
    direct = (F.col("facts") > 0) | (F.col("entities") > 0)
    counted = lambda c: F.count_distinct(F.when(c, F.col("heading")))
    n = h.agg(counted(direct).alias("direct"), counted(~direct & (F.col("flows") > 0)).alias("inferred"), counted(~direct & (F.col("flows") == 0)).alias("uncovered"))
    total = F.col("direct") + F.col("inferred") + F.col("uncovered")
    return n.withColumn("ratio", F.when(total > 0, (F.col("direct") + 0.5 * F.col("inferred")) / total).otherwise(0.0))


def overall_confidence(facts: Column, high: Column, contradictions: Column, coverage: Column) -> Column:
    """High from .7, Medium from .4, Low from .2 of: share of sure facts, less .1 a contradiction (at most .3), plus .2 of the coverage."""
    score = high / facts - F.least(contradictions * 0.1, F.lit(0.3)) + coverage * 0.2
    return F.when(facts == 0, "Low").when(score >= 0.7, "High").when(score >= 0.4, "Medium").when(score >= 0.2, "Low").otherwise("Uncertain")


def reference_graph(functions: DataFrame, flows: DataFrame) -> DataFrame:
    """(source, target): what functions (name, inputs, outputs) use and make, and each step of flows (steps) to the next, once."""
    uses = functions.select(F.col("name").alias("source"), F.explode(F.concat(F.coalesce("inputs", F.array().cast("array<string>")), F.coalesce("outputs", F.array().cast("array<string>")))).alias("target"))
    n = F.size("steps")
    pairs = flows.where(n > 1).select(F.explode(F.arrays_zip(F.slice("steps", F.lit(1), n - 1).alias("a"), F.slice("steps", F.lit(2), n - 1).alias("b"))).alias("p"))
    return uses.union(pairs.select("p.a", "p.b")).groupBy(F.lower("source").alias("source"), F.lower("target").alias("target")).agg(F.count("*").alias("times"))


def claims_by_topic(claims: DataFrame) -> DataFrame:
    """(topic, claims, citations, cited, rate): claims is (topic, evidence)."""
    n = F.size("evidence")
    return claims.groupBy("topic").agg(F.count("*").alias("claims"), F.sum(n).alias("citations"), F.count_if(n > 0).alias("cited")).withColumn("rate", F.col("cited") / F.col("claims"))


#: Phrases that a summary of sampled sections may not use; fixed values.
BANNED = ["ultimately", "as the story unfolds", "it becomes clear", "finally", "in the end"]


def coverage_guard(summary: Column, coverage: Column) -> Column:
    """Below 5 % coverage: without the banned phrases and with a disclaimer; always with a footer on coverage and confidence."""
    bare = summary
    for phrase in BANNED:
        bare = F.regexp_replace(bare, f"(?i){phrase}", "")
    percent = F.format_string("%.1f%%", coverage * 100)
    guarded = F.when(coverage >= 0.05, summary).otherwise(F.concat(F.lit("Based on sampled sections only (~"), percent, F.lit("), the excerpt suggests:\n"), F.trim(bare)))
    scope = F.when(coverage < 0.05, "sampled scenes").otherwise("document segments covered")
    level = F.when(coverage < 0.05, "Low").when(coverage < 0.15, "Medium").otherwise("High")
    return F.concat(F.rtrim(guarded), F.lit("\n\nCoverage: "), percent, F.lit(" ("), scope, F.lit(")\nConfidence: "), level)


def open_questions(text: Column) -> Column:
    """Dashed lines after the line on open questions, up to the next second-level heading."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    is_start = lambda x: F.contains(F.lower(x), F.lit("open questions"))
    start = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(is_start(x), i)), lambda i: i.isNotNull()))
    ends = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("##") & ~is_start(x) & (i > start), i)), lambda i: i.isNotNull())
    end = F.coalesce(F.array_min(ends), F.size(lines))
    inside = F.slice(lines, start + 2, F.greatest(end - start - 1, F.lit(0)))
    found = F.transform(F.filter(inside, lambda x: F.ltrim(x).startswith("-") & ~is_start(x)), lambda x: F.regexp_replace(x, "^[- ]+", ""))
    return F.when(start.isNull(), F.array().cast("array<string>")).otherwise(found)


def context_scores(texts: DataFrame, bigrams: DataFrame, key: str, text: str, unknown: float = 0.5) -> DataFrame:
    """(key, words, perplexity, valid, unusual): how well words fit by bigrams (prev, cur, prob).

    1000 for every known bigram below .001; else, if most bigrams are known, the
    exponential of the mean negative log; else 50. Valid below 100. unusual counts words
    whose probability between their neighbours is below .01. One word has perplexity 0.
    """
    words = texts.select(key, F.posexplode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t\r\n]+"), lambda w: w != "")).alias("i", "w"))
    by = W.partitionBy(key).orderBy("i")
    pairs = words.withColumn("prev", F.lag("w").over(by))
    found = pairs.join(bigrams.select("prev", F.col("cur").alias("w"), "prob"), ["prev", "w"], "left")
    p = F.coalesce("prob", F.lit(unknown))
    fit = found.withColumn("p", F.when(F.col("prev").isNotNull(), p)).withColumn("next_p", F.lead("p").over(by))
    fit = fit.withColumn("score", F.coalesce("p", F.lit(1.0)) * F.coalesce("next_p", F.lit(1.0)))
    per = fit.groupBy(key).agg(F.count("*").alias("words"), F.count("prob").alias("known"), F.count_if(F.col("prob") < 0.001).alias("bad"), F.sum(F.log("p")).alias("log"), F.count_if(F.col("score") < 0.01).alias("unusual"))
    n = F.col("words") - 1
    perplexity = F.when(n < 1, 0.0).when(F.col("bad") > 0, 1000.0 * F.col("bad")).when(F.col("known") > F.floor(n / 2), F.exp(-F.col("log") / n)).otherwise(50.0)
    return per.select(key, "words", perplexity.alias("perplexity"), (perplexity < 100).alias("valid"), F.col("unusual"))


# Fixed values of the content type.
SPEECH = r"\b(said|replied|asked|answered|cried|shouted|whispered|muttered|exclaimed|remarked|observed)\b"
NARRATIVE = r"\b(he|she|they|i)\s+(walked|ran|looked|felt|thought|saw|heard|went|came|stood|sat)\b"
TITLED = r"\b(Mr\.|Mrs\.|Miss|Dr\.|Captain|Inspector)\s+[A-Z][a-z]+"
TECHNICAL = ["function", "class", "method", "api", "http", "json", "install", "configure", "docker", "kubernetes", "database", "server", "client"]
CODE_LIKE = r"\b[a-z]+[A-Z][a-z]+\b|[a-z]+_[a-z]+|\(\)|\[\]|\{\}|=>|->"
STRUCTURE = ["introduction", "conclusion", "overview", "requirements"]
MARGIN = 3


def content_type(sentences: Column, code_blocks: Column) -> tuple[Column, Column, Column, Column]:
    """(fiction, technical, dialogue, type) of a text's sentences and number of code blocks.

    Fiction: the share of sentences that open with a quote (ten times), a third of the
    speech tags and half of the pronouns with a verb (five at most each), chapters (3)
    and titled names (2). Technical: code blocks (five at most), technical words that
    occur, a fifth of what looks like code (five at most), words of structure (2). The
    higher one wins by more than the margin; else dialogue of over 15 % or more than
    two code blocks decide. All sentences are read.
    """
    text = F.regexp_replace(F.array_join(sentences, " "), r"[^\x00-\x7F]", "x")  # a letter to every regular expression engine
    low = F.lower(text)
    has = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    n = F.size(sentences)
    opened = F.size(F.filter(sentences, lambda x: x.rlike("^[\"'“”]")))
    dialogue = F.when(n > 0, opened / n).otherwise(0.0)
    five = F.lit(5.0)
    fiction = dialogue * 10 + F.least(five, F.regexp_count(low, F.lit(SPEECH)) / 3) + F.least(five, F.regexp_count(low, F.lit(NARRATIVE)) / 2)
    fiction = fiction + F.when(F.contains(low, F.lit("chapter")), 3).otherwise(0) + F.when(text.rlike(TITLED), 2).otherwise(0)
    technical = F.least(five, code_blocks.cast("double")) + has(TECHNICAL) + F.least(five, F.regexp_count(text, F.lit(CODE_LIKE)) / 5) + F.when(has(STRUCTURE) > 0, 2).otherwise(0)
    kind = F.when(fiction > technical + MARGIN, "narrative").when(technical > fiction + MARGIN, "expository").when(dialogue > 0.15, "narrative").when(code_blocks > 2, "expository").otherwise("unknown")
    return fiction, technical, dialogue, kind
