"""The whole semantic prefilter of a document's segments: guaranteed coverage, a stratified sample, section-capped BM25 against a pseudo-query, and a fill by similarity.

segments is (doc_id, n, type, heading, level, text) with n from 1 in the order of the
text, and may have a vector. Rows go to their document's task once and are marked there
by windows; texts are kept once, for documents that are cut at all, and their words
become rows behind the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as vx
from ..sources.storage import materialize
from .multivector import STOP
from .multivector import binding as binding_text

# Fixed values.
CODE_WORDS = ["dockerfile", "docker", "from ", "run ", "copy ", "cmd ", "entrypoint", "compose", "services:", "dotnet", "npm", "apt-get", "pip"]
SHORT_STOP = [w for w in STOP if w not in "can will would could should may might must do does did".split()]
MOST_HEADINGS, FEW_HEADINGS, SOME_HEADINGS = 50, 5, 20
MANY_SECTIONS, SPREAD = 50, 30
MOST_QUOTES, MOST_CODE = 5, 10
TERMS, ANCHORS = 30, 5
K1, B = 1.5, 0.75
SPLIT = r"""[ \t\n\r.,!?;:"'()\[\]]+"""


def _words(text: Column, stop: list[str]) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: (F.length(w) > 2) & ~w.isin(stop))


def _number(by: list, *order) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def _either(*flags: Column) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | F.coalesce(flag, F.lit(False))
    return out


def placed(rows: DataFrame, sample_size: int) -> DataFrame:
    """rows (segments with their document's total) with sections of their document, section_at (n of their section's first), sure, sampled, samples (the document's) and title (the section's, at its first).

    sure are the segments that are never filtered out: the first fifty short headings that
    look like headings, or the first twenty of any if there are fewer than five; the first
    and last sentence of every named section while fewer than max(50, a seventh) are
    chosen, or with over fifty such sections every so manieth sentence of the document;
    all binding sentences, the first five quotes, ten code blocks with words of tools, and
    the first code block of a named section.

    sampled are sample_size segments: headings first, then of each section in its order
    the first, the last and evenly spaced ones.
    """
    whole = (W.unboundedPreceding, W.unboundedFollowing)
    in_order = W.partitionBy("doc_id").orderBy("n")
    so_far, of_all, earlier = in_order.rowsBetween(W.unboundedPreceding, W.currentRow), in_order.rowsBetween(*whole), in_order.rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("doc_id", "heading").orderBy("n")
    of_section, n, kind = inside.rowsBetween(*whole), F.col("n"), F.coalesce("type", F.lit(""))
    vector = [c for c in ("vector",) if c in rows.columns]
    rows = rows.withColumns({"heading": F.coalesce("heading", F.lit("")), "most": F.greatest(F.lit(50), F.floor(F.col("total") / 7))})
    is_head, is_sentence, is_quote, is_code, named = kind == "heading", kind == "sentence", kind == "quote", kind == "code", F.col("heading") != ""
    rest = ~is_head & F.col("type").isNotNull()
    low = F.lower("text")
    real = is_head & (F.length("text") < 100) & (F.contains(low, F.lit("chapter")) | F.contains(low, F.lit("section")) | F.col("text").startswith("#") | F.col("text").rlike(r"^\d+[.)]\s") | (F.col("level") <= 3))
    tools = is_code & (sum((F.contains(low, F.lit(w)).cast("int") for w in CODE_WORDS), F.lit(0)) > 0)
    rows = rows.withColumns({"real": _either(real), "tool": _either(tools), "binds": _either(is_sentence & binding_text(F.col("text")))})
    counts = {"reals": "real", "tools": "tool", "headings": is_head, "quotes": is_quote, "sentences": is_sentence}
    rows = rows.withColumns({f"{k}_so_far": F.count_if(v).over(so_far) for k, v in counts.items()} | {k: F.count_if(v).over(of_all) for k, v in counts.items()})
    # real headings are taken first; where they are too few, the first of all headings
    head = is_head & F.when(F.col("reals") >= FEW_HEADINGS, F.col("real") & (F.col("reals_so_far") <= MOST_HEADINGS)).otherwise(F.col("headings_so_far") <= SOME_HEADINGS)
    rows = rows.withColumn("head", head).withColumn("heads", F.count_if("head").over(of_all)).drop("reals", "reals_so_far", "headings_so_far", "real", "level")
    sections = {"section_at": F.min("n"), "first": F.min(F.when(is_sentence, n)), "last": F.max(F.when(is_sentence, n)), "first_code": F.min(F.when(is_code, n)), "begins": F.min(F.when(rest, n)), "size": F.count_if(rest)}
    rows = rows.withColumns({k: v.over(of_section) for k, v in sections.items()} | {"at": F.count_if(rest).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1})
    opens = is_sentence & named & (n == F.col("first"))
    taken = F.when(opens, F.when(F.col("first") == F.col("last"), 1).otherwise(2)).otherwise(0)
    rows = rows.withColumns({"before": F.coalesce(F.sum(taken).over(earlier), F.lit(0)), "named": F.count_if(opens).over(of_all), "sections": F.count_if(n == F.col("section_at")).over(of_all), "groups": F.count_if(rest & (n == F.col("begins"))).over(of_all)})
    # what earlier sections take only grows, so that those with room left are the first ones
    rows = rows.withColumn("room", F.max(F.when(opens & (F.col("heads") + F.col("before") < F.col("most")), n)).over(of_all))
    ends = is_sentence & named & ((n == F.col("first")) | (n == F.col("last"))) & (F.col("named") <= MANY_SECTIONS) & (F.col("first") <= F.col("room"))
    nth, every = F.col("sentences_so_far") - 1, F.greatest(F.lit(1), F.floor(F.col("sentences") / SPREAD))
    spread = is_sentence & (F.col("named") > MANY_SECTIONS) & (nth % every == 0) & (F.col("heads") + F.floor(nth / every) < F.col("most"))
    quote, tool = is_quote & (F.col("quotes_so_far") <= MOST_QUOTES), F.col("tool") & (F.col("tools_so_far") <= MOST_CODE)
    sure = _either(F.col("head"), ends, spread, F.col("binds"), quote, tool, is_code & named & (n == F.col("first_code")))
    # whole division goes toward zero where headings alone are more than the sample
    share = F.greatest(F.lit(2), ((F.lit(sample_size) - F.col("headings")) / F.greatest(F.lit(1), F.col("groups"))).cast("int"))
    rows = rows.withColumn("sure", sure).withColumn("share", share)
    at, size, share = F.col("at"), F.col("size"), F.col("share")
    step = F.greatest(F.lit(1), F.floor(size / (share - 1)))
    even = (at % step == 0) & (at / step < share - 1) & (at < size - 1)
    small = size <= share
    order = F.when(is_head, n).when(small, at).when(at == 0, 0).when(at == size - 1, 1).otherwise(at + 1)
    rows = rows.withColumns({"open": is_head | (rest & (small | (at == 0) | (at == size - 1) | even)), "section": F.when(is_head, 0).otherwise(F.col("begins")), "order": order})
    rows = rows.withColumn("sampled", F.col("open") & (_number(["doc_id", "open"], "section", "order") <= sample_size))
    title = F.when(named & (n == F.col("section_at")), F.col("heading"))
    return rows.select("doc_id", "n", "text", *vector, "total", "sections", "section_at", "sure", "sampled", F.count_if("sampled").over(W.partitionBy("doc_id")).alias("samples"), title.alias("title"))


def bm25(segments: DataFrame, terms: int = TERMS) -> DataFrame:
    """(doc_id, n, score) of placed segments that hold a word of their document's pseudo-query; each document is a corpus of its own.

    The pseudo-query has the words of section titles, and of the sample's words in under
    four fifths of it those of highest tf ln(N / (df + 1)); ties by word. A title's words
    are rows of the segment that has it, so that a word's rows know whether it is asked for.
    Texts are dealt by document alone, so that their words are not shuffled.
    """
    words = segments.repartition("doc_id").select("doc_id", "n", "total", "sampled", "samples", _words(F.col("text"), SHORT_STOP).alias("w"), F.coalesce(_words(F.col("title"), SHORT_STOP), F.array()).alias("t")).withColumn("len", F.coalesce(F.size("w"), F.lit(0)))
    mean = F.avg(F.size("w")).over(W.partitionBy("doc_id"))
    words = words.withColumn("mean", mean).withColumn("norm", F.when(F.col("len") > 0, K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    split = words.select("doc_id", "n", "norm", "total", "sampled", "samples", "len", F.posexplode(F.concat(F.coalesce("w", F.array()), "t")).alias("pos", "term"))
    tf = split.groupBy("doc_id", "n", "norm", "total", "sampled", "samples", "term").agg(F.count_if(F.col("pos") < F.col("len")).alias("tf"), F.max(F.col("pos") >= F.col("len")).alias("titled"))
    same = W.partitionBy("doc_id", "term")
    tf = tf.withColumns({"df": F.count_if(F.col("tf") > 0).over(same), "titled": F.max("titled").over(same), "own_tf": F.sum(F.when(F.col("sampled"), F.col("tf")).otherwise(0)).over(same), "own_df": F.count_if(F.col("sampled") & (F.col("tf") > 0)).over(same)})
    known = (F.col("own_tf") > 0) & (F.col("own_df") < F.col("samples") * 0.8) & ~F.col("term").isin(STOP)
    weight = F.when(known, F.round(F.col("own_tf") * F.log(F.col("samples") / (F.col("own_df") + 1)), 9))
    asked = tf.withColumn("weight", weight).where((F.col("tf") > 0) & (F.col("titled") | F.col("weight").isNotNull()))
    place = F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.desc_nulls_last("weight"), "term"))
    asked = asked.withColumn("place", place).where(F.col("titled") | (F.col("weight").isNotNull() & (F.col("place") <= terms)))
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
    return asked.groupBy("doc_id", "n").agg(F.round(F.sum(part), 6).alias("score"))


def anchors(sample: DataFrame, k: int = ANCHORS) -> DataFrame:
    """(doc_id, place, vector): of each document's sample (doc_id, n, vector) the first vector, then k - 1 times the one farthest from all chosen; ties by n."""
    open_ = materialize(sample.where("vector is not null").select("doc_id", "n", vx.normalised(F.col("vector")).alias("v"), F.lit(3.0).alias("away")))
    chosen = None
    for place in range(1, k + 1):
        order = F.struct(F.col("away") if place > 1 else F.lit(0.0), -F.col("n"))
        best = materialize(open_.groupBy("doc_id").agg(F.max_by(F.struct("n", "v"), order).alias("b")).select("doc_id", F.col("b.n").alias("bn"), F.col("b.v").alias("bv")))
        part = best.select("doc_id", F.lit(place).alias("place"), F.col("bv").alias("vector"))
        chosen = part if chosen is None else chosen.union(part)
        open_ = materialize(open_.join(best, "doc_id").where("n <> bn").select("doc_id", "n", "v", F.least("away", 1 - vx.dot(F.col("v"), F.col("bv"))).alias("away")))
    return chosen


def _likeness(open_: DataFrame) -> DataFrame:
    """(doc_id, n, chosen, like) of the segments without a reason: the nearest anchor where both have vectors, else the weight of words that the sample uses.

    open_ has the sampled segments and those without a reason. Each of the latter has an
    empty word beside its own, so that it stays without any.
    """
    low, none = F.lower("text"), F.array().cast("array<string>")
    parts = F.coalesce(F.filter(F.split(low, r"""[ \t\n\r.,!?;:"'()]+"""), lambda w: w != ""), none)
    words = open_.select("doc_id", "n", "chosen", "sampled", F.when(~F.col("sampled"), parts).alias("parts"), F.when(F.col("sampled"), F.coalesce(_words(F.col("text"), SHORT_STOP), none)).alias("own"))
    long = F.concat(F.array(F.lit("")), F.filter("parts", lambda w: F.length(w) > 2))
    rows = words.select("doc_id", "n", "chosen", "sampled", F.size("parts").alias("len"), F.explode(F.coalesce("own", long)).alias("term"))
    rows = rows.withColumn("freq", F.count_if("sampled").over(W.partitionBy("doc_id", "term"))).where(~F.col("sampled"))
    like = rows.groupBy("doc_id", "n", "chosen", "len").agg(F.sum(F.when(F.col("freq") > 0, F.log(1 + F.col("freq")))).alias("s"))
    like = like.select("doc_id", "n", "chosen", F.when(F.col("s").isNotNull(), F.round(F.least(F.lit(1.0), F.col("s") / F.sqrt("len") / 3), 9)).alias("like"))
    if "vector" not in open_.columns:
        return like.withColumn("like", F.coalesce("like", F.lit(0.0)))
    left = open_.where(~F.col("sampled") & F.col("vector").isNotNull())
    near = left.join(anchors(open_.where("sampled")).withColumnRenamed("vector", "anchor"), "doc_id").groupBy("doc_id", "n").agg(F.round(F.max(vx.dot(vx.normalised(F.col("vector")), F.col("anchor"))), 9).alias("near"))
    return like.join(near, ["doc_id", "n"], "left").select("doc_id", "n", "chosen", F.coalesce("near", "like", F.lit(0.0)).alias("like"))


def semantic_prefilter(segments: DataFrame, keep: int, sample_size: int = 200) -> DataFrame:
    """(doc_id, n, reason): guaranteed and sampled segments, then the best by BM25 up to keep of a document, then the most alike.

    Of a section at most max(10, keep / sections) are candidates, of a document 2 keep.
    A document of at most keep segments is kept whole (reason all).
    """
    vector = [c for c in ("vector",) if c in segments.columns]
    counted = segments.select("doc_id", "n", "type", "heading", "level", "text", *vector).withColumn("total", F.count("*").over(W.partitionBy("doc_id")))
    # a document that is kept whole needs its numbers only
    texts = {c: F.when(F.col("total") > keep, F.col(c)) for c in ("type", "heading", "level", "text", *vector)}
    rows = materialize(counted.withColumns(texts))
    large = materialize(placed(rows.where(F.col("total") > keep), sample_size))
    scores = bm25(large.select("doc_id", "n", "total", "sampled", "samples", "text", "title"))
    ids = large.select("doc_id", "n", "section_at", "sections", "sure", "sampled")
    scored = ids.join(scores, ["doc_id", "n"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    cap = F.greatest(F.lit(10), F.floor(F.lit(keep) / F.greatest(F.lit(1), F.col("sections"))))
    inside = scored.withColumn("inside", _number(["doc_id", "section_at"], F.desc("score"), "n") <= cap).withColumn("held", F.col("sure") | F.col("sampled"))
    marked = inside.withColumn("place", _number(["doc_id", "inside"], F.desc("score"), "n"))
    # candidates that are not held already fill up what is left, in the order of their scores
    fresh = ~F.col("held") & F.col("inside") & (F.col("place") <= 2 * keep)
    marked = marked.withColumn("fresh", fresh).withColumn("turn", _number(["doc_id", "fresh"], "place", "n")).withColumn("helds", F.count_if("held").over(W.partitionBy("doc_id")))
    by_score = F.col("fresh") & (F.col("helds") + F.col("turn") <= keep)
    marked = marked.withColumn("reason", F.when(F.col("sure"), "guaranteed").when(F.col("sampled"), "sample").when(by_score, "score"))
    marked = materialize(marked.select("doc_id", "n", "sampled", "reason", F.count("reason").over(W.partitionBy("doc_id")).alias("chosen")))
    texts = large.select("doc_id", "n", "text", *vector)
    open_ = marked.where((F.col("chosen") < keep) & (F.col("sampled") | F.col("reason").isNull())).drop("reason").join(texts, ["doc_id", "n"]).repartition("doc_id")
    filled = _likeness(open_).withColumn("k", _number(["doc_id"], F.desc("like"), "n")).where(F.col("k") + F.col("chosen") <= keep)
    whole = rows.where(F.col("total") <= keep).select("doc_id", "n", F.lit("all").alias("reason"))
    return marked.where("reason is not null").select("doc_id", "n", "reason").union(filled.select("doc_id", "n", F.lit("fill"))).union(whole)
