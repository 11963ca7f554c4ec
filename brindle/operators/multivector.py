"""Search over several vector types of a document, and the choice among them by past use."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as vx

#: Types in the order of preference without any history; fixed values.
PRIORITY = ["image", "text", "face", "color_hash", "perceptual_hash"]
HASHES = ("color_hash", "perceptual_hash")
ALIKE = 0.85


def hash_similarity(a: Column, b: str) -> Column:
    """One less the differing characters (a longer one's rest included) over the shorter length."""
    n = F.least(F.length(a), F.lit(len(b)))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(F.lit(b), i, F.lit(1))))
    return 1 - (F.greatest(F.length(a), F.lit(len(b))) - same) / n


def search_type(entries: DataFrame, kind: str, query: list[float] | str, k: int = 10, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score): the k best of one type; entries is (doc_id, type, vector, hash).

    Vectors by cosine from threshold on. Hashes fit if equal; perceptual ones also from
    85 % of equal characters on. Ties go to the smaller id.
    """
    own = entries.where(F.col("type") == kind)
    if kind in HASHES:
        same = F.col("hash") == query
        score = F.when(same, 1.0) if kind == "color_hash" else F.when(same, 1.0).when(F.length("hash") > 0, hash_similarity(F.col("hash"), query))
        scored = own.where(F.coalesce("hash", F.lit("")) != "").select("doc_id", score.alias("score")).where(F.col("score") >= ALIKE)
    else:
        scored = own.where(F.col("vector").isNotNull()).select("doc_id", vx.cosine(F.col("vector"), vx.literal(query)).alias("score")).where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def recommended(history: DataFrame, intent: str, available: list[str]) -> str:
    """The available type of the highest mean score times success rate for the intent, else over all, else by PRIORITY.

    history is (intent, type, score, results); ties go to the earlier in PRIORITY.
    """
    use = history.where(F.col("type").isin(available))
    value = F.avg("score") * F.avg((F.col("results") > 0).cast("double"))
    rows = use.groupBy("type").agg(value.alias("all"), F.avg(F.when(F.col("intent") == intent, F.col("score"))).alias("s"), F.avg(F.when(F.col("intent") == intent, (F.col("results") > 0).cast("double"))).alias("r")).collect()  # one row a type
    order = {t: i for i, t in enumerate(PRIORITY)}
    for pick in (lambda r: None if r["s"] is None else r["s"] * r["r"], lambda r: r["all"]):
        scored = [(-pick(r), order[r["type"]], r["type"]) for r in rows if pick(r) is not None]
        if scored:
            return min(scored)[2]
    return next((t for t in PRIORITY if t in available), "none")


def search_adaptive(entries: DataFrame, queries: dict[str, list[float] | str], history: DataFrame, intent: str, k: int = 10, threshold: float = 0.7) -> DataFrame:
    """(type, doc_id, score): the recommended type's results, or if they are fewer than half of k or poor, those of the type with the best mean."""
    available = [t for t in PRIORITY if t in queries]
    first = recommended(history, intent, available)
    found = None
    for t in available:
        part = search_type(entries, t, queries[t], k, threshold).select(F.lit(t).alias("type"), "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    stats = {r["type"]: (r["n"], r["mean"]) for r in found.groupBy("type").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).collect()}
    n, mean = stats.get(first, (0, 0.0))
    best = first
    if n < k // 2 or mean < threshold:
        for t in available:
            if t != first and stats.get(t, (0, 0.0))[1] > mean:
                best, mean = t, stats[t][1]
    return found.where(F.col("type") == best)


#: Segments of a group that one task may choose from at once.
CHOICE = 1_024


def mmr_top(segments: DataFrame, group: str, key: str, vector: str, weight: str, ratio: float = 0.15, least: int = 3, most: int = 30, trade: float = 0.7) -> DataFrame:
    """(group, key, rank): marginal relevance until each group's target (a share of its segments, within bounds) is reached.

    What a segment can gain only falls as others are chosen. So each round takes the CHOICE
    best of a group and chooses from them, one by one, as long as the best of them gains
    more than the next best of the group did; then all open segments meet what was chosen.
    Every round chooses one segment at least, mostly all; a group is never in one task.
    """
    from ..sources.storage import materialize
    from .rank import centroids

    own = segments.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), vx.normalised(F.col(vector)).alias("v"), F.col(weight).cast("double").alias("w"))
    middle = centroids(own, "g", "v").withColumnRenamed("centroid", "c")
    target = own.groupBy("g").agg(F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.count("*") * ratio))).cast("int").alias("target"))
    open_ = materialize(own.join(middle, "g").join(target, "g").select("g", "k", "v", "target", F.coalesce(vx.dot(F.col("v"), F.col("c")) * F.col("w"), F.lit(float("-inf"))).alias("fit"), F.lit(0.0).alias("near"), F.lit(0).alias("done")))
    kinds = open_.schema["g"].dataType.simpleString(), open_.schema["k"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        rest = tuple(pdf.iloc[-1][["gain", "k"]]) if len(pdf) > CHOICE else None
        pdf = pdf.iloc[:CHOICE]
        v = np.full((len(pdf), max(map(len, pdf["v"]))), np.nan)  # of other sizes: near nothing
        for i, x in enumerate(pdf["v"]):
            v[i, : len(x)] = x
        fit, near, k = pdf["fit"].to_numpy(), pdf["near"].to_numpy().copy(), pdf["k"].to_numpy()
        free, out = np.ones(len(k), bool), []
        for place in range(pdf["done"].iloc[0] + 1, pdf["target"].iloc[0] + 1):
            gain = trade * fit - (1 - trade) * near
            gain = np.where(np.isnan(gain), np.inf, gain)  # NaN is the greatest
            if not free.any():
                break
            top = np.flatnonzero(free & (gain == gain[free].max()))
            i = min(top, key=lambda j: k[j])
            if rest is not None and (gain[i] < rest[0] or gain[i] == rest[0] and k[i] > rest[1]):
                break
            free[i] = False
            out.append((place, i))
            near = np.fmax(near, np.add.accumulate(v * v[i], axis=1)[:, -1])
        at = [i for _, i in out]
        return pd.DataFrame({"g": pdf["g"].iloc[: len(at)].to_numpy(), "k": k[at], "v": pdf["v"].iloc[at].to_numpy(), "rank": np.array([p for p, _ in out], "int32"), "target": pdf["target"].iloc[: len(at)].to_numpy()})

    found = None
    while True:
        gain = trade * F.col("fit") - (1 - trade) * F.col("near")
        place = F.row_number().over(W.partitionBy("g").orderBy(F.desc("gain"), "k"))
        best = open_.where("done < target").withColumn("gain", gain).withColumn("at", place).where(F.col("at") <= CHOICE + 1)
        chosen = materialize(best.groupBy("g").applyInPandas(run, f"g {kinds[0]}, k {kinds[1]}, v array<double>, rank int, target int"))
        part = chosen.select("g", "k", "rank")
        found = part if found is None else found.union(part)
        new = chosen.groupBy("g").agg(F.collect_list("v").alias("vs"), F.max("rank").alias("last"), F.max("target").alias("_target"))
        if new.where("last < _target").isEmpty():  # a group has target segments at least, or all of its are chosen
            break
        near = F.greatest("near", F.array_max(F.transform("vs", lambda x: vx.dot(F.col("v"), x))))
        left = open_.join(part.select("g", "k"), ["g", "k"], "left_anti").join(new.where("last < _target"), "g")
        open_ = materialize(left.select("g", "k", "v", "target", "fit", near.alias("near"), F.col("last").alias("done")))
    return found.select(F.col("g").alias(group), F.col("k").alias(key), "rank")


#: Sentences that are kept whatever their score: shares, amounts, duties, warnings; fixed pattern.
BINDING = r"(?i)\b(\d+%|\$\d+|must\s+\w|shall\s+\w|should\s+\w|warning|caution|important:|note:|require[sd]?\s)\b"

#: What a binding sentence has at least, in lower case; fixed values.
BINDING_PARTS = ["%", "$", "must", "shall", "should", "warning", "caution", "important:", "note:", "require"]


def binding(text: Column) -> Column:
    """Whether a sentence fits BINDING, which is only tried where the sentence has a part of it."""
    low = F.lower(text)
    parts = F.contains(low, F.lit(BINDING_PARTS[0]))
    for part in BINDING_PARTS[1:]:
        parts = parts | F.contains(low, F.lit(part))
    return parts & text.rlike(BINDING)


def _reasons(segments: DataFrame) -> DataFrame:
    """segments with the reason for which a filter may not drop them, if any."""
    by = ["doc_id", "heading", "type"]
    own = W.partitionBy(*by)
    quote = F.row_number().over(W.partitionBy("doc_id", "type").orderBy("n"))
    placed = segments.withColumns({"_first": F.min("n").over(own), "_last": F.max("n").over(own), "_quote": quote})
    kind = F.col("type")
    named, first, last = F.col("heading") != "", F.col("n") == F.col("_first"), F.col("n") == F.col("_last")
    reason = (
        F.when((kind == "heading") & (F.length("text") < 100) & (F.col("level") <= 3), "heading")
        .when((kind == "sentence") & named & first, "first").when((kind == "sentence") & named & last, "last")
        .when((kind == "sentence") & binding(F.col("text")), "binding").when((kind == "quote") & (F.col("_quote") <= 5), "quote").when((kind == "code") & named & first, "code")
    )
    return placed.withColumn("reason", reason).drop("_first", "_last", "_quote")


def guaranteed(segments: DataFrame) -> DataFrame:
    """segments (doc_id, n, type, heading, level, text) that a filter may not drop, with the reason.

    Headings below 100 characters of the first three levels, the first and last sentence of a
    section, binding sentences, the first five quotes, and each section's first code block.
    """
    return _reasons(segments).where("reason is not null")


#: Words that a pseudo-query leaves out; fixed values.
STOP = "the a an and or but in on at to for of with is are was were be been being have has had this that these those it its as by from can will would could should may might must do does did".split()


def prefilter(segments: DataFrame, keep: int, terms: int = 30) -> DataFrame:
    """(doc_id, n, reason): guaranteed segments, then the best by shared pseudo-query terms, up to keep of a document.

    The pseudo-query of a document is the terms (30) of highest tf ln(N / (df + 1)) over its
    segments that are in under 80 % of them; a segment's score is the sum of the terms'
    weights that it holds. A section gives at most max(10, keep / sections). Ties by place.
    """
    from ..sources.storage import materialize

    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z\p{L}\p{Mn}\p{Nd}\p{Pc}]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOP))
    own = materialize(_reasons(segments).select("doc_id", "n", "heading", "reason", F.array_join(F.sort_array(words), " ").alias("words"))).repartition("doc_id")
    # a segment's words are one sorted string, which is a third of an array, and go to their document's task before they become rows; the first of each kind counts the segment
    split = own.where("words <> ''").select("doc_id", F.split("words", " ").alias("words"))
    marked = F.transform("words", lambda w, i: F.struct(w.alias("term"), F.when(i == 0, 1).when(F.get("words", i - 1) != w, 1).otherwise(0).alias("new")))
    counts = split.select("doc_id", F.explode(marked).alias("x")).groupBy("doc_id", F.col("x.term").alias("term")).agg(F.count("*").alias("tf"), F.sum("x.new").alias("df"))
    sizes = own.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_distinct("heading").alias("sections"))
    per = counts.join(sizes, "doc_id").where(F.col("df") < 0.8 * F.col("segments"))
    weight = F.round(F.col("tf") * F.log(F.col("segments") / (F.col("df") + 1)), 9)
    best = per.withColumn("weight", weight).withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))).where(F.col("at") <= terms)
    query = sizes.join(best.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("query")), "doc_id", "left")
    # a document's query is one short row, so that its segments are scored where they are
    held = F.filter("query", lambda q: F.contains(F.concat(F.lit(" "), "words", F.lit(" ")), F.concat(F.lit(" "), q["term"], F.lit(" "))))
    score = F.round(F.aggregate(held, F.lit(0.0), lambda a, q: a + q["weight"]), 6)
    scored = own.join(query, "doc_id").select("doc_id", "n", "heading", "reason", "sections", F.coalesce(score, F.lit(0.0)).alias("score"))
    cap = F.greatest(F.lit(10), F.floor(F.lit(keep) / F.greatest(F.col("sections"), F.lit(1))))
    inside = F.row_number().over(W.partitionBy("doc_id", "heading").orderBy(F.desc("score"), "n"))
    held = scored.withColumn("inside", inside).where(F.col("reason").isNotNull() | (F.col("inside") <= cap))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("reason").isNull(), F.desc("score"), "n"))
    return held.withColumn("place", place).where(F.col("reason").isNotNull() | (F.col("place") <= keep)).select("doc_id", "n", F.coalesce("reason", F.lit("score")).alias("reason"))
