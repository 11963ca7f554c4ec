"""Claims that say the same, found inside topics and folded onto the best of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def similar_claims(claims: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, similarity) of pairs a < b of claims (claim_id, text, topic, weight, evidence) that are alike.

    Cosine of character bigrams as sets, .1 more for a shared topic and .05 for each shared
    evidence chunk, at most 1. Pairs meet at bigrams by prefix filtering: at the highest
    boost a pair needs a cosine of least - .1 - .05 n (n: the smaller number of evidence
    chunks), so two alike claims share one of the rarest bigrams of each.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[^\w\s]", ""))
    own = claims.select("claim_id", "topic", "evidence", F.array_sort(F.array_distinct(tx.ngrams(plain))).alias("grams")).where(F.size("grams") > 0)
    counts = own.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    ranked = own.select("claim_id", F.explode("grams").alias("gram")).join(counts, "gram").groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("by_df"))
    floor = F.greatest(F.lit(0.0), least - 0.1 - 0.05 * F.size("evidence"))
    # cosine >= t needs an overlap of t^2 times the own size at least: all but the last ceil(t^2 n) - 1 by frequency are the prefix
    n = F.size("grams")
    held = own.join(ranked, "claim_id").withColumn("prefix", F.slice("by_df", F.lit(1), F.greatest(F.lit(1), n - F.ceil(floor * floor * n).cast("int") + 1)))
    posted = held.select("claim_id", F.explode("prefix").alias("gram"))
    pairs = posted.select(F.col("claim_id").alias("a"), "gram").join(posted.select(F.col("claim_id").alias("b"), "gram"), "gram").where("a < b").select("a", "b").distinct()
    left, right = (own.select(*[F.col(c).alias(f"{c}_{side}") for c in own.columns]) for side in "ab")
    both = pairs.join(left, F.col("a") == F.col("claim_id_a")).join(right, F.col("b") == F.col("claim_id_b"))
    cosine = F.size(F.array_intersect("grams_a", "grams_b")) / F.sqrt(F.size("grams_a") * F.size("grams_b"))
    boost = F.when((F.col("topic_a") == F.col("topic_b")) & (F.col("topic_a") != ""), 0.1).otherwise(0.0) + 0.05 * F.size(F.array_intersect("evidence_a", "evidence_b"))
    return both.select("a", "b", F.round(F.least(F.lit(1.0), cosine + boost), 9).alias("similarity")).where(F.col("similarity") >= least)


def deduplicated(claims: DataFrame, least: float = 0.75) -> DataFrame:
    """(leader, claim_id, members, evidence): clusters around leaders in the order of ids, the claim of most weight, then evidence, kept for each.

    A claim joins the first leader that it is alike; evidence is that of all members, each chunk once.
    """
    from .dedup import leaders

    found = leaders(claims.select(F.col("claim_id").alias("k")), similar_claims(claims, least).select("a", "b"))
    placed = claims.join(found.select(F.col("k").alias("claim_id"), "leader"), "claim_id")
    best = F.max_by("claim_id", F.struct("weight", F.size("evidence"), -F.col("claim_id")))
    return placed.groupBy("leader").agg(best.alias("claim_id"), F.count("*").alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
