"""Ranking operators: BM25, cosine search, fusion, adaptive top-k and diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..sources.storage import materialize


def count_of(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with a positive score.

    The query's few terms are counted inside each row, so documents are neither
    exploded nor shuffled; one global aggregate gives sizes and document frequencies.
    The counts, a few numbers a document, are kept, so that texts are read once.
    """
    terms = sorted({t.lower() for t in terms})
    if not terms:
        raise ValueError("a query needs a term")
    words = docs.select(F.col(doc_id).alias("doc_id"), tx.tokens(F.col(text)).alias("words"))
    counted = materialize(words.select("doc_id", F.size("words").alias("n"), *[count_of("words", t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    stats = counted.agg(F.count("*").alias("total"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    both = counted.crossJoin(F.broadcast(stats))  # the statistics are one row
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("total") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))).otherwise(0.0)
    return both.select("doc_id", score.alias("score")).where("score > 0")


def cosine_scores(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of all rows that have a vector."""
    return vectors.where(F.col(vector).isNotNull()).select(key, vx.cosine(F.col(vector), vx.literal(query)).alias("similarity"))


def top_k(df: DataFrame, k: int, score: str, key: str) -> DataFrame:
    """The k highest by score; ties by key."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def ranked(df: DataFrame, score: str, key: str, buckets: int | None = None) -> DataFrame:
    """df with its 1-based rank by score (descending, ties by key), without a single-partition sort.

    Rows are cut into ranges of (score, key), so that many equal scores are cut too; each
    range is sorted by itself and its rows are numbered as they lie, shifted by the sizes
    of the ranges before it. The rows are kept once before and once after the cut.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(score), F.asc(key)]
    lying = materialize(materialize(df).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["count"] for r in lying.groupBy(part.alias("p")).count().collect()}  # one row a range
    before, total = {}, 0
    for r in sorted(sizes):
        before[r], total = total, total + sizes[r]
    shift = F.coalesce(*[F.when(part == r, F.lit(c)) for r, c in before.items()], F.lit(0)) if before else F.lit(0)
    return lying.withColumn("rank", (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + shift).cast("long")).drop("_at")


def rrf(lists: list[DataFrame], key: str, k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists of (key, rank): one shuffle for any number of lists."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select(key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for x, w in zip(lists, weights, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("part").alias("rrf_score"))


def hybrid(dense: DataFrame, sparse: DataFrame, salience: DataFrame | None, key: str, k: int = 60, top: int = 25) -> DataFrame:
    """Fusion of dense (similarity), sparse (score > 0) and salience lists; the top rows by fused score, ties by key."""
    lists = [ranked(dense, "similarity", key), ranked(sparse.where("score > 0"), "score", key)]
    if salience is not None:
        lists.append(ranked(salience, "salience", key))
    return top_k(rrf(lists, key, k), top, "rrf_score", key)


def blended(df: DataFrame, alpha: float = 0.6, least: float = 0.3, similarity: str = "similarity", salience: str = "salience") -> DataFrame:
    """Linear blend of similarity and salience for rows of at least that similarity."""
    return df.where(F.col(similarity) >= least).withColumn("score", alpha * F.col(similarity) + (1 - alpha) * F.col(salience))


def adaptive_k(n: Column, share: float = 0.05, least: int = 15, most: int = 100, narrative: bool = False) -> Column:
    """Five percent (half as much again for narrative), within bounds."""
    base = F.ceil(n * F.lit(share))
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(base * 1.5) if narrative else base)).cast("int")


def extraction_target(n: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(10), F.floor(n * F.lit(0.15)))).cast("int")


def per_group_top(df: DataFrame, group: list[str], score: str, key: str, n: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def centroids(vectors: DataFrame, group: str, vector: str = "embedding", unit: bool = True) -> DataFrame:
    """(group, centroid): mean vector by place, of unit length if asked; partial sums before the shuffle."""
    parts = vectors.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("at", "x"))
    means = parts.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centroid"))
    return rows.withColumn("centroid", vx.normalised(F.col("centroid"))) if unit else rows


def mmr(segments: DataFrame, group: str, key: str, vector: str, weight: str, trade: float = 0.7) -> DataFrame:
    """(group, key, rank, salience): greedy marginal relevance inside each group; group sizes are documents' segments.

    Relevance is the cosine to the group's centroid times the weight column; salience falls linearly with the rank.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centre = x.mean(axis=0)
        relevance = x @ (centre / max(np.linalg.norm(centre), 1e-12)) * pdf[weight].to_numpy(float)
        n = len(pdf)
        closest, order, left = np.full(n, -np.inf), [], np.ones(n, bool)
        for i in range(n):
            gain = trade * relevance - (1 - trade) * np.where(np.isinf(closest), 0.0, closest)
            best = int(np.argmax(np.where(left, gain, -np.inf)))
            order.append(best)
            left[best] = False
            closest = np.maximum(closest, x @ x[best])
        out = pdf.iloc[order][[group, key]].copy()
        out["rank"] = np.arange(1, n + 1)
        out["salience"] = 1 - (out["rank"] - 1) / n
        return out

    kinds = segments.schema[group].dataType.simpleString(), segments.schema[key].dataType.simpleString()
    return segments.where(F.col(vector).isNotNull()).select(group, key, vector, weight).groupBy(group).applyInPandas(run, f"{group} {kinds[0]}, {key} {kinds[1]}, rank int, salience double")


def anchors(segments: DataFrame, group: str, key: str, vector: str, k: int = 5) -> DataFrame:
    """(group, key, place): farthest-point anchors of each group, starting from the first key: each next one is least like its nearest anchor (ties: the first key).

    Rounds over all groups at once, so that no group is in one task; a round keeps each
    open row's likeness to its nearest anchor.
    """
    open_ = materialize(segments.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), vx.normalised(F.col(vector)).alias("v"), F.lit(-2.0).alias("near")))
    chosen = None
    for place in range(1, k + 1):
        best = materialize(open_.groupBy("g").agg(F.min_by(F.struct("k", "v"), F.struct("near", "k")).alias("b")).select("g", F.col("b.k").alias("bk"), F.col("b.v").alias("bv")))
        part = best.select("g", F.col("bk").alias("k"), F.lit(place).alias("place"))
        chosen = part if chosen is None else chosen.union(part)
        if place < k:
            open_ = materialize(open_.join(best.withColumnRenamed("g", "bg"), F.col("g").eqNullSafe(F.col("bg"))).where("k <> bk").select("g", "k", "v", F.greatest("near", vx.dot(F.col("v"), F.col("bv"))).alias("near")))
    return chosen.select(F.col("g").alias(group), F.col("k").alias(key), "place")


def hash_embedder(dimensions: int = 64):
    """A deterministic embedder for runs without a model: signed word hashes, unit length."""

    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for series in texts:
            out = []
            for t in series:
                v = np.zeros(dimensions)
                for w in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(w, 0)
                    v[h % dimensions] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return F.pandas_udf(embed, "array<double>")
