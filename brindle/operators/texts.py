"""Text operators over whole tables: chunking, TF-IDF, similarity of names, citations, rule tables."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def budget_chunks(docs: DataFrame, doc_id: str, text: str, budget: int, separator: str = "\n\n") -> DataFrame:
    """(doc_id, chunk, text): parts joined while their token estimate stays within the budget; a longer part stands alone.

    A fold inside each row, so nothing is shuffled; the chunks joined give the text back.
    """
    parts = F.split(F.col(text), separator.replace("\\", "\\\\"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    size = lambda t: F.floor(F.length(t) / 4)

    def add(acc, part):
        joined = F.concat(acc["open"], F.lit(separator), part)
        fits = size(joined) <= budget
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), part.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), part.alias("open")))

    folded = F.aggregate(parts, empty, add, lambda a: F.concat(a["done"], F.array(a["open"])))
    return docs.where(F.col(text).isNotNull()).select(doc_id, F.posexplode(folded).alias("chunk", "text"))


#: Characters of the texts of a block.
BLOCK_CHARS = 8_000_000


def by_frequency(docs: DataFrame, doc_id: str, text: str, least_length: int, run: Callable, schema: str, least: int = 1) -> DataFrame:
    """What run makes of each document's words and their document frequencies.

    run(counts, df) gets a document's term counts and the frequencies of the terms in its
    block, of those in at least so many documents, and gives the rows after doc_id.
    Whole texts are dealt once to blocks by document; a block asks for each of its terms
    once, so that no row of a document and a term is shuffled. Blocks grow with the texts
    (counted first).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BLOCK_CHARS))
    own = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).repartition(n, "block").select("block", "doc_id", tx.tokens(F.col("t"), least_length).alias("w"))
    once = own.select("block", "doc_id", F.explode(F.array_distinct("w")).alias("term")).groupBy("block", "doc_id", "term").agg(F.lit(1).alias("x"))
    here = once.groupBy("block", "term").agg(F.count("*").alias("c"))
    df = here.groupBy("term").agg(F.sum("c").alias("df")).where(F.col("df") >= least)
    asked = here.select(F.col("block").alias("at"), "term").join(df, "term")

    def block(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        frequency = dict(zip(known["term"], known["df"], strict=True))
        out = []
        for k, words in texts.groupby("doc_id", dropna=False)["w"]:
            counts = Counter(w for x in words for w in x)
            out += [(k, *r) for r in run(counts, frequency)] if counts else []
        return pd.DataFrame(out, columns=["doc_id", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    return own.groupBy("block").cogroup(asked.groupBy("at")).applyInPandas(block, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def tfidf(docs: DataFrame, doc_id: str, text: str, top: int) -> DataFrame:
    """(doc_id, term, score): the most distinctive terms of each document by tf ln(N / df); ties by the term.

    A block gives the terms that are among a document's best before scores are rounded, all equal ones too.
    """
    total = docs.count()

    def best(counts: Counter, frequency: dict) -> list[tuple]:
        found = [(n * math.log(total / frequency[w]), w, n, frequency[w]) for w, n in counts.items()]
        floor = heapq.nlargest(top, (x[0] for x in found))[-1] - 1e-5
        return [x[1:] for x in found if x[0] >= floor]

    found = by_frequency(docs, doc_id, text, 2, best, "term string, tf long, df long")
    scored = found.select("doc_id", "term", F.round(F.col("tf") * F.log(F.lit(total) / F.col("df")), 6).alias("score"))
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select("doc_id", "term", "score")


def known_share(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc_id, known_share): the share of a document's words that so many documents use; none for documents without words."""

    def share(counts: Counter, frequency: dict) -> list[tuple]:
        return [(sum(n for w, n in counts.items() if w in frequency), sum(counts.values()))]

    found = by_frequency(docs, doc_id, text, 1, share, "known long, words long", least)
    return found.select("doc_id", F.round(F.col("known") / F.col("words"), 6).alias("known_share"))


def jaro_winkler(a: str, b: str, prefix_scale: float = 0.1) -> float:
    """Whole transpositions count by halves, rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * prefix_scale * (1 - jaro)


def name_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with jaro_winkler and combined: equal 1, one inside the other .9, else .5 JW + .3 Levenshtein + .2 bigram cosine."""

    @F.pandas_udf("double")
    def jw(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(p or "", q or "") for p, q in zip(x, y, strict=True)])

    @F.pandas_udf("double")
    def bigram_cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            c: list[dict[str, int]] = [{}, {}]
            for k, s in enumerate((p or "", q or "")):
                for i in range(len(s) - 1):
                    c[k][s[i : i + 2]] = c[k].get(s[i : i + 2], 0) + 1
            top = sum(n * c[1].get(g, 0) for g, n in c[0].items())
            size = (sum(n * n for n in c[0].values()) * sum(n * n for n in c[1].values())) ** 0.5
            out.append(top / size if size else 0.0)
        return pd.Series(out)

    x, y = F.col(a), F.col(b)
    out = pairs.withColumns({"jaro_winkler": jw(x, y), "_cosine": bigram_cosine(x, y)})
    mixed = 0.5 * F.col("jaro_winkler") + 0.3 * tx.levenshtein_similarity(x, y) + 0.2 * F.col("_cosine")
    return out.withColumn("combined", F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(mixed)).drop("_cosine")


def validate_citations(df: DataFrame, text: str, chunks: int) -> DataFrame:
    """df with total, invalid, valid: [chunk-N] marks against N below chunks; other brackets are ignored."""
    ids = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\[chunk-(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    bad = F.size(F.filter(ids, lambda x: x >= chunks)).cast("long")
    total = F.size(ids).cast("long")
    return df.withColumns({"total": total, "invalid": bad, "valid": (bad == 0) & (total > 0)})


def rule_scores(docs: DataFrame, rules: list[tuple[str, str, float, int]], text: str = "text", floor: float = 0.5) -> DataFrame:
    """docs with a column per class, the sum of weight * min(matches, cap) of its patterns, and kind, the best class (first on ties) or Unknown below floor."""
    classes = list(dict.fromkeys(r[0] for r in rules))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scores = {c: sum((w * F.least(F.regexp_count(low, F.lit(p)), F.lit(cap)) for k, p, w, cap in rules if k == c), F.lit(0.0)) for c in classes}
    out = docs.withColumns(scores)
    best = F.greatest(*[F.col(c) for c in classes]) if len(classes) > 1 else F.col(classes[0])
    kind = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in classes])
    return out.withColumn("kind", F.when(best < floor, "Unknown").otherwise(kind))
