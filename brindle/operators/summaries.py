"""Collections of works, and summaries by map and ordered reduce within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Words of table-of-contents headings and of collections' titles; fixed values.
TOC = ["table of contents", "contents", "index", "list of plays", "list of works", "dramatis personae"]
COLLECTIONS = ["complete works", "collected works", "collected poems", "collected stories", "anthology", "selected works", "the works of", "plays of", "complete plays"]
#: Headings of plays and of chapters, in any case; fixed patterns.
PLAY = r"^(THE\s+)?(TRAGEDY|COMEDY|HISTORY|LIFE|FAMOUS HISTORY)\s+OF\s+|^(A\s+)?(MIDSUMMER|WINTER'?S|MERCHANT)"
CHAPTER = r"^(chapter|part|book|act|scene|section|volume)\s*[ivxlcdm\d]+\b|^[ivxlcdm]+\.?\s*$|^\d+\.?\s*$|^(prologue|epilogue|introduction|preface|conclusion)\s*$"


def toc_entry(line: Column) -> Column:
    """A line of a table of contents without its number, dots and page."""
    out = F.regexp_replace(line, r"\.{2,}\s*\d+$", "")
    out = F.regexp_replace(out, r"^\d+\.\s*", "")
    return F.trim(F.regexp_replace(out, r"\s+\d+$", ""))


def _holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def collections(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, works, chapters, toc_entries, confidence, chaptered, is_collection, strategy) of sections (doc_id, n, heading, level, content).

    Distinct works are headings of level one that are neither chapters nor tables of
    contents. Confidence adds up their number, the entries of the first table of
    contents, the title and three plays; a fifth of it for a book of chapters (over .7 of
    the headings, three at least).
    """
    heading = F.trim("heading")
    first = F.col("level") == 1
    chapter = heading.rlike("(?i)" + CHAPTER)
    toc = _holds(heading, TOC)
    entries = F.array_distinct(F.filter(F.transform(F.split("content", "\n"), lambda x: toc_entry(F.regexp_replace(x, r"^[ \t]*([-*+]|\d+[.)])[ \t]+", ""))), lambda x: F.length(x) > 3))
    per = sections.groupBy("doc_id").agg(
        F.count_if(first).alias("h1"), F.count_if(first & chapter).alias("chapters"), F.count_if(first & ~chapter & ~toc).alias("works"), F.count_if(first & heading.rlike("(?i)" + PLAY)).alias("plays"),
        F.coalesce(F.min_by(F.when(toc, F.size(entries)), F.when(toc, F.col("n"))), F.lit(0)).cast("long").alias("toc_entries"),
    ).join(titles.select("doc_id", "title"), "doc_id", "left")
    works, found = F.col("works"), F.col("toc_entries")
    score = F.when(works >= 10, 0.4).when(works >= 5, 0.3).when(works >= 3, 0.2).otherwise(0.0) + F.when(found >= 10, 0.3).when(found >= 5, 0.2).when(found > 0, 0.1).otherwise(0.0)
    score = score + F.when(_holds(F.coalesce("title", F.lit("")), COLLECTIONS), 0.2).otherwise(0.0) + F.when(F.col("plays") >= 3, 0.3).otherwise(0.0)
    chaptered = (F.col("chapters") > 0.7 * F.col("h1")) & (F.col("chapters") >= 3)
    confidence = F.round(F.least(F.lit(1.0), score) * F.when(chaptered, 0.2).otherwise(1.0), 6)
    is_collection = ~chaptered & ((confidence >= 0.6) | (works >= 3))
    strategy = F.when(works > 20, "index").when(works > 10, "sampled").otherwise("full")
    return per.select("doc_id", "works", "chapters", "toc_entries", confidence.alias("confidence"), chaptered.alias("chaptered"), is_collection.alias("is_collection"), strategy.alias("strategy"))


def batches(parts: DataFrame, group: str, order: str, text: str, budget: int, share: float = 0.85) -> DataFrame:
    """(group, order, text, batch): parts in order, a batch ends before a part that would carry it over its share of the budget."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(0).cast("long").alias("used"))

    def add(acc: Column, p: Column) -> Column:
        size = tx.token_estimate(p["t"])
        new = (F.size(acc["ids"]) == 0) | (acc["used"] + size > budget * share)
        at = acc["id"] + F.when(new, 1).otherwise(0)
        return F.struct(F.array_append(acc["ids"], at).alias("ids"), at.alias("id"), F.when(new, size).otherwise(acc["used"] + size).alias("used"))

    folded = parts.groupBy(group).agg(own.alias("own")).select(group, "own", F.aggregate("own", start, add, lambda a: a["ids"]).alias("ids"))
    return folded.select(group, F.explode(F.arrays_zip("own", "ids")).alias("x")).select(group, F.col("x.own.o").alias(order), F.col("x.own.t").alias(text), F.col("x.ids").alias("batch"))


def extract(text: Column, most: int = 200) -> Column:
    """The mapped summary of a part: its first sentence, at most so long."""
    return tx.truncate_at_word(F.coalesce(F.get(tx.sentences(text), F.lit(0)), F.lit("")), most)


def map_reduce(parts: DataFrame, group: str, order: str, text: str, budget: int = 400, most_rounds: int = 10) -> DataFrame:
    """(group, rounds, summary): every part mapped to a short text, then batches in order joined and shortened until one is left of each group.

    A group whose batches do not get fewer is halved each round by joining neighbours, so the loop ends.
    """
    from ..sources.storage import materialize

    now = parts.select(group, F.col(order).cast("long").alias("o"), extract(F.col(text)).alias("t"))
    for done in range(1, most_rounds + 1):
        cut = batches(now, group, "o", "t", budget)
        counts = cut.groupBy(group).agg(F.max("batch").alias("batches"), F.count("*").alias("parts"))
        stuck = (F.col("batches") == F.col("parts")) & (F.col("parts") > 1)
        cut = cut.join(counts, group).withColumn("batch", F.when(stuck, F.floor((F.col("batch") - 1) / 2).cast("int")).otherwise(F.col("batch")))
        joined = cut.groupBy(group, F.col("batch").cast("long").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]).alias("ts"))
        now = materialize(joined.select(group, "o", F.when(F.size("ts") > 1, tx.truncate_at_word(F.array_join("ts", " "), budget * 2)).otherwise(F.get("ts", F.lit(0))).alias("t")))
        if now.groupBy(group).count().where("count > 1").isEmpty():
            break
    return now.select(group, F.lit(done).alias("rounds"), F.col("t").alias("summary"))
