"""Markdown as rows: sections by headings, heading paths, merged chunks, typed segments, titles and page markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def heading_level(line: Column) -> Column:
    """Number signs at the start of a line that a space follows; zero without any."""
    return F.length(F.regexp_extract(line, "^(#+) ", 1))


def tokens(text: Column, per: int = 4) -> Column:
    return F.floor(F.length(text) / per).cast("long")


def sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_level: int = 2) -> DataFrame:
    """(doc_id, n, heading, level, content): text cut at headings of at most max_level.

    What stands before the first heading is a section without one (level 0); deeper
    headings are content; lines with a page marker are left out. Null texts give no rows.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("i", "line")).where(~F.col("line").rlike(PAGE))
    level = heading_level(F.col("line"))
    marked = lines.withColumn("lv", F.when((level > 0) & (level <= max_level), level).otherwise(0))
    inside = marked.withColumn("sec", F.sum(F.when(F.col("lv") > 0, 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("i")))
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("lv") == 0, F.struct("i", "line")))), lambda x: x["line"])
    head = F.coalesce(F.max(F.when(F.col("lv") > 0, F.regexp_replace("line", "^[# ]+", ""))), F.lit(""))
    cut = inside.groupBy("doc_id", "sec").agg(head.alias("heading"), F.max("lv").alias("level"), stripped(F.array_join(own, "\n")).alias("content"))
    return cut.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("sec"))).select("doc_id", "n", "heading", "level", "content")


#: A page marker, fixed format.
PAGE = r"<!-- PAGE:(\d+)(?:-(\d+))? -->"


def page_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_page, last_page, pages): from page markers; without any the pages are estimated at 500 words each."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PAGE), F.lit(1))
    ends = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"<!-- PAGE:(?:\d+-)?(\d+) -->"), F.lit(1))
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+"), lambda w: w != ""))
    first, last = F.array_min(F.transform(found, lambda x: x.cast("long"))), F.array_max(F.transform(ends, lambda x: x.cast("long")))
    estimate = F.greatest(F.lit(1), F.ceil(words / 500)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), first.alias("first_page"), last.alias("last_page"), F.coalesce(last - first + 1, estimate).alias("pages"))


def heading_paths(cut: DataFrame) -> DataFrame:
    """sections with path: the open headings, a stack that is cut to level - 1 entries before a heading goes on it."""
    own = F.array_sort(F.collect_list(F.struct("n", "heading", "level")))
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def push(acc: Column, s: Column) -> Column:
        kept = F.slice(acc["stack"], F.lit(1), F.greatest(s["level"] - 1, F.lit(0)))
        stack = F.when(s["heading"] != "", F.array_append(kept, s["heading"])).otherwise(kept)
        return F.struct(stack.alias("stack"), F.array_append(acc["paths"], F.array_join(stack, " > ")).alias("paths"))

    folded = cut.groupBy("doc_id").agg(own.alias("own")).select("doc_id", "own", F.aggregate("own", empty, push, lambda a: a["paths"]).alias("paths"))
    return folded.select("doc_id", F.posexplode(F.arrays_zip("own", "paths")).alias("at", "x")).select("doc_id", F.col("x.own.n").alias("n"), F.col("x.own.heading").alias("heading"), F.col("x.own.level").alias("level"), F.col("x.paths").alias("path"))


def merged(cut: DataFrame, target: int = 4000, least: int = 500) -> DataFrame:
    """(doc_id, chunk, heading, level, first, last, content): neighbouring sections joined up to target tokens.

    A chunk that a section would carry over target is closed if it has the least
    number of tokens; below that the section joins it all the same. The first
    section's heading is the chunk's, later ones stand in the text.
    """
    own = F.array_sort(F.collect_list(F.struct("n", "heading", "level", "content")))
    inner = lambda s: F.when(s["heading"] == "", s["content"]).otherwise(F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["content"]))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(0).cast("long").alias("used"))

    def add(acc: Column, s: Column) -> Column:
        new = (F.size(acc["ids"]) == 0) | ((acc["used"] + tokens(inner(s)) > target) & (acc["used"] >= least))
        at = acc["id"] + F.when(new, 1).otherwise(0)
        return F.struct(F.array_append(acc["ids"], at).alias("ids"), at.alias("id"), F.when(new, tokens(s["content"])).otherwise(acc["used"] + tokens(inner(s))).alias("used"))

    folded = cut.groupBy("doc_id").agg(own.alias("own")).select("doc_id", "own", F.aggregate("own", start, add, lambda a: a["ids"]).alias("ids"))
    chunks = folded.select("doc_id", F.explode(F.arrays_zip("own", "ids")).alias("x")).groupBy("doc_id", F.col("x.ids").alias("chunk")).agg(F.array_sort(F.collect_list("x.own")).alias("parts"))
    first = F.get("parts", F.lit(0))
    text = F.array_join(F.concat(F.array(first["content"]), F.transform(F.slice("parts", F.lit(2), F.size("parts")), inner)), "\n\n")
    return chunks.select("doc_id", "chunk", first["heading"].alias("heading"), first["level"].alias("level"), first["n"].alias("first"), F.element_at("parts", -1)["n"].alias("last"), stripped(text).alias("content"))


#: Segment types in the order in which a section's segments are listed, with their position weights; fixed values.
WEIGHTS = {"heading": 1.1, "sentence": 1.0, "list": 1.05, "code": 0.9, "quote": 1.1}
TITLE_WEIGHT, EXPOSITORY_CODE = 2.0, 1.15


def segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 15, least_code: int = 10, most_code: int = 500, expository: bool = False) -> DataFrame:
    """(doc_id, n, type, heading, level, text, start_char, end_char, weight): the typed segments of Markdown texts.

    Fenced blocks are code, ``>`` lines quotes, marked lines list items; other lines up to
    a blank one are paragraphs, cut into sentences. Segments shorter than least are
    left out, but for a heading of level one that comes first (the title); offsets
    count the segments as joined by single characters.
    """
    by_doc = W.partitionBy("doc_id").orderBy("i")
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    fence = F.col("line").rlike("^[ \\t]*```")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(by_doc))
    code = F.col("fence") | (F.col("fences") % 2 == 1)
    kind = (
        F.when(code, "code").when(heading_level(F.col("line")) > 0, "heading").when(F.col("line").rlike("^[ \\t]*>"), "quote")
        .when(F.col("line").rlike(r"^[ \t]*([-*+]|\d+[.)])[ \t]+"), "list").when(F.col("line").rlike(r"^[ \t\r]*$"), "blank").otherwise("sentence")
    )
    lines = lines.withColumn("type", kind).withColumn("head", F.when(F.col("type") == "heading", F.struct(F.regexp_replace("line", "^[# ]+", "").alias("heading"), heading_level(F.col("line")).alias("level"))))
    opens = (F.col("type") != F.coalesce(F.lag("type").over(by_doc), F.lit(""))) | F.col("type").isin("list", "heading") | (F.col("fence") & (F.col("fences") % 2 == 1))
    lines = lines.withColumn("opens", opens)
    lines = lines.select("*", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(by_doc).alias("block"), F.count("head").over(by_doc).alias("sec"), F.last("head", True).over(by_doc).alias("under"))
    body = F.when(F.col("type") == "heading", F.regexp_replace("line", "^[# ]+", "")).when(F.col("type") == "list", F.regexp_replace("line", r"^[ \t]*([-*+]|\d+[.)])[ \t]+", "")).when(F.col("type") == "quote", F.regexp_replace("line", "^[ \\t]*>[ ]?", "")).otherwise(F.col("line"))
    kept = lines.where("type <> 'blank' and not fence").withColumn("body", body)
    blocks = kept.groupBy("doc_id", "block", "type", "sec").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]).alias("parts"), F.first("under").alias("under"))
    whole = F.when(F.col("type") == "code", F.array_join("parts", "\n")).otherwise(stripped(F.array_join("parts", " ")))
    from ..functions.text import sentences

    made = blocks.withColumn("whole", whole).withColumn("pieces", F.when(F.col("type") == "sentence", sentences(F.col("whole"))).otherwise(F.array("whole")))
    rows = made.select("doc_id", "sec", "type", "block", "under", F.posexplode("pieces").alias("part", "text"))
    order = F.coalesce(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(WEIGHTS)])
    title = (F.col("type") == "heading") & (F.col("under.level") == 1) & (F.col("sec") == 1) & (F.col("before") == 0)
    by_place = W.partitionBy("doc_id").orderBy("sec", "order", "block", "part")
    fits = F.when(F.col("type") == "code", F.col("chars") >= least_code).otherwise(F.col("chars") >= least)
    rows = rows.withColumns({"order": order, "chars": F.length("text")}).withColumn("fits", fits)
    rows = rows.withColumn("before", F.sum(F.when(F.col("fits"), 1).otherwise(0)).over(by_place) - F.when(F.col("fits"), 1).otherwise(0)).withColumn("title", title).where("fits or (title and text <> '')")
    long = (F.col("type") == "code") & (F.col("chars") > most_code)
    cut = F.when(long, F.concat(F.substring("text", 1, most_code), F.lit("..."))).otherwise(F.col("text"))
    rows = rows.withColumns({"text": cut, "chars": F.when(long, most_code + 3).otherwise(F.col("chars"))})
    weight = F.when(F.col("title"), F.lit(TITLE_WEIGHT)).otherwise(F.coalesce(*[F.when(F.col("type") == t, F.lit(EXPOSITORY_CODE if expository and t == "code" else w)) for t, w in WEIGHTS.items()]))
    end = F.sum(F.col("chars") + 1).over(by_place) - 1
    numbered = rows.select("doc_id", F.row_number().over(by_place).alias("n"), "type", F.coalesce("under.heading", F.lit("")).alias("heading"), F.coalesce("under.level", F.lit(0)).alias("level"), "text", (end - F.col("chars")).alias("start_char"), end.alias("end_char"), weight.alias("weight"))
    return numbered


def titles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """(doc_id, title, body): the title of the front matter, else the first heading of level one, else the name; body without front matter."""
    t = F.coalesce(F.col(text), F.lit(""))
    front = F.regexp_extract(t, r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    body = F.regexp_replace(t, r"(?s)^---[ \t]*\n.*?\n---[ \t]*(?:\n|$)", "")
    said = F.regexp_replace(F.trim(F.regexp_extract(front, r"(?m)^title:[ \t]*([^\n]+)$", 1)), "^[\"']|[\"']$", "")
    head = F.trim(F.regexp_extract(body, r"(?m)^# ([^\n]+)$", 1))
    file = F.regexp_replace(F.regexp_extract(F.coalesce(F.col(name), F.lit("")), r"([^/]*)$", 1), r"\.[^.]*$", "") if name else F.lit("Untitled")
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.nullif(said, F.lit("")), F.nullif(head, F.lit("")), file).alias("title"), body.alias("body"))
