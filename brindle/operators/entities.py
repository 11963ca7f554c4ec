"""Names of persons and places in prose: spans of proper nouns, and the simpler list of capitalised words.

A token either can carry a span on or cannot; spans are what is left of the runs of such
tokens from their first token that can open one. All of it is done inside the row with
array and string functions, in one pass over a text's tokens; what is shuffled are a
text's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values, compared without regard to case.
HONORIFICS = "mr. mr mrs. mrs miss ms. ms dr. dr captain inspector professor sir lady lord colonel major".split()
PLACES = "street st wharf yard road lane court avenue place square".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTHS = "january february march april may june july august september october november december".split()
STOP = """i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself
we us our ours ourselves they them their theirs themselves who whom whose which what that this these those
one ones someone anyone everyone nobody
the a an some any no every each either neither all both half several many much few little other another
however therefore moreover furthermore nevertheless nonetheless meanwhile otherwise instead indeed thus hence accordingly
yet still also too even just only perhaps maybe although though while when where because since unless
but and or nor so for after before until during
chapter part book section volume page note notes introduction conclusion summary appendix index contents
here there now then today tomorrow yesterday yes well oh ah alas
baker street wharf east west north south morning afternoon evening night day week month year
project gutenberg foundation archive literary license ebook copyright trademark donations volunteers how why whether
let could would should must shall will may might
island river lake mountain valley forest garden park castle palace house hall tower bridge gate door""".split()
CODE = """mov movx call ret jmp jnz jz push pop add sub mul div dim sub function end if then else for next do loop while
int void char float double bool string null true false api http json xml html css url uri sql rest get post put delete
cpu gpu ram rom bios fpga asic vhdl hdl rtl id io ui ux os vm sdk ide cli gui""".split()
CODE_SIGNS = ["```", "function", "class", "void", "int ", "return", "if (", "for (", "while (", "0x", "mov ", "call ", "push ", "pop ", "fpga", "vhdl", "register", "memory address"]
COMMON = """the a an and or but in on at to for of with as by from up about into over after this that these
those it its is are was were be been being have has had do does did will would could should may might must
shall can need not no yes all each every both few more most other some such only own same so than too
very just also now here there when where why how what which who whom whose if then else because although though
while whereas however therefore thus hence accordingly consequently""".split()
MOST_NAMES = 12
MOST_SIMPLE = 10
TITLE = r"^\p{Lu}[\p{Ll}']+$"
TITLE_WORD = r"^\p{Lu}[\p{Ll}'\-]*$"
ACRONYM = r"^\p{Lu}{1,5}$"
EDGES = r"""[,.!?;:"'()\[\]{}—–]"""


def looks_like_code(text: Column) -> Column:
    """Three or more of the signs of program text."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(s)).cast("int") for s in CODE_SIGNS), F.lit(0)) >= 3


def spans(text: Column) -> Column:
    """The spans of proper nouns in the order of the text: an opening token (honorific or capitalised, no stop word, no code word, no acronym) with all that carry it on (places, honorifics, capitalised tokens)."""
    bare = F.transform(F.split(text, "[ \n\r\t]"), lambda t: F.regexp_replace(t, rf"^{EDGES}+|{EDGES}+$", ""))
    tokens = F.filter(bare, lambda t: t.rlike(r"[^\s\p{Z}]"))

    def marked(t: Column) -> Column:
        low, title = F.lower(t), t.rlike(TITLE)
        goes_on = title | low.isin(*PLACES, *HONORIFICS)
        opens = (title | low.isin(*HONORIFICS)) & ~low.isin(*STOP, *CODE) & ~t.rlike(ACRONYM)
        return F.when(opens, F.concat(F.lit("\x02"), t)).when(goes_on, F.concat(F.lit("\x03"), t)).otherwise(F.lit("\x01"))

    runs = F.split(F.array_join(F.transform(tokens, marked), " "), "\x01")
    found = F.transform(runs, lambda r: F.trim(F.translate(F.regexp_extract(r, "\x02[^\x01]*$", 0), "\x02\x03", "")))
    return F.filter(found, lambda s: F.length(s) > 2)


def _first(name: Column) -> Column:
    return F.lower(F.substring_index(name, " ", 1))


def proper_nouns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: Column | None = None, most: int = MOST_NAMES) -> DataFrame:
    """(doc_id, place, name, n): a text's names, the most frequent first (ties: the first in the text).

    Spellings that differ in case are one name, written as it stands first. A single word
    counts from two times on. kind is the content type: expository texts have no names,
    and unknown ones (the default) none if they look like code. Null and empty texts have
    none; rows of one id count as one text, in any order of rows by their place.
    """
    kind = F.lit("unknown") if kind is None else kind
    body = F.coalesce(F.col(text), F.lit(""))
    read = F.when((kind == "expository") | ((kind == "unknown") & looks_like_code(body)), F.lit("")).otherwise(body)
    each = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(spans(read)).alias("at", "name"))
    grouped = each.groupBy("doc_id", F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("at").alias("at"), F.min_by("name", "at").alias("name"))
    name, low, words = F.col("name"), F.col("key"), F.split("name", " ")
    single = F.size(words) == 1
    named = F.forall(words, lambda w: F.lower(w).isin(*HONORIFICS) | (~single & F.lower(w).isin(*PLACES)) | w.rlike(TITLE_WORD))
    bad = (single & low.isin(*STOP)) | (_first(name).isin(*STOP) & ~_first(name).isin(*HONORIFICS)) | low.isin(*DAYS, *MONTHS, *PLACES, *HONORIFICS, *CODE) | name.rlike(ACRONYM) | (single & (F.col("n") < 2)) | ~named
    order = W.partitionBy("doc_id").orderBy(F.desc("n"), "at", "name")
    kept = grouped.where(~bad).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return kept.select("doc_id", "place", "name", "n")


def capitalised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_SIMPLE) -> DataFrame:
    """(doc_id, names): the first distinct capitalised words of more than two letters that are not common words."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda w: w.rlike(r"^\p{Lu}\p{L}{2,}$") & ~F.lower(w).isin(*COMMON))
    return docs.select(F.col(doc_id).alias("doc_id"), F.slice(F.array_distinct(words), 1, most).alias("names"))
