"""Corrections of recognised text in four phases: characters, character pairs, whole words, dictionary.

The first three phases stay inside the row. Character rules look at both neighbours in
the text as it came: a corrected character is written as a mark that counts as what it
was, until all rules are through.

The dictionary phase looks up each distinct unknown word once, within two edits, by keys
that both sides share: short words by the strings that are left when up to two letters
are deleted, longer ones by thirds of the dictionary's word at about the same place (two
edits leave one of three parts as it is). What meets is checked by the exact distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize

# Fixed values.
LETTER_TO_NUMBER = {"O": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2"}
NUMBER_TO_LETTER = {"0": "O", "1": "l", "5": "S", "8": "B", "2": "Z"}
PAIRS = {"rn": "m", "vv": "w", "VV": "W", "cl": "d", "ii": "ü", "fi": "fi", "fl": "fl", "l0": "10", "O0": "00", "0O": "00", " ,": ",", " .": ".", ",,": '"', "` ": "'", " '": "'"}
WORDS = {"l": "I", "i": "I", "tne": "the", "tn": "in", "oI": "of", "ancl": "and", "wlll": "will", "can't": "can't", "dont": "don't", "doesnt": "doesn't", "wont": "won't", "cant": "can't", "flve": "five", "nlne": "nine"}
DISTANCE = 2
#: Up to this length a word is looked up by deletions.
SHORT = 16
#: Private characters that stand for corrected letters and digits.
_FROM_LETTER = {c: chr(0xE000 + k) for k, c in enumerate(LETTER_TO_NUMBER)}
_FROM_NUMBER = {c: chr(0xE010 + k) for k, c in enumerate(NUMBER_TO_LETTER)}
_LETTERS = f"A-Za-z{''.join(_FROM_LETTER.values())}"
_DIGITS = f"0-9{''.join(_FROM_NUMBER.values())}"


def characters(text: Column) -> tuple[Column, Column]:
    """(text, corrections): letters between digits become digits and digits between letters become letters; a text's edge counts as either."""
    out = text
    # the character stands first in a pattern, so that neighbours are looked at only where it is
    for c, mark in _FROM_LETTER.items():
        out = F.regexp_replace(out, f"{c}(?<![^{_DIGITS}]{c})(?![^{_DIGITS}])", mark)
    for c, mark in _FROM_NUMBER.items():
        out = F.regexp_replace(out, f"{c}(?<![^{_LETTERS}]{c})(?![^{_LETTERS}])", mark)
    marks = "".join(_FROM_LETTER.values()) + "".join(_FROM_NUMBER.values())
    return F.translate(out, marks, "".join(LETTER_TO_NUMBER.values()) + "".join(NUMBER_TO_LETTER.values())), F.length(out) - F.length(F.translate(out, marks, ""))


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _fixed_word(w: Column) -> Column:
    """The correction of a whole word, null without one; a capital stays where the correction is plain lower case."""
    bare = F.regexp_extract(w, r"^\s*(.*?)\s*$", 1)
    fix = F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), F.lower(bare))
    capital = fix.rlike(r"^\p{Ll}+$") & bare.rlike(r"^\p{Lu}")
    told = F.when(capital, F.concat(F.upper(F.substring(fix, 1, 1)), F.substring(fix, F.lit(2), F.length(fix)))).otherwise(fix)
    whole = F.concat(F.regexp_extract(w, r"^\s*", 0), told, F.when(bare == "", "").otherwise(F.regexp_extract(w, r"\s*$", 0)))
    # few words pass this, and only they meet the patterns
    return F.when(F.lower(F.translate(w, "\t\n\x0b\f\r", "")).isin(list(WORDS)), whole)


def corrected(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, corrections): the first three phases; a null text stays null with no corrections."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("t"))
    fixed, n = characters(F.col("t"))
    rows = rows.select("key", fixed.alias("t"), n.alias("n1"))
    rows = rows.withColumn("_s0", F.col("t"))
    count = F.lit(0)
    for k, (wrong, right) in enumerate(PAIRS.items()):  # a column a rule, so that each is computed once
        before, after = F.col(f"_s{k}"), F.col(f"_s{k + 1}")
        rows = rows.withColumn(f"_s{k + 1}", F.replace(before, F.lit(wrong), F.lit(right)))
        count = count + (F.length(before) - F.length(after) if len(wrong) != len(right) else _count(F.col("t"), wrong) - _count(after, wrong))
    words = F.split(F.col(f"_s{len(PAIRS)}"), " ", -1)
    rows = rows.select("key", "n1", count.alias("n2"), F.transform(words, lambda w: F.struct(w.alias("w"), _fixed_word(w).alias("f"))).alias("words"))
    out = F.array_join(F.transform("words", lambda x: F.coalesce(x["f"], x["w"])), " ")
    n3 = F.size(F.filter("words", lambda x: x["f"].isNotNull()))
    return rows.select(F.col("key").alias(key), F.when(F.col("words").isNotNull(), out).alias(text), F.coalesce(F.col("n1") + F.col("n2") + n3, F.lit(0)).alias("corrections"))


def _deletions(word: Column, most: int) -> Column:
    """The word and all strings that are left of it without up to so many letters."""
    def one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    found = [F.array(word)]
    for _ in range(most):
        found.append(F.array_distinct(F.flatten(F.transform(found[-1], lambda w: F.when(F.length(w) > 0, one(w)).otherwise(F.array().cast("array<string>"))))))
    return F.array_distinct(F.flatten(F.array(*found)))


def _thirds(word: Column, length: Column, shift: int) -> Column:
    """Keys (length, part, string) of the parts of a word of that length, taken from word at up to so many places aside."""
    def part(k: int) -> list[Column]:
        start, end = F.floor(length * k / 3), F.floor(length * (k + 1) / 3)
        size = (end - start).cast("int")
        return [F.when((start + s >= 0) & (start + s + size <= F.length(word)), F.concat_ws("\x00", length.cast("string"), F.lit(str(k)), F.substring(word, (start + s + 1).cast("int"), size))) for s in range(-shift, shift + 1)]

    return F.array_distinct(F.array_compact(F.array(*[c for k in range(3) for c in part(k)])))


def closest(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, match, distance) of words (word) that have a dictionary word (word, place) within two edits, case aside: the nearest, ties by place.

    Keys meet by sort and merge: shuffled keys are small when compressed, and broadcast
    would be unpacked in the driver.
    """
    own = words.select("word", F.lower("word").alias("low"), F.length("word").alias("len")).distinct()
    known = dictionary.select(F.col("word").alias("match"), "place", F.lower("word").alias("match_low"), F.length("word").alias("match_len"))
    short = own.where(F.col("len") <= SHORT).select("word", "low", F.explode(_deletions(F.col("low"), DISTANCE)).alias("k"))
    short_known = known.where(F.col("match_len") <= SHORT + DISTANCE).select("match", "place", "match_low", F.explode(_deletions(F.col("match_low"), DISTANCE)).alias("k"))
    around = reduce(lambda a, b: F.concat(a, b), [_thirds(F.col("low"), F.col("len") + d, DISTANCE) for d in range(-DISTANCE, DISTANCE + 1)])
    long = own.where(F.col("len") > SHORT).select("word", "low", F.explode(F.array_distinct(around)).alias("k"))
    long_known = known.where(F.col("match_len") > SHORT - DISTANCE).select("match", "place", "match_low", F.explode(_thirds(F.col("match_low"), F.col("match_len"), 0)).alias("k"))
    met = short.join(short_known.hint("merge"), "k").drop("k").union(long.join(long_known.hint("merge"), "k").drop("k")).distinct()
    near = met.withColumn("distance", F.levenshtein("low", "match_low", DISTANCE)).where("distance between 0 and 2")
    return near.groupBy("word").agg(F.min_by(F.struct("match", "distance"), F.struct("distance", "place")).alias("m")).select("word", "m.match", "m.distance")


def by_dictionary(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, text, corrections): each unknown word of three letters and more becomes the closest dictionary word.

    Words stand between spaces, edge punctuation aside. Only distinct words are looked
    up, and only words with a correction come back to their texts.
    """
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"^\s+|\s+$", ""), r"^[.,!?;:]+|[.,!?;:]+$", "")
    rows = materialize(texts.select(F.col(key).alias("key"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row")))
    parts = F.split("t", " ", -1)
    used = rows.select("row", F.explode(F.array_distinct(F.transform(parts, bare))).alias("word")).where(F.length("word") >= 3)
    unknown = used.select("word").distinct().join(dictionary.select(F.lower("word").alias("_low")).hint("merge"), F.lower("word") == F.col("_low"), "left_anti")
    fixes = materialize(closest(unknown, dictionary))
    own = used.join(fixes.select("word", "match").hint("merge"), "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "match"))).alias("fix"))
    both = rows.join(own.hint("merge"), "row", "left").select("key", "t", F.transform(parts, lambda w: F.struct(w.alias("w"), bare(w).alias("b"), F.col("fix")[bare(w)].alias("f"))).alias("words"))
    told = F.transform("words", lambda x: F.when(x["f"].isNotNull(), F.replace(x["w"], x["b"], x["f"])).otherwise(x["w"]))
    return both.select(F.col("key").alias(key), F.array_join(told, " ").alias(text), F.coalesce(F.size(F.filter("words", lambda x: x["f"].isNotNull())), F.lit(0)).alias("corrections"))
