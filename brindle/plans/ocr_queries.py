"""Corrections of texts as if they had been recognised from images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ocr
from .registry import query, table


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _steps() -> tuple[str, str]:
    """The nested tables of the pair rules, and the sum of their corrections."""
    tables, count = [], []
    for k, (wrong, right) in enumerate(ocr.PAIRS.items()):
        tables.append(f"s{k + 1} AS (SELECT *, replace(t{k}, {_quoted(wrong)}, {_quoted(right)}) AS t{k + 1} FROM s{k})")
        n = lambda t: f"(length({t}) - length(replace({t}, {_quoted(wrong)}, ''))) // {len(wrong)}"  # noqa: B023, E731
        count.append(f"length(t{k}) - length(t{k + 1})" if len(wrong) != len(right) else f"({n('t0')} - {n(f't{k + 1}')})")
    return ",\n ".join(tables), " + ".join(count)


_LAST = len(ocr.PAIRS)
_TABLES, _PAIR_COUNT = _steps()
_TO_NUMBER = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in ocr.LETTER_TO_NUMBER.items()) + "}"
_TO_LETTER = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in ocr.NUMBER_TO_LETTER.items()) + "}"
_WORDS = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in ocr.WORDS.items()) + "}"
_AROUND = lambda kind: f"(i = 1 OR regexp_matches(c[i - 1], '^{kind}$')) AND (i = len(c) OR regexp_matches(c[i + 1], '^{kind}$'))"
_BARE = r"regexp_extract(w, '^\s*(.*?)\s*$', 1)"


@query(
    rf"""WITH ch AS (SELECT doc_id, text, string_split(text, '') AS c FROM documents),
 fx AS (SELECT doc_id, text, list_transform(c, lambda x, i: CASE WHEN x IN ('O', 'l', 'I', 'S', 'B', 'Z') AND {_AROUND('[0-9]')} THEN {_TO_NUMBER}[x] WHEN x IN ('0', '1', '5', '8', '2') AND {_AROUND('[A-Za-z]')} THEN {_TO_LETTER}[x] END) AS f, c FROM ch),
 s0 AS (SELECT doc_id, len(list_filter(f, lambda x: x IS NOT NULL)) AS n1, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(c, lambda x, i: coalesce(f[i], x)), '') END AS t0 FROM fx),
 {_TABLES},
 wd AS (SELECT doc_id, n1, {_PAIR_COUNT} AS n2, string_split(t{_LAST}, ' ') AS l FROM s{_LAST}),
 wf AS (SELECT doc_id, n1, n2, l, list_transform(l, lambda w: CASE WHEN {_WORDS}[lower({_BARE})] IS NOT NULL THEN regexp_extract(w, '^\s*') || CASE WHEN regexp_matches({_WORDS}[lower({_BARE})], '^\p{{Ll}}+$') AND regexp_matches({_BARE}, '^\p{{Lu}}') THEN upper({_WORDS}[lower({_BARE})][1]) || {_WORDS}[lower({_BARE})][2:] ELSE {_WORDS}[lower({_BARE})] END || regexp_extract(w, '\s*$') END) AS f FROM wd)
 SELECT doc_id, array_to_string(list_transform(l, lambda w, i: coalesce(f[i], w)), ' ') AS text, coalesce(CAST(n1 + n2 + len(list_filter(f, lambda x: x IS NOT NULL)) AS INT), 0) AS corrections FROM wf"""
)
def m13_ocr_corrections(spark, d):
    """Characters, pairs and whole words of every text corrected."""
    return ocr.corrected(table(spark, d, "documents"), "doc_id", "text")


_PLAIN = "translate(lower({}), 'äçèéêíñóöüßáàâî', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(11) || chr(12) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18))"
_EDGE = r"regexp_replace(regexp_replace(w, '^\s+|\s+$', '', 'g'), '^[.,!?;:]+|[.,!?;:]+$', '', 'g')"


@query(
    rf"""WITH df AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+'))) AS word FROM documents), di AS (SELECT word, {_PLAIN.format('word')} AS p, length(word) AS n FROM df WHERE length(word) >= 3 GROUP BY word HAVING count(*) >= 20),
 tx AS (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations), us AS (SELECT DISTINCT {_EDGE} AS word FROM (SELECT unnest(l) AS w FROM tx)),
 un AS (SELECT word, {_PLAIN.format('word')} AS p, length(word) AS n FROM us WHERE length(word) >= 3 AND lower(word) NOT IN (SELECT word FROM di)),
 nr AS (SELECT u.word, d.word AS match, levenshtein(u.p, d.p) AS distance FROM un u JOIN di d ON d.n BETWEEN u.n - 2 AND u.n + 2 WHERE levenshtein(u.p, d.p) <= 2),
 fx AS (SELECT word, arg_min(match, (distance, match)) AS match FROM nr GROUP BY 1), fm AS (SELECT map(list(word), list(match)) AS m FROM fx),
 ed AS (SELECT conv_id, turn, l, list_transform(l, lambda w: m[{_EDGE}]) AS f FROM tx, fm)
 SELECT conv_id, turn, array_to_string(list_transform(l, lambda w, i: CASE WHEN f[i] IS NULL THEN w ELSE replace(w, {_EDGE}, f[i]) END), ' ') AS text, coalesce(CAST(len(list_filter(f, lambda x: x IS NOT NULL)) AS INT), 0) AS corrections FROM ed"""
)
def m13_dictionary_corrections(spark, d):
    """Unknown words of the conversations become the closest of the words that twenty documents use."""
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text"), 3))).alias("word")).groupBy("word").count().where("count >= 20")
    dictionary = words.select("word", F.col("word").alias("place"))
    c = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return ocr.by_dictionary(c, "key", "text", dictionary).select("key.conv_id", "key.turn", "text", "corrections")
