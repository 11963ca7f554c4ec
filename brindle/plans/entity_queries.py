"""Names in the texts."""

from __future__ import annotations

from ..operators import entities as en
from .registry import query, table


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_CODE = " + ".join(f"CAST(contains(lower(text), '{s}') AS INT)" for s in en.CODE_SIGNS)
_EDGES = en.EDGES.replace("'", "''")
_TITLE = en.TITLE.replace("'", "''")


@query(
    rf"""WITH tx AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND {_CODE} < 3),
 tk AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[ \n\r\t]'), lambda t: regexp_replace(t, '^{_EDGES}+|{_EDGES}+$', '', 'g')), lambda t: regexp_matches(t, '[^\s\p{{Z}}]')) AS l FROM tx),
 ix AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM tk),
 fl AS (SELECT *, regexp_matches(t, '{_TITLE}') OR lower(t) IN {_list(en.PLACES + en.HONORIFICS)} AS goes_on,
   (regexp_matches(t, '{_TITLE}') OR lower(t) IN {_list(en.HONORIFICS)}) AND lower(t) NOT IN {_list(en.STOP + en.CODE)} AND NOT regexp_matches(t, '{en.ACRONYM}') AS opens FROM ix),
 isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fl WHERE goes_on),
 op AS (SELECT *, min(i) FILTER (opens) OVER (PARTITION BY doc_id, run) AS first FROM isl),
 sp AS (SELECT doc_id, first AS pos, string_agg(t, ' ' ORDER BY i) AS name FROM op WHERE i >= first GROUP BY doc_id, run, first),
 gr AS (SELECT doc_id, lower(name) AS key, count(*) AS n, min(pos) AS pos, arg_min(name, pos) AS name FROM sp WHERE length(name) > 2 GROUP BY 1, 2),
 ok AS (SELECT *, string_split(name, ' ') AS w FROM gr),
 ke AS (SELECT *, len(w) = 1 AS single, lower(w[1]) AS head FROM ok)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos, name) AS INT) AS place, name, n FROM ke
 WHERE NOT (single AND key IN {_list(en.STOP)}) AND NOT (head IN {_list(en.STOP)} AND head NOT IN {_list(en.HONORIFICS)}) AND key NOT IN {_list(en.DAYS + en.MONTHS + en.PLACES + en.HONORIFICS + en.CODE)}
   AND NOT regexp_matches(name, '{en.ACRONYM}') AND NOT (single AND n < 2)
   AND len(list_filter(w, lambda x: lower(x) IN {_list(en.HONORIFICS)} OR (len(w) > 1 AND lower(x) IN {_list(en.PLACES)}) OR regexp_matches(x, '{en.TITLE_WORD.replace("'", "''")}'))) = len(w)
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos, name) <= 12"""
)
def c10_proper_nouns(spark, d):
    """The twelve most frequent names of each document."""
    return en.proper_nouns(table(spark, d, "documents"))


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda w: regexp_matches(w, '^\p{{Lu}}\p{{L}}{{2,}}$') AND lower(w) NOT IN {_list(en.COMMON)}) AS l FROM documents),
 f AS (SELECT doc_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM w), g AS (SELECT doc_id, name, min(i) AS i FROM f GROUP BY 1, 2),
 k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 10), a AS (SELECT doc_id, list(name ORDER BY i) AS names FROM k GROUP BY 1)
 SELECT doc_id, coalesce(names, []) AS names FROM documents LEFT JOIN a USING (doc_id)"""
)
def x32_capitalised_words(spark, d):
    """The first ten capitalised words of each document."""
    return en.capitalised(table(spark, d, "documents"))
