"""Text scalars as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, non-spacing marks, decimal digits and connectors: the word class used everywhere.
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"


def tokens(text: Column, min_length: int = 2, pattern: str = WORD) -> Column:
    """Lower-case words of at least min_length characters, in text order; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= min_length) if min_length > 1 else found


def word_count(text: Column) -> Column:
    return F.size(tokens(text, 1))


def token_estimate(text: Column) -> Column:
    """Characters over four, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def canonical_hash(text: Column) -> Column:
    """Hash that ignores case, line ends and white space runs."""
    flat = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"[ \t\n\x0B\f\r]+", " ")
    return content_hash(F.lower(F.trim(flat)))


def sentences(text: Column, min_length: int = 1) -> Column:
    """Cut after . ! ? followed by white space; trimmed; shorter ones left out."""
    # white space comes first, so that a look behind is taken there only
    cut = F.transform(F.split(text, r"[ \t\n\x0B\f\r](?<=[.!?][ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*"), lambda s: F.trim(s))
    return F.filter(cut, lambda s: F.length(s) >= min_length)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of size characters with an overlap; the last one ends with the text. A short text is one window."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be less than size")
    n = F.length(text)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * stride + 1, F.lit(size)))


def title_of(text: Column, most: int = 50) -> Column:
    """A title of at most most characters, cut with three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def truncate_at_word(text: Column, most: int) -> Column:
    """At most most characters, cut at the last space inside them if there is one."""
    head = F.substring(text, 1, most)
    at = F.length(head) - F.locate(" ", F.reverse(head))
    return F.when(F.length(text) <= most, text).when(F.locate(" ", head) > 0, F.substring(head, F.lit(1), at)).otherwise(head)


def normalise_name(name: Column) -> Column:
    """Trimmed, lower-case, white space runs collapsed, quotes removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[ \t\n\x0B\f\r]+", " "), "[\"'`]", "")


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("e_"), F.regexp_replace(F.lower(name), "[^a-z0-9]", "_"))


def ngrams(text: Column, n: int = 2) -> Column:
    """Character n-grams in order; empty if the text is shorter."""
    count = F.length(text) - n + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def clean(text: Column) -> Column:
    """Ligatures, quotes, dashes and bullets to ASCII; control characters out; white space runs to one space."""
    out = F.regexp_replace(F.regexp_replace(text, "ﬁ", "fi"), "ﬂ", "fl")
    out = F.translate(out, "‘’“”–—•", "''\"\"--*")
    out = F.regexp_replace(out, r"[\x00-\x08\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))


def html_to_markdown(html: Column) -> Column:
    """Script, style and head out; headings, paragraphs, quotes, breaks and rules to Markdown; tags out; common references decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b[^>]*>.*?</\1>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<hr\s*/?>", "\n---\n")
    out = F.regexp_replace(out, r"(?i)<blockquote\b[^>]*>", "\n> ")
    out = F.regexp_replace(out, r"(?i)</?p\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for reference, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(plain))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))
