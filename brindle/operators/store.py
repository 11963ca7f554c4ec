"""Sinks as pure functions (old rows, new rows) -> rows: upserts, cascades, stale removal, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write by seq wins. Rows of a key meet as partial maxima."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str, latest: list[str], seq: str) -> DataFrame:
    """Counts add up; each column of latest is its last value by seq that is not null."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.sum(count).alias(count), *[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in latest])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there; one row of each new key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def remove(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def remove_stale(segments: DataFrame, valid: DataFrame, doc: str, content_hash: str) -> DataFrame:
    """Drops segments of the documents in valid whose hash is not among the valid ones; other documents stay."""
    docs = valid.select(doc).distinct()
    touched = segments.join(docs, doc, "left_semi").join(valid.select(doc, content_hash).distinct(), [doc, content_hash], "left_semi")
    return segments.join(docs, doc, "left_anti").unionByName(touched)


def sync_entities(catalog: DataFrame, graph: DataFrame, name: str = "name") -> DataFrame:
    """Full outer match by name in lower case: strength is the greater, sources the union of both."""
    a = catalog.select(F.lower(name).alias("k"), F.col(name).alias("old_name"), F.col("strength").alias("s1"), F.col("sources").alias("o1"))
    b = graph.select(F.lower(name).alias("k"), F.col(name).alias("new_name"), F.col("strength").alias("s2"), F.col("sources").alias("o2"))
    none = F.array().cast(catalog.schema["sources"].dataType)
    return a.join(b, "k", "full").select(F.coalesce("old_name", "new_name").alias(name), F.greatest("s1", "s2").alias("strength"), F.array_sort(F.array_union(F.coalesce("o1", none), F.coalesce("o2", none))).alias("sources"))


def csv_field(value: Column) -> Column:
    """Quoted if it holds a quote, comma or line end; quotes are doubled."""
    text = value.cast("string")
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def csv_lines(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """One column line; numbers by printf formats."""
    formats = formats or {}
    return df.select(F.concat_ws(",", *[F.format_string(formats[c], c) if c in formats else csv_field(F.col(c)) for c in df.columns]).alias("line"))
