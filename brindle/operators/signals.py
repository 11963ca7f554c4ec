"""Signals: long tables of (owner, key, value, confidence, time) and their aggregation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("highest_confidence", "most_recent", "weighted_average", "majority_vote", "collect")


def glob_regex(glob: str) -> str:
    """``**`` is anything, ``*`` anything without a dot; the whole key has to fit, in any case."""
    parts = re.split(r"(\*\*|\*)", glob)
    return "(?i)^" + "".join({"**": ".*", "*": "[^.]+"}.get(p, re.escape(p)) for p in parts) + "$"


def matches_globs(key: Column, globs: str, macros: dict[str, list[str]] | None = None) -> Column:
    """A comma list of exact keys, prefixes with a star and @collections; an empty list is everything."""
    wanted = [g.strip() for g in (globs or "*").split(",") if g.strip()]
    out: Column = F.lit(False)
    for g in wanted:
        for one in (macros or {}).get(g[1:], []) if g.startswith("@") else [g]:
            if one == "*":
                return F.lit(True)
            out = out | (F.startswith(F.lower(key), F.lit(one[:-1].lower())) if one.endswith("*") else F.lower(key) == one.lower())
    return out


def aggregate(signals: DataFrame, by: list[str], strategy: str, value: str = "value", confidence: str = "confidence", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """One row per group with its aggregated value.

    Ties of confidence or time go to the smallest tie column. A weighted average of
    values without weight is null. The majority is the value with most confidence,
    ties to the smaller value. collect gives all values in time order.
    """
    v, c = F.col(value), F.col(confidence)
    if strategy == "highest_confidence":
        return signals.groupBy(*by).agg(F.max_by(v, F.struct(c, -F.col(tie))).alias("value"))
    if strategy == "most_recent":
        return signals.groupBy(*by).agg(F.max_by(v, F.struct(F.col(time), -F.col(tie))).alias("value"))
    if strategy == "weighted_average":
        return signals.groupBy(*by).agg((F.sum(v * c) / F.nullif(F.sum(F.when(v.isNotNull(), c)), F.lit(0.0))).alias("value"))
    if strategy == "majority_vote":
        votes = signals.groupBy(*by, v.alias("value")).agg(F.sum(c).alias("votes"))
        return votes.groupBy(*by).agg(F.max_by("value", F.struct("votes", -F.col("value"))).alias("value"))
    if strategy == "collect":
        ordered = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), v.alias("v"))))
        return signals.groupBy(*by).agg(F.transform(ordered, lambda s: s["v"]).alias("value"))
    raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")


def salience(signals: DataFrame, weights: list[tuple[str, float]], default: float = 0.5, key: str = "key", confidence: str = "confidence") -> DataFrame:
    """signals with salience: the weight of the first glob that fits the key, times the confidence."""
    importance = F.coalesce(*[F.when(F.col(key).rlike(glob_regex(g)), F.lit(w)) for g, w in weights], F.lit(default))
    return signals.withColumn("salience", importance * F.col(confidence))


def contradictions(signals: DataFrame, owner: str, rules: list[tuple[str, str, str, float]], key: str = "key", value: str = "value", confidence: str = "confidence") -> DataFrame:
    """(owner, rule, a, b) where the best signals of two keys disagree.

    Rules are (name, key a, key b, most allowed difference). The best signal of each
    key is picked in one aggregate per owner, without a self-join.
    """
    keys = sorted({k for _, a, b, _ in rules for k in (a, b)})
    best = signals.where(F.col(key).isin(keys)).groupBy(owner).agg(*[F.max_by(F.when(F.col(key) == k, F.col(value)), F.when(F.col(key) == k, F.struct(confidence, value))).alias(k) for k in keys])
    found = [F.when(F.abs(F.col(a) - F.col(b)) > most, F.struct(F.lit(name).alias("rule"), F.col(a).alias("a"), F.col(b).alias("b"))) for name, a, b, most in rules]
    return best.select(owner, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(owner, "x.rule", "x.a", "x.b")


def decayed(weight: Column, rate: Column, days: Column) -> Column:
    return weight * F.pow(rate, days)


#: Characters that are folded at once, and folded votes that a task holds before it hands them on.
FOLD_CHARS, HELD_VOTES = 1 << 21, 1 << 21


def place_votes(rows: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """(pos, ch, share): the character with most confidence at every place of the texts, from 1, and its share there.

    Ties go to the smaller character; null texts and confidences have no vote. Tasks
    add up their votes by (place, character) in bounded memory, so what is shuffled
    are sums, and a long text is taken piece by piece.
    """

    def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, votes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(votes[order], first)

    def batch_of(keys: np.ndarray, votes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), 1 << 16):
            k = keys[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k >> 21), pa.array((k & 0x1FFFFF).astype(np.int32)), pa.array(votes[a : a + (1 << 16)])], names=["pos", "code", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for data, c in zip(batch.column("text"), batch.column("c").to_pylist(), strict=True):
                codes = np.frombuffer(data.as_py().encode("utf-32-le"), np.uint32)
                for a in range(0, len(codes), FOLD_CHARS):
                    part = codes[a : a + FOLD_CHARS].astype(np.int64)
                    parts.append((np.arange(a + 1, a + 1 + len(part), dtype=np.int64) << 21 | part, np.full(len(part), c, np.float64)))
                    size += len(part)
                    if size >= FOLD_CHARS:
                        parts, size = [folded(parts)], 0
                        if len(parts[0][0]) >= HELD_VOTES:
                            yield from batch_of(*parts[0])
                            parts = []
        if parts:
            yield from batch_of(*folded(parts))

    slim = rows.select(F.col(text).alias("text"), F.col(confidence).cast("double").alias("c")).where("text is not null and c is not null")
    votes = slim.mapInArrow(run, "pos long, code int, w double").groupBy("pos", "code").agg(F.sum("w").alias("w"))
    best = votes.groupBy("pos").agg(F.sum("w").alias("t"), F.max(F.struct("w", (-F.col("code")).alias("less"))).alias("top"))
    ch = F.decode(F.unhex(F.lpad(F.hex(-F.col("top.less")), 8, "0")), "UTF-32")
    return best.select("pos", ch.alias("ch"), (F.col("top.w") / F.nullif(F.col("t"), F.lit(0.0))).alias("share"))
