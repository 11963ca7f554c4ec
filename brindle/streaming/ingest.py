"""Segments taken in under a budget while a document's chunks arrive.

Each chunk gives its headings, its first two and last two sentences, and of the rest a
share: while few chunks have come a stable sample by hash, later the segments nearest to
the centroid of what was taken before. When the budget is used up but for a reserve,
every few chunks a trickle comes through; near the expected end the reserve is released.
More than the budget is never taken.

The same fold runs in a stream, with a document's counters and sum vector as state, and
over a table: sorted within partitions, a chunk at a time, so a document of any length
needs one chunk's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values.
KIND_WEIGHTS = {"heading": 1.2, "code": 1.1, "list": 1.05}


@dataclass(frozen=True)
class Limits:
    budget: int = 1200
    bootstrap_chunks: int = 4
    bootstrap_rate: float = 0.25
    bootstrap_cap: int = 180
    chunk_cap: int = 100
    trickle_every: int = 3
    trickle: int = 5
    expected_chunks: int = 12
    tail_from: float = 0.6
    tail_reserve: int = 0


def stable_hash(text: str) -> int:
    """h = 31 h + unit from 23 over UTF-16 units, in 32 bits with sign."""
    h = 23
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h * 31 + (units[i] | units[i + 1] << 8)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


@dataclass
class Intake:
    """One document's state: chunks come, segments taken, vectors among them, their sum."""

    limits: Limits
    chunks: int = 0
    used: int = 0
    n: int = 0
    total: list[float] = field(default_factory=list)

    def _score(self, s: dict) -> float:
        base = s["weight"] * KIND_WEIGHTS.get(s["kind"], 1.0) + 0.2 * min(len(s["text"]) / 200, 1.0)
        if not self.n or s["vector"] is None:
            return base
        c, v = np.asarray(self.total), np.asarray(s["vector"], float)
        size = float(np.linalg.norm(c) * np.linalg.norm(v)) if len(c) == len(v) else 0.0
        return 0.7 * (float(c @ v) / size if size else 0.0) + 0.3 * base

    def offer(self, segments: list[dict]) -> list[tuple[dict, str]]:
        """(segment, why) of those taken from a chunk's segments, which are in their order."""
        lim = self.limits
        self.chunks += 1
        sentences = [i for i, s in enumerate(segments) if s["kind"] == "sentence"]
        sure = dict.fromkeys([i for i, s in enumerate(segments) if s["kind"] == "heading"] + sentences[:2] + sentences[-2:])
        rest = [i for i in range(len(segments)) if i not in sure]
        left = max(0, lim.budget - self.used)
        reserve = 0 if self.chunks >= int(lim.expected_chunks * lim.tail_from) else lim.tail_reserve
        open_budget = max(0, left - reserve)
        by_score = lambda k: sorted(rest, key=lambda i: -self._score(segments[i]))[:k]
        taken = [(i, "sure") for i in sure]
        if open_budget:
            if self.chunks < lim.bootstrap_chunks:
                k = min(lim.bootstrap_cap, math.ceil(lim.bootstrap_rate * len(rest)))
                taken += [(i, "sample") for i in sorted(rest, key=lambda i: stable_hash(segments[i]["hash"]))[:k]]
            else:
                taken += [(i, "score") for i in by_score(lim.chunk_cap)]
            taken = taken[:open_budget]
        elif self.chunks % lim.trickle_every == 0:
            taken = (taken + [(i, "trickle") for i in by_score(lim.trickle)])[:left]
        else:
            taken = []
        self.used += len(taken)
        for i, _ in taken:
            v = segments[i]["vector"]
            if v is not None and (not self.n or len(v) == len(self.total)):
                self.total = [float(x) + float(y) for x, y in zip(self.total or [0.0] * len(v), v, strict=True)]
                self.n += 1
        return [(segments[i], why) for i, why in taken]


COLUMNS = ["doc_id", "chunk", "segment", "kind", "text", "weight", "hash", "vector"]
PICKED = "doc_id {kind}, chunk long, segment long, why string, used long"


def _slim(segments: DataFrame) -> DataFrame:
    """Null texts become empty; a missing hash is the text's md5."""
    text = F.coalesce("text", F.lit(""))
    made = {"kind": F.coalesce("kind", F.lit("sentence")), "text": text, "weight": F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), "hash": F.coalesce("hash", F.md5(text.cast("binary")))}
    return segments.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("segment").cast("long").alias("segment"), *[made[c].alias(c) for c in ("kind", "text", "weight", "hash")], F.col("vector").cast("array<double>").alias("vector"))


def _picked(doc, chunk: int, intake: Intake, rows: list[dict]) -> list[tuple]:
    before = intake.used
    return [(doc, chunk, s["segment"], why, before + k) for k, (s, why) in enumerate(intake.offer(rows), 1)]


def budgeted(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, chunk, segment, why, used): what is taken of segments (doc_id, chunk, segment, kind, text, weight, hash, vector), chunks in their order. Rows without a document, chunk or segment number take no part."""
    kind = segments.schema["doc_id"].dataType.simpleString()
    dealt = _slim(segments).dropna(subset=["doc_id", "chunk", "segment"]).repartition("doc_id").sortWithinPartitions("doc_id", "chunk", "segment", "hash")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, chunk, intake, waiting = None, None, Intake(limits), []
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if waiting and (row["doc_id"], row["chunk"]) != (doc, chunk):
                    out += _picked(doc, chunk, intake, waiting)
                    waiting = []
                if row["doc_id"] != doc:
                    intake = Intake(limits)
                doc, chunk = row["doc_id"], row["chunk"]
                waiting.append(row)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "chunk", "segment", "why", "used"])
        if waiting:
            yield pd.DataFrame(_picked(doc, chunk, intake, waiting), columns=["doc_id", "chunk", "segment", "why", "used"])

    return dealt.mapInPandas(run, PICKED.format(kind=kind))


def budgeted_stream(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same over a stream: a chunk arrives whole in a micro-batch, chunks of a document in their order; append mode."""
    kind = segments.schema["doc_id"].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        intake = Intake(limits)
        if state.exists:
            intake.chunks, intake.used, intake.n, total = state.get
            intake.total = [float(x) for x in total.split()]
        rows = pd.concat(list(frames)).sort_values(["chunk", "segment", "hash"], kind="stable")
        out = []
        for chunk, part in rows.groupby("chunk", sort=True):
            out += _picked(key[0], int(chunk), intake, part.to_dict("records"))
        state.update((intake.chunks, intake.used, intake.n, " ".join(map(repr, intake.total))))
        yield pd.DataFrame(out, columns=["doc_id", "chunk", "segment", "why", "used"])

    slim = _slim(segments).where("doc_id is not null and chunk is not null and segment is not null")
    return slim.groupBy("doc_id").applyInPandasWithState(update, PICKED.format(kind=kind), "chunks long, used long, n long, total string", "append", GroupStateTimeout.NoTimeout)
