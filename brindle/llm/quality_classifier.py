"""Quality classifier: a linear support vector machine on naive Bayes features.

Features are indicators (present or not) of word unigrams, word bigrams and
byte four-grams, hashed into a fixed number of cells. Each cell's value is its
class log-count ratio; a hinge-loss linear model is fitted on those values by
dual coordinate descent, and its weights are mixed with their mean size, as is
usual for such models. Margins become probabilities by a logistic fit on labelled
rows that the model did not see.

The log-count ratios cover every labelled training row. Only the margin model is
fitted on a bounded sample: the ``docs_per_class`` rows of each class with the
least hashes of id and text, exactly so many at most, however often rows repeat.
What reaches the driver is bounded by the number of cells and by that sample.

Null texts are empty; an empty text scores by the model's bias. Rows with a null
id or label are not learned from, and a null id is never held out. An id with
several labels counts once for each. Without labels of both classes every score
is the share of good labels (0.5 without any). Ids may repeat in the documents,
each row is scored by itself; a score of exactly 0.5 predicts 1; very long texts
are scored whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_slices, crc_mod, mix64

CELLS = 1 << 18
DOCS_PER_CLASS = 1_500
SMOOTHING = 1.0
MIXTURE = 0.25
COST = 0.1
EPOCHS = 12
STORE = 400_000
BROADCAST_ROWS = 1_000_000

_words: dict[bytes, int] = {}


def _hashed(words: list[bytes]) -> np.ndarray:
    if len(_words) > STORE:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w, 1) >> 1
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words)).view(np.uint64)


class Features:
    """The distinct cells of a text; scratch is reused."""

    def __init__(self, cells: int = CELLS):
        self.cells = cells
        self.mark = np.zeros(cells, np.int64)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [t.lower().split() for t in texts]
        flat = _hashed(list(chain.from_iterable(words)))
        shift = np.uint64(64 - self.cells.bit_length() + 1)
        out, at = [], 0
        for text, own in zip(texts, words, strict=True):
            h = flat[at : at + len(own)]
            at += len(own)
            raw = np.frombuffer(text, np.uint8).astype(np.uint64)
            keys = [mix64(h)]
            if len(h) > 1:
                keys.append(mix64(h[:-1] * np.uint64(3) + h[1:]))
            if len(raw) > 3:
                four = raw[:-3] | raw[1:-2] << np.uint64(8) | raw[2:-1] << np.uint64(16) | raw[3:] << np.uint64(24)
                keys.append((four + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            cell = (np.concatenate(keys) >> shift).astype(np.int64)
            place = np.arange(len(cell))
            self.mark[cell] = place
            out.append(cell[self.mark[cell] == place])
        return out


def descend(rows: list[np.ndarray], labels: np.ndarray, values: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Dual coordinate descent for the L1-loss linear SVM; the last weight is the bias."""
    w = np.zeros(len(values) + 1)
    y = np.where(labels > 0, 1.0, -1.0)
    n = len(rows)
    share = (labels > 0).mean()
    upper = np.where(labels > 0, cost / (2 * share), cost / (2 * (1 - share)))
    x = [values[r] for r in rows]
    scale = [1.0 / np.sqrt(max(float(v @ v), 1e-12)) for v in x]  # each text has unit length
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            r, v = rows[i], x[i]
            gradient = y[i] * (scale[i] * float(w[r] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * scale[i] * v
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    def __init__(self, weights: np.ndarray, values: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.values, self.bias, self.slope, self.shift = weights.astype(np.float32), values.astype(np.float32), bias, slope, shift

    def margin(self, cells: np.ndarray) -> float:
        v = self.values[cells]
        return float(self.weights[cells] @ v) / max(float(v @ v) ** 0.5, 1e-6) + self.bias

    def score(self, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(cells) + self.shift, -500, 500))))


def logistic(margins: np.ndarray, labels: np.ndarray, share: float = 0.5, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the labels' log odds by margin, with so large a share of good rows; smoothed targets, Newton steps."""
    good, bad = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(labels > 0, share / max(good, 1), (1 - share) / max(bad, 1)) * len(labels)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, s = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _least(rows: DataFrame, k: int, n: int) -> DataFrame:
    """The k of n rows with the least lot; of equal ones (repeated rows) as many as there is room for."""
    if n <= k:
        return rows
    bar, place = rows.select("lot").orderBy("lot").limit(k).agg(F.max("lot"), F.count("*")).first()
    below = rows.where(F.col("lot") < bar)
    return below.union(rows.where(F.col("lot") == bar).limit(place - below.count()))


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", cells: int = CELLS, docs_per_class: int = DOCS_PER_CLASS, doc_id: str | None = None) -> Model:
    """Learns from rows with a text and a label (1 good, 0 bad)."""
    lot = F.xxhash64(*[F.col(c) for c in (doc_id, text) if c], F.lit(11))
    rows = labelled.select(F.col(text).alias("text"), (F.col(label) > 0).cast("byte").alias("label"), lot.alias("lot")).where("text is not null and label is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(cells)
        found = np.zeros((2, cells), np.int64)
        docs = [0, 0]
        for batch in bounded_slices(batches, "text"):
            for label, own in zip(batch.column("label").to_pylist(), made.of(as_bytes(batch.column("text"))), strict=True):
                found[label, own] += 1
                docs[label] += 1
        at = np.flatnonzero(found.any(axis=0))
        if sum(docs):
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[docs[0], found[0, at]]), pa.array(np.r_[docs[1], found[1, at]])], names=["cell", "bad", "good"])

    counted = rows.select("text", "label").mapInArrow(count, "cell long, bad long, good long").groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    cell, bad, good = (counted.column(c).to_numpy() for c in ("cell", "bad", "good"))
    docs = cell == -1
    n_bad, n_good = int(bad[docs].sum()), int(good[docs].sum())
    zero = np.zeros(cells)
    if not n_bad or not n_good:
        share = n_good / (n_bad + n_good) if n_bad + n_good else 0.5
        return Model(zero, zero, 0.0, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    counts = np.zeros((2, cells))
    counts[0, cell[~docs]], counts[1, cell[~docs]] = bad[~docs], good[~docs]
    counts += SMOOTHING
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    values = logs[1] - logs[0]

    sample = None
    for kind in (0, 1):
        part = _least(rows.where(F.col("label") == kind), docs_per_class, (n_bad, n_good)[kind])
        sample = part if sample is None else sample.union(part)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(cells)
        for batch in bounded_slices(batches, "text"):
            own = made.of(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([np.sort(x).astype("<u4").tobytes() for x in own], pa.binary())], names=["label", "cells"])

    taken = sorted(zip(*sample.select("text", "label").mapInArrow(featured, "label byte, cells binary").toArrow().to_pydict().values(), strict=True), key=lambda x: (xxhash.xxh64_intdigest(x[1]), x[0]))
    labels = np.array([x[0] for x in taken])
    own = [np.frombuffer(x[1], "<u4").astype(np.int64) for x in taken]
    apart = np.arange(len(own)) % 5 == 0  # for the logistic fit
    learn = np.flatnonzero(~apart)
    if len(set(labels[learn].tolist())) < 2:
        learn = np.arange(len(own))
    w = descend([own[i] for i in learn], labels[learn], values)
    weights, bias = w[:-1], float(w[-1])
    used = weights[weights != 0]
    weights = (1 - MIXTURE) * (np.abs(used).mean() if len(used) else 0.0) + MIXTURE * weights
    model = Model(weights, values, MIXTURE * bias, 1.0, 0.0)
    check = np.flatnonzero(apart) if len(set(labels[apart].tolist())) == 2 else np.arange(len(own))
    model.slope, model.shift = logistic(np.array([model.margin(own[i]) for i in check]), labels[check])
    return model


def quality_scores(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **bounds: int) -> DataFrame:
    """doc_id, score (0 to 1), predicted of every row; the model is fitted on labelled (text and label)."""
    model = fit(labelled, text, label, doc_id=doc_id if doc_id in labelled.columns else None, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two floats a cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        made = Features(len(model.values))
        for batch in bounded_slices(batches, "text"):
            scores = [model.score(x) for x in made.of(as_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels are learned from rows whose crc32 of the id is not 1 modulo 3."""
    remainder: Column = crc_mod("doc_id", 3)
    known = labels.select("doc_id", "quality").where(remainder != 1)
    if known.count() <= BROADCAST_ROWS:  # 12 bytes a row; more labels are joined by a shuffle
        known = F.broadcast(known)
    labelled = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "text", "quality")
    found = quality_scores(docs, labelled)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")
