"""Language identification by words first, backing off to shorter character n-grams.

A known word scores its smoothed log frequency in each language. An unseen word is
scored by its longest character n-grams that were seen in any language: orders
five to one in turn, word borders marked, the mean log frequency of the n-grams
of that order. The language with the highest sum over all words of the text wins;
the score is its posterior probability under equal priors.

The classifier is fitted on a bounded sample of labelled rows: about
``docs_per_language`` rows a language, chosen by a hash of id and text, and of
each language's words the ``words_per_language`` most frequent (ties by the word).
All n-grams of those words are kept. The model has one entry for a word or n-gram
and a language that it was seen in, by 64-bit hash: it grows with the languages,
not with their square, and not with the documents. Everything else covers whole
texts of all rows.

Null texts and texts without a letter give ``und`` with score 0. Rows with a null
language or a null id are not learned from; a null id is never held out. Ids may
repeat, each row is judged by itself; a tie goes to the language that comes first
in the alphabet; very long texts are judged whole; other columns are ignored; an
empty table gives no rows. With nothing to learn from every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_slices, crc_mod

ORDERS = (5, 4, 3, 2, 1)
DOCS_PER_LANGUAGE = 5_000
WORDS_PER_LANGUAGE = 40_000
SMOOTHING = 0.5
#: Cells (words times languages) of a task's store of scores.
STORE = 2_000_000
_NOT_LETTER = re.compile(r"[\W\d_]+")


def normal(word: bytes) -> str:
    """Lower-case letters of a word."""
    return _NOT_LETTER.sub("", word.decode("utf-8", "replace").lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def keys_of(strings: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s) for s in strings), np.uint64, len(strings))


class Table:
    """Log frequencies of words, or of n-grams of one order, where they were seen; all others have the language's base."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, k: int, smoothing: float):
        order = np.lexsort((langs, keys))
        keys, langs, counts = keys[order], langs[order], counts[order].astype(np.float64)
        self.keys, starts = np.unique(keys, return_index=True)
        self.ptr = np.r_[starts, len(keys)].astype(np.int64)
        self.langs = langs.astype(np.int32)
        total = np.bincount(langs, weights=counts, minlength=k) + smoothing * max(len(self.keys), 1)
        self.base = np.log(smoothing / total)
        self.more = (np.log((counts + smoothing) / total[langs]) - self.base[langs]).astype(np.float32) if len(langs) else np.zeros(0, np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 without one."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def sums(self, places: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): the rows at places, added up by group."""
        k = len(self.base)
        sizes = self.ptr[places + 1] - self.ptr[places]
        entry = np.repeat(self.ptr[places] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        cell = np.repeat(groups, sizes) * k + self.langs[entry]
        out = np.bincount(cell, weights=self.more[entry], minlength=n * k).reshape(n, k)
        return out + np.bincount(groups, minlength=n)[:, None] * self.base


class Rows:
    """A table's rows by word or n-gram."""

    def __init__(self, table: Table):
        self.table, self.seen = table, {}

    def __contains__(self, key: str) -> bool:
        return bool(self.table.find(keys_of([key]))[0] >= 0)

    def __getitem__(self, key: str) -> np.ndarray:
        if key not in self.seen:
            place = self.table.find(keys_of([key]))
            if place[0] < 0:
                raise KeyError(key)
            self.seen[key] = self.table.sums(place, np.zeros(1, np.int64), 1)[0]
        return self.seen[key]


class Model:
    """Log frequencies of words and character n-grams by language; counts are by word and language, or (order, key, language)."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray] | None = None, counted: pa.Table | None = None, smoothing: float = SMOOTHING):
        self.languages = languages
        if counted is None:
            rows = [(n, key, i, float(c[i])) for w, c in (words or {}).items() for n, key in _entries(w) for i in range(len(languages)) if c[i]]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            order, keys, langs, counts = (np.array(x, t) for x, t in zip(columns, (np.int64, np.uint64, np.int64, np.float64), strict=True))
        else:
            order, keys, langs, counts = (counted.column(c).to_numpy() for c in ("order", "key", "lang", "n"))
            keys = keys.view(np.uint64)
        self.tables = {}
        for n in (0, *ORDERS):
            own = order == n
            pairs, inverse = np.unique(np.stack([keys[own], langs[own].astype(np.uint64)], axis=1), axis=0, return_inverse=True)
            self.tables[n] = Table(pairs[:, 0], pairs[:, 1].astype(np.int64), np.bincount(inverse.ravel(), weights=counts[own], minlength=len(pairs)), len(languages), smoothing)
        self.words, self.grams = Rows(self.tables[0]), {n: Rows(self.tables[n]) for n in ORDERS}

    def word(self, word: str) -> np.ndarray | None:
        """Scores of one word by language; None if it has no letter or nothing of it was ever seen."""
        if word and word in self.words:
            return self.words[word]
        known, scores = self.score([word])
        return scores[0] if known[0] else None

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(whether anything of a word was seen, its scores by language) of normal words."""
        n = len(words)
        out, known = np.zeros((n, len(self.languages))), np.zeros(n, bool)
        open_ = np.array([i for i, w in enumerate(words) if w], np.int64)
        for order in (0, *ORDERS):
            if not len(open_):
                break
            parts = [[words[i]] if order == 0 else grams(words[i], order) for i in open_.tolist()]
            group = np.repeat(np.arange(len(open_)), [len(p) for p in parts])
            table = self.tables[order]
            place = table.find(keys_of([g for p in parts for g in p]))
            seen = place >= 0
            count = np.bincount(group[seen], minlength=len(open_))
            some = count > 0
            if some.any():
                sums = table.sums(place[seen], group[seen], len(open_))
                out[open_[some]] = sums[some] / count[some, None]
                known[open_[some]] = True
            open_ = open_[~some]
        return known, out


def _entries(word: str) -> list[tuple[int, int]]:
    """(order, key) of a word and all its n-grams; order 0 is the word."""
    digest = xxhash.xxh64_intdigest
    return [(0, digest(word)), *((n, digest(g)) for n in ORDERS for g in grams(word, n))]


class Scorer(dict):
    """Word (bytes) to the row of its scores; the store of rows is bounded and grows in place."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, len(model.languages)))
        self.size = 1  # row 0 is of words that say nothing

    def _learn(self, words: set[bytes]) -> None:
        new = list(words)
        known, scores = self.model.score(list(map(normal, new)))
        at = np.where(known, np.cumsum(known) + self.size - 1, 0)
        end = self.size + int(known.sum())
        if end > len(self.table):
            grown = np.zeros((max(end, 2 * len(self.table)), self.table.shape[1]))
            grown[: self.size] = self.table[: self.size]
            self.table = grown
        self.table[self.size : end] = scores[known]
        self.size = end
        self.update(zip(new, at.tolist(), strict=True))

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        k = len(self.model.languages)
        if not k:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self) * k > STORE:
            self.clear()
            self.size = 1
        words = [t.split() for t in texts]
        self._learn(set().union(*words).difference(self))
        languages, scores = [], []
        for text, own in zip(texts, words, strict=True):
            rows = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
            if not rows.any() and not any(map(str.isalpha, text.decode("utf-8", "replace"))):
                languages.append("und")
                scores.append(0.0)
                continue
            total = self.table[rows].sum(axis=0)
            best = int(np.argmax(total))
            languages.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum()))
        return languages, scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE, doc_id: str | None = None) -> Model:
    """Learns from the rows of labelled that have a text and a language; see the module for the bounds."""
    lot = F.xxhash64(*[F.col(c) for c in (doc_id, text) if c], F.lit(7))
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(lot, F.lit(1 << 30)).alias("lot")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").count()  # one row a language
    found = sizes.toArrow().to_pydict()
    languages = sorted(found["lang"])
    if not languages:
        return Model([])
    number = {name: i for i, name in enumerate(languages)}
    bars = labelled.sparkSession.createDataFrame([(name, number[name], int(min(1.0, docs_per_language / n) * (1 << 30))) for name, n in zip(found["lang"], found["count"], strict=True)], "lang string, number int, bar long")
    sample = rows.join(F.broadcast(bars), "lang").where("lot < bar").select("text", "number")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text", 16 << 20, 1 << 16):
            counts: dict[int, Counter] = {}
            for name, data in zip(batch.column("number").to_pylist(), as_bytes(batch.column("text")), strict=True):
                counts.setdefault(name, Counter()).update(data.split())
            for name, found in counts.items():
                merged: Counter = Counter()
                for w, n in found.items():
                    merged[normal(w)] += n
                merged.pop("", None)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(merged), pa.int32()), pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], names=["lang", "word", "n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, key, name, many = [], [], [], []
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                own = _entries(word)
                order += [x[0] for x in own]
                key += [x[1] for x in own]
                name += [lang] * len(own)
                many += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(name, pa.int32()), pa.array(many, pa.int64())], names=["order", "key", "lang", "n"])

    counted = sample.mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("place", place).where(F.col("place") <= words_per_language).select("lang", "word", "n")
    entries = top.repartition("word").mapInArrow(split, "order int, key long, lang int, n long").groupBy("order", "key", "lang").agg(F.sum("n").alias("n"))
    return Model(languages, counted=entries.toArrow())


def language_id(docs: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> DataFrame:
    """doc_id, lang_pred, score of every row; the model is fitted on the rows where train holds (all by default)."""
    model = fit(docs if train is None else docs.where(train), text, lang, doc_id=doc_id, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by words_per_language for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in bounded_slices(batches, "text"):
            languages, scores = scorer.predict(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, train: Column | None = None, least: float = 0.5, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **bounds: int) -> DataFrame:
    """docs (all columns) without the rows whose language is undetermined or scores below least."""
    model = fit(docs if train is None else docs.where(train), text, lang, doc_id=doc_id, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in bounded_slices(batches, at):
            languages, scores = scorer.predict(as_bytes(batch.column(at)))
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(languages, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def contract(docs: DataFrame) -> DataFrame:
    """held_out rows are those whose crc32 of the id is 2 modulo 4; they are not learned from."""
    remainder = crc_mod("doc_id", 4)
    found = language_id(docs, remainder != 2)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
