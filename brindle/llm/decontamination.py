"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are lower-cased and stripped of all but letters and digits; a text is the
bag of its five-word shingles (a shorter item is one shingle). For every benchmark
item, windows of its number of words slide over a document one word at a time; a
document with fewer words is one window. A window's SimHash is made of its word
pairs, which an edit disturbs less than five-word shingles, and has ``HASHES``
independent words of 64 bits. The multi-index finds every item of that size that
differs in ``radius`` bits at most in one of the words: the 64 bits are cut into
four blocks of sixteen, of which one has at most a quarter of the differences;
items are filed under all block values within half of those flips, windows look
up all values within the other half. Under one in twenty random pairs is a
candidate. Candidates are verified by the exact weighted similarity of their
shingle bags, the sum of the lesser weights over the mean of the totals, with the
multiplicity as weight, at every place of the run of windows; it has to reach
``threshold``.

Windows without any benchmark shingle have similarity zero with every item and
are not fingerprinted, which loses nothing. What the radius can lose: at
similarity 0.8 exactly about one pair in a hundred with scattered edits, and of a
hundred words with one run of edits one in ten; tests measure it. The benchmark
is shipped to the executors in blocks of a checked size, one pass over the
documents for each, so a large benchmark costs passes, not memory.

One row per document and item: the best window (the first of equal ones), its
similarity and the least distance of a window of that run. Null and empty texts on
either side match nothing; ids may be null or repeated, each row is searched by
itself; items with equal texts are all reported; very long texts are searched
whole, a few thousand windows at a time; an empty table on either side gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, bounded_slices, mix64, popcount

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 11
HASHES = 4
BLOCK_BYTES = 8 << 20
STORE = 400_000
_NOT_WORD = re.compile(r"[\W_]+")
#: Odd multipliers that make the words of a fingerprint independent, fixed values.
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

_words: dict[bytes, int] = {}


def word_keys(words: list[bytes]) -> np.ndarray:
    """Hashes of normalised words; zero for a word without a letter or digit."""
    if len(_words) > STORE:
        _words.clear()
    for w in set(words).difference(_words):
        bare = w.lower() if w.isalpha() else _NOT_WORD.sub("", w.decode("utf-8", "replace").lower()).encode()
        _words[w] = (xxhash.xxh64_intdigest(bare, 5) >> 1 | 1) if bare else 0
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words)).view(np.uint64)


def runs(keys: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(keys) - k + 1
    if n < 1:
        return keys[:0]
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + keys[i : n + i]
    return mix64(out)


def shingles(keys: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of all words if there are fewer."""
    return runs(keys, min(SHINGLE, len(keys))) if len(keys) else keys


def _signs(pairs: np.ndarray) -> np.ndarray:
    """(n, HASHES * 64) of +1 and -1 by bit."""
    words = np.stack([mix64(pairs * salt) for salt in _SALTS[:HASHES]], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8 * HASHES), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """(n, HASHES) fingerprints from sums of signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """The fingerprint of a whole text of two words or more."""
    return _pack(_signs(runs(keys, 2)).sum(axis=0)[None, :])[0]


@cache
def _flips(most: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(16), k)], np.uint32)


def _block_values(fps: np.ndarray, most: int) -> np.ndarray:
    """(n, values): the 16-bit blocks of each fingerprint with all flips, marked with word and block."""
    blocks = np.ascontiguousarray(fps.astype("<u8")).view("<u2").astype(np.uint32).reshape(len(fps), -1)
    marks = np.arange(blocks.shape[1], dtype=np.uint32) << np.uint32(16)
    return ((blocks[:, :, None] ^ _flips(most)) | marks[None, :, None]).reshape(len(fps), -1)


class Size:
    """The items of one number of words, with their multi-index; fps is (n,) or (n, words of a fingerprint)."""

    def __init__(self, items: list[int], bags: list[dict[int, int]], fps: np.ndarray):
        self.items, self.bags = items, bags
        self.fps = fps.reshape(len(items), -1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        if most not in self.tables:
            values = _block_values(self.fps, most)
            item = np.repeat(np.arange(len(self.items), dtype=np.int32), values.shape[1])
            order = np.argsort(values.ravel(), kind="stable")
            self.tables[most] = values.ravel()[order], item[order]
        return self.tables[most]

    def candidates(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs with a block within a quarter of the radius, each once."""
        fps = fps.reshape(len(fps), -1)
        flips = radius // 4
        keys, filed = self._table(flips - flips // 2)
        asked = _block_values(fps, flips // 2)
        a = np.searchsorted(keys, asked.ravel(), side="left")
        n = np.searchsorted(keys, asked.ravel(), side="right") - a
        hit = np.flatnonzero(n)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.repeat(a[hit] - np.r_[0, np.cumsum(n[hit])[:-1]], n[hit]) + np.arange(n[hit].sum())
        window = np.repeat(hit // asked.shape[1], n[hit])
        pair = np.unique(window * len(self.items) + filed[place])
        return pair // len(self.items), pair % len(self.items)

    def near(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius; the distance is the least of the words'."""
        fps = fps.reshape(len(fps), -1)
        w, i = self.candidates(fps, radius)
        far = popcount(fps[w] ^ self.fps[i]).min(axis=1) if len(w) else np.zeros(0, np.int64)
        use = far <= radius
        return w[use], i[use], far[use]


class Index:
    """A block of the benchmark."""

    def __init__(self, items: list[tuple[int, bytes]], radius: int = RADIUS, threshold: float = THRESHOLD):
        if not 0 <= radius <= 23:
            raise ValueError("radius is 0 to 23: beyond that the blocks select nothing")
        self.radius, self.threshold = radius, threshold
        self.ids = [i for i, _ in items]
        by_size: dict[int, list] = {}
        posted: list[tuple[int, int]] = []
        whole: dict[int, list[tuple[int, int]]] = {}
        for at, (_, text) in enumerate(items):
            keys = word_keys((text or b"").split())
            keys = keys[keys > 0]
            if not len(keys):
                continue
            own = shingles(keys)
            if len(keys) < SHINGLE:  # one shingle, alike only if equal
                whole.setdefault(len(keys), []).append((int(own[0]), at))
                continue
            values, counts = np.unique(own, return_counts=True)
            by_size.setdefault(len(keys), []).append((at, dict(zip(values.tolist(), counts.tolist(), strict=True)), fingerprint(keys)))
            posted += [(v, len(keys)) for v in values.tolist()]
        self.sizes = {n: Size([x[0] for x in v], [x[1] for x in v], np.array([x[2] for x in v], np.uint64)) for n, v in by_size.items()}
        self.short = {n: (np.array(sorted({h for h, _ in v}), np.uint64), _by_first(v)) for n, v in sorted(whole.items())}
        posted = sorted(set(posted))
        self.known = np.array([v for v, _ in posted], np.uint64)
        self.known_size = np.array([n for _, n in posted], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def search(self, keys: np.ndarray, grams: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, start, words, similarity, distance): the best window of each item in a document; hits are places of known shingles."""
        best: dict[int, tuple] = {}
        for size in self._sizes_of(grams, hits):
            self._windows(size, keys, grams, hits, best)
        for size, (values, items) in self.short.items():
            own = runs(keys, size)
            for at in np.flatnonzero(np.isin(own, values)).tolist():
                for item in items[int(own[at])]:
                    best.setdefault(item, (1.0, at, size, 1.0, 0))
        return [(item, *found[1:]) for item, found in sorted(best.items())]

    def _sizes_of(self, grams: np.ndarray, hits: np.ndarray) -> list[int]:
        own = grams[hits]
        a, b = np.searchsorted(self.known, own, side="left"), np.searchsorted(self.known, own, side="right")
        return sorted({int(self.known_size[i]) for x, y in set(zip(a.tolist(), b.tolist(), strict=True)) for i in range(x, y)})

    def _windows(self, size: int, keys: np.ndarray, grams: np.ndarray, hits: np.ndarray, best: dict) -> None:
        if len(keys) < size:  # the document is the window
            span = len(grams)
            if 2 * span >= self.threshold * (span + size - SHINGLE + 1):
                self._verify(size, 0, grams, span, fingerprint(keys)[None, :], best, len(keys))
            return
        span = size - SHINGLE + 1  # shingles of a window
        last = len(grams) - span
        edge = np.zeros(last + 2, np.int64)
        np.add.at(edge, np.clip(hits - span + 1, 0, last + 1), 1)
        np.add.at(edge, np.minimum(hits, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[: last + 1]) > 0)
        for at in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for a in range(0, len(at), 2048):
                part = at[a : a + 2048]
                pairs = runs(keys[part[0] : part[-1] + size], 2)
                run = np.cumsum(np.vstack([np.zeros((1, 64 * HASHES), np.int32), _signs(pairs)]), axis=0)
                fps = _pack(run[size - 1 :] - run[: len(part)])
                self._verify(size, int(part[0]), grams[part[0] : part[-1] + span], span, fps, best, size)

    def _verify(self, size: int, start: int, grams: np.ndarray, span: int, fps: np.ndarray, best: dict, words: int) -> None:
        """Exact similarity of every candidate item at all windows of a run that could still be its best."""
        found = self.sizes[size]
        _, i, far = found.near(fps, self.radius)
        total = (span + size - SHINGLE + 1) / 2
        for k in np.unique(i).tolist():
            item, bag = found.items[k], found.bags[k]
            if item in best and best[item][0] >= 1.0:
                continue
            held = np.isin(grams, np.fromiter(bag, np.uint64, len(bag)))
            run = np.r_[0, np.cumsum(held)]
            bound = (run[span:] - run[: len(run) - span]) / total
            least = int(far[i == k].min())
            for w in np.lexsort((np.arange(len(bound)), -bound)).tolist():
                old = best.get(item)
                if bound[w] < self.threshold or (old is not None and bound[w] < old[0]):
                    break
                seen: dict[int, int] = {}
                for g in grams[w : w + span][held[w : w + span]].tolist():
                    seen[g] = seen.get(g, 0) + 1
                alike = sum(min(n, bag[g]) for g, n in seen.items()) / total
                if alike >= self.threshold and (old is None or (alike, -(start + w)) > (old[0], -old[1])):
                    best[item] = (alike, start + w, words, alike, least)
                if alike >= 1.0:
                    break


def _by_first(pairs: list[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def _hits(batch_texts: list[bytes], index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, kept word keys, shingles, places of known ones) of the rows worth a search."""
    words = [t.split() for t in batch_texts]
    flat = word_keys(list(chain.from_iterable(words)))
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    kept = flat > 0
    flat, row = flat[kept], row[kept]
    ends = np.searchsorted(row, np.arange(len(words)), side="right")
    starts = np.searchsorted(row, np.arange(len(words)), side="left")
    found = np.zeros(0, np.int64)
    if len(flat) >= SHINGLE and len(index.known):
        grams = runs(flat, SHINGLE)
        maybe = np.flatnonzero(index.filter[(grams >> np.uint64(44)).astype(np.int64)] & (row[: len(grams)] == row[SHINGLE - 1 :]))
        place = np.minimum(np.searchsorted(index.known, grams[maybe]), len(index.known) - 1)
        found = maybe[index.known[place] == grams[maybe]]
    hit_rows = [row[found]]
    for size, (values, _) in index.short.items():
        own = runs(flat, size)
        maybe = np.flatnonzero(np.isin(own, values))
        hit_rows.append(row[maybe[row[maybe] == row[maybe + size - 1]]])
    rows = np.unique(np.concatenate(hit_rows))
    a, b = np.searchsorted(found, starts[rows]), np.searchsorted(found, ends[rows])
    for k, r in enumerate(rows.tolist()):
        keys = flat[starts[r] : ends[r]]
        yield r, keys, runs(keys, SHINGLE), found[a[k] : b[k]] - starts[r]


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of about block_bytes, streamed to the driver one partition at a time."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.encode(F.col(text), "UTF-8").alias("text")).where("text is not null").orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["item_id"], bytes(r["text"])))
        size += len(r["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, distance of each document's best window for each item that it holds."""
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    item_type = T._parse_datatype_string(kinds[1])
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, n_words long, similarity double, distance int"
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = to_arrow_type(item_type)

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, radius, threshold)
            for batch in bounded_slices(batches, "text"):
                rows, found = [], []
                for r, keys, grams, hits in _hits(as_bytes(batch.column("text")), index):
                    for x in index.search(keys, grams, hits):
                        rows.append(r)
                        found.append(x)
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([index.ids[i] for i in cols[0]], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())],
                    names=["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"],
                )

        return run

    out = None
    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        part = slim.mapInArrow(searcher(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs (all columns) without the rows that hold a benchmark item."""
    at = docs.columns.index(text)

    def filterer(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, radius, threshold)
            for batch in bounded_slices(batches, at):
                kept = np.ones(batch.num_rows, bool)
                for r, keys, grams, hits in _hits(as_bytes(batch.column(at)), index):
                    kept[r] = not index.search(keys, grams, hits)
                yield batch.filter(pa.array(kept))

        return run

    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        docs = docs.mapInArrow(filterer(docs.sparkSession.sparkContext.broadcast(block)), T.StructType(docs.schema.fields))
    return docs
