"""Spelling variants: a vocabulary joined with itself at edit distance one over a trie.

Words are counted first, in each slice of documents and then by word. The vocabulary is
sorted into ranges of whole words (``repartitionByRange``), so that each task holds the
trie of some neighbouring prefixes, cut into chunks of CHUNK_CHARS characters.

In a chunk the trie is walked level by level with active-node sets. A node is active for
itself at distance 0; at distance 1 for another child of its parent (a replaced
character) and for its own child (an inserted one). A pair at distance 1 has no edits
left, so it goes down along equal characters only; where both ends are words, the pair
is emitted. All pairs of a level are moved at once, as arrays.

Two words of different chunks part at a position that is no deeper than what each shares
with its chunk's first or last word, for all words between two words share what these
share. At these few positions a word's pairs leave its chunk: the state (what stands
before the position, what follows) has to be met exactly, and goes by shuffle as a key,
the word without the character at that position. Words that differ there have the same
key and position, and a word that lacks the character is the key. A key has as many words
as the alphabet has letters, so there are no large groups, whatever prefix the words share.

Nothing is collected but counts. ``word`` is compared by code points, as Spark compares
strings.

Null texts have no words; a null id counts as an empty one in the sampling of slips;
repeated rows count each; texts and words of any length are read whole; an empty table
gives no rows; other columns are ignored. Of equally frequent near words the first in
code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_slices, materialize

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
SLIP = 31
CHUNK_CHARS = 1_000_000
TASK_CHARS = 4_000_000
FLUSH_WORDS = 200_000


def slipped(word: str, base: int, slip: int | None) -> str:
    """The word, or without one character where its hash says so."""
    h = zlib.crc32(word.encode(), base)
    if slip and h % slip == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters, A-Z in lower case, of at least min_chars and min_count.

    With slip, a run loses a character where crc32 of "<id>:<run>" is divisible by it.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in bounded_slices(batches, "text"):
            for key, data in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                found = runs.findall(data.lower().decode())  # bytes: only A-Z
                if not slip:
                    counts.update(found)
                    continue
                base = zlib.crc32(f"{'' if key is None else key}:".encode())
                for w, k in Counter(found).items():
                    w = slipped(w, base, slip)
                    if len(w) >= min_chars:
                        counts[w] += k
            if len(counts) > FLUSH_WORDS:
                yield flush()
        if counts:
            yield flush()

    slim = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Level:
    """Edges from the nodes of one level of a trie to the next: parent, character, child (its place); word: of the child, or -1."""

    def __init__(self, parent: np.ndarray, char: np.ndarray, word: np.ndarray, parents: int):
        self.parent, self.char, self.word = parent, char, word
        self.first = np.searchsorted(parent, np.arange(parents + 1))  # children of a node lie together, by character
        self.key = parent << 21 | char

    def __len__(self) -> int:
        return len(self.parent)


def trie(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[Level]:
    """Levels of the trie of sorted distinct words; level 0 has the edges from the root."""
    levels, own, node, parents = [], np.arange(len(starts)), np.zeros(len(starts), np.int64), 1
    depth = 0
    while True:
        inside = lengths[own] > depth
        own, node = own[inside], node[inside]
        if not len(own):
            return levels
        c = chars[starts[own] + depth].astype(np.int64)
        new = np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])]
        at = np.flatnonzero(new)
        ends = lengths[own[at]] == depth + 1  # the shortest of a node's words comes first
        levels.append(Level(node[at], c[at], np.where(ends, own[at], -1), parents))
        node, parents = np.cumsum(new) - 1, len(at)
        depth += 1


def _siblings(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the same node."""
    a, b, step = [], [], 1
    at = np.arange(len(level))
    while True:
        at = at[at + step < len(level)]
        at = at[level.parent[at + step] == level.parent[at]]
        if not len(at):
            return (np.concatenate(a), np.concatenate(b)) if a else (at, at)
        a.append(at)
        b.append(at + step)
        step += 1


def _down(x: np.ndarray, y: np.ndarray, of_x: Level | None, of_y: Level | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children with equal characters of the node pairs (x, y)."""
    none = np.zeros(0, np.int64)
    if of_x is None or of_y is None or not len(x):
        return none, none
    count = of_x.first[x + 1] - of_x.first[x]
    total = int(count.sum())
    if not total:
        return none, none
    child = np.arange(total) + np.repeat(of_x.first[x] - np.r_[0, np.cumsum(count)[:-1]], count)
    key = np.repeat(y, count) << 21 | of_x.char[child]
    place = np.searchsorted(of_y.key, key)
    place[place == len(of_y)] = 0
    met = of_y.key[place] == key if len(of_y) else np.zeros(total, bool)
    return child[met], place[met]


def near_pairs(levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """(word, word) at edit distance one, each pair once."""
    left, right = [], []
    none = np.zeros(0, np.int64)
    replaced = (none, none)  # both ends at the depth
    inserted = (none, none)  # the second end one deeper
    for depth, level in enumerate(levels):
        below = levels[depth + 1] if depth + 1 < len(levels) else None
        # ends at depth + 1
        moved = _down(*replaced, level, level)
        born = _siblings(level)
        replaced = np.concatenate([moved[0], born[0]]), np.concatenate([moved[1], born[1]])
        longer = _down(*inserted, level, below)
        if below is not None:  # a node of this level and its own children
            longer = np.concatenate([longer[0], below.parent]), np.concatenate([longer[1], np.arange(len(below))])
        if depth == 0:  # the root and its children, then down by equal characters
            first = np.arange(len(level))
            root = _down(np.zeros(len(level), np.int64), first, level, below)
            longer = np.concatenate([longer[0], root[0]]), np.concatenate([longer[1], root[1]])
        inserted = longer
        for (a, b), of_b in ((replaced, level), (inserted, below)):
            if of_b is not None and len(a):
                u, v = level.word[a], of_b.word[b]
                ends = (u >= 0) & (v >= 0)
                left.append(u[ends])
                right.append(v[ends])
    if not left:
        return none, none
    u, v = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def shared(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, with_word: int) -> np.ndarray:
    """How many leading characters each word shares with one of them."""
    target = chars[starts[with_word] : starts[with_word] + lengths[with_word]]
    out, own = np.zeros(len(starts), np.int64), np.arange(len(starts))
    for depth, c in enumerate(target.tolist()):
        own = own[lengths[own] > depth]
        own = own[chars[starts[own] + depth] == c]
        if not len(own):
            break
        out[own] = depth + 1
    return out


STATES = "kind string, word string, n long, other string, other_n long, at int, chunk long"


def _walked(words: DataFrame, partitions: int, chunk_chars: int) -> DataFrame:
    """Pairs found in chunks (kind pair), and the states that leave them (kind key: other is the word without the character at at)."""
    dealt = words.repartitionByRange(partitions, "word").sortWithinPartitions("word").withColumn("task", F.spark_partition_id().cast("long"))

    def walk(words: list[str], ns: list[int], chunk: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, text = np.array(ns, np.int64), np.array(words, object)
        u, v = near_pairs(trie(chars, starts, lengths))
        yield states("pair", text[u], n[u], text[v], n[v], np.zeros(len(u), np.int32), chunk)
        most = np.minimum(np.maximum(shared(chars, starts, lengths, 0), shared(chars, starts, lengths, len(words) - 1)), lengths - 1)
        word, at, key = [], [], []
        size = 0
        for i, deep in enumerate(most.tolist()):
            w = words[i]
            for p in range(deep + 1):
                word.append(i)
                at.append(p)
                key.append(w[:p] + w[p + 1 :])
            size += (deep + 1) * len(w)
            if size > chunk_chars:
                yield states("key", text[word], n[word], key, np.zeros(len(word), np.int64), np.array(at, np.int32), chunk)
                word, at, key, size = [], [], [], 0
        yield states("key", text[word], n[word], key, np.zeros(len(word), np.int64), np.array(at, np.int32), chunk)

    def states(kind, word, n, other, other_n, at, chunk) -> pa.RecordBatch:
        k = len(word)
        return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.string()), pa.array(list(word), pa.string()), pa.array(n), pa.array(list(other), pa.string()), pa.array(other_n), pa.array(at), pa.array(np.full(k, chunk, np.int64))], names=["kind", "word", "n", "other", "other_n", "at", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ns, size, chunk = [], [], 0, 0
        for batch in batches:
            for task, w, n in zip(batch.column("task").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                words.append(w)
                ns.append(n)
                size += len(w)
                if size >= chunk_chars:
                    yield from walk(words, ns, task << 32 | chunk)
                    words, ns, size, chunk = [], [], 0, chunk + 1
        if words:
            yield from walk(words, ns, task << 32 | chunk)

    return dealt.mapInArrow(run, STATES)


def near_words(words: DataFrame, chunk_chars: int = CHUNK_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words at edit distance one; words (word, n) is materialised."""
    spark = words.sparkSession
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // task_chars))
    states = materialize(_walked(words, partitions, chunk_chars))
    inside = states.where("kind = 'pair'").select("word", "n", F.col("other").alias("near"), F.col("other_n").alias("near_n"))
    keys = states.where("kind = 'key'").select("word", "n", F.col("other").alias("key"), "at", "chunk")
    # words that differ at the position: few share a key, each is paired with those before it
    groups = keys.groupBy("key", "at").agg(F.array_sort(F.collect_list(F.struct("word", "n", "chunk"))).alias("all")).where(F.size("all") > 1)
    each = groups.select("all", F.posexplode("all").alias("place", "a"))
    differ = each.select("a", F.explode(F.slice("all", F.col("place") + 2, F.size("all"))).alias("b")).where("a.chunk <> b.chunk")
    differ = differ.select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    # a word that lacks the character; the places in a run of equal characters give the same key
    longer = keys.select("word", "n", "key", "chunk").distinct()
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    lacks = longer.join(known, F.col("key") == F.col("near")).select("word", "n", "near", "near_n")
    # pairs of one chunk were found there, too
    pairs = inside.union(differ).union(lacks).select(F.least("word", "near").alias("word"), F.when(F.col("word") < F.col("near"), F.col("n")).otherwise(F.col("near_n")).alias("n"), F.greatest("word", "near").alias("near"), F.when(F.col("word") < F.col("near"), F.col("near_n")).otherwise(F.col("n")).alias("near_n")).distinct()
    ends = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(ends).alias("p")).select("p.word", "p.near", "p.near_n")


def variants(words: DataFrame, ratio: int = RATIO, chunk_chars: int = CHUNK_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of words (word, n)."""
    words = materialize(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    folded = near_words(words, chunk_chars, task_chars).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).withColumnRenamed("word", "_word")
    joined = words.join(folded, F.col("word") == F.col("_word"), "left").drop("_word")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    steps = rows.where("form is not null").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    # a form is ten times as frequent as its word, so chains are short
    ends = materialize(steps.select(F.col("_from").alias("start"), F.col("_to").alias("root")))
    while True:
        moved = materialize(ends.join(steps, F.col("root") == F.col("_from"), "left").select("start", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")))
        ends = moved.select("start", "root")
        if not moved.where("moved").limit(1).count():
            break
    return rows.join(ends, F.col("word") == F.col("start"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def contract(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs, slip=SLIP))
