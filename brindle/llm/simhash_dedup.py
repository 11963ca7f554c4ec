"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints link when at most three of their 64 bits differ. The bits are
dealt into three groups. Of three differing bits, at least one lies in some
group; hide that group and at most two differences stay visible, so the balls of
radius one (half the radius, rounded down) around the two visible parts meet in
a common variant. Every distinct fingerprint therefore emits, for each of the
three views, all variants of its visible part within distance one; the variants
are shuffled, and the fingerprints that share one are verified on all 64 bits.
No pair within the radius is missed, and nothing is capped.

Exact copies are folded into one fingerprint before anything is emitted, so the
work depends on distinct fingerprints only. Large variant groups are not
expanded into pairs: see ``_large_bucket``.

Null texts and texts without a word have the fingerprint zero, which links like
any other; null ids are kept, and a component's id is its smallest non-null id
(null if there is none); repeated rows stay repeated; an empty table gives an
empty result; very long texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_slices, materialize, popcount

RADIUS = 3
_GROUPS = 3
#: Bit positions by group (p % 3); the hidden bits of view v.
_HIDDEN = [sum(1 << p for p in range(64) if p % _GROUPS == v) for v in range(_GROUPS)]
_SMALL = 32
_ALL_PAIRS = 2048


def fingerprint(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles with repeats; A-Z lower-cased, zero without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = words_per_shingle
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    n = len(words) - k + 1
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the text does not leave the scan stage."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "text"):
            fps = [fingerprint(x, words_per_shingle, seed) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fps: DataFrame) -> DataFrame:
    """(view, key, fp): for each view, the visible bits and all their one-bit variants."""
    made, first = [], []
    for hidden in _HIDDEN:
        first.append(len(made))
        seen = F.col("fp").bitwiseAND(F.lit(_signed(~hidden & ((1 << 64) - 1))))
        flips = [0, *(1 << p for p in range(64) if not hidden >> p & 1)]
        made += [seen.bitwiseXOR(F.lit(_signed(f))) for f in flips]
    at = F.col("at")
    view = F.when(at < first[1], 0).when(at < first[2], 1).otherwise(2).cast("byte")
    return fps.select(F.posexplode(F.array(*made)).alias("at", "key"), "fp").select(view.alias("view"), "key", "fp")


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _large_bucket(view: int, key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one variant's fingerprints, without all pairs.

    Inside a bucket visible parts differ in two bits at most. Equal hidden parts
    thus always link, and so do hidden parts one bit apart. Three differences
    within the hidden group link when the visible parts are equal; those are
    looked for in the bucket whose variant is that visible part. Every other
    linked pair has another view in which one of these cases holds.
    """
    fps = np.unique(fps)
    hidden = np.uint64(_HIDDEN[view])
    sets = _Sets(len(fps))
    part = fps & hidden
    order = np.argsort(part, kind="stable")
    values, first, inverse = np.unique(part, return_index=True, return_inverse=True)
    same = part[order][1:] == part[order][:-1]
    sets.join(order[1:][same], order[:-1][same])
    bits = [np.uint64(1 << p) for p in range(64) if _HIDDEN[view] >> p & 1]

    def linked(among: np.ndarray, at: np.ndarray, flip: np.uint64) -> None:
        to = among ^ flip
        found = np.minimum(np.searchsorted(among, to), len(among) - 1)
        hit = (among[found] == to) & (to > among)
        sets.join(at[hit], at[found[hit]])

    for b in bits:
        linked(values, first, b)
    centre = np.uint64(key)
    own = np.flatnonzero((fps & ~hidden) == centre)
    if len(own) > 1:
        own = own[np.argsort(part[own])]
        among = part[own]
        if len(own) <= _ALL_PAIRS:
            for i in range(len(own) - 1):
                near = np.flatnonzero(popcount(among[i + 1 :] ^ among[i]) == RADIUS)
                sets.join(np.full(len(near), own[i]), own[i + 1 + near])
        else:
            for i in range(len(bits)):
                for j in range(i):
                    for k in range(j):
                        linked(among, own, bits[i] | bits[j] | bits[k])
    roots = np.array([sets.find(i) for i in range(len(fps))])
    away = roots != np.arange(len(fps))
    return fps[away], fps[roots[away]]


def _bucket_links(views: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (each distinct pair once) of whole buckets, sorted by view and key."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (views[1:] != views[:-1])])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    for s, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        a, b = _large_bucket(int(views[s]), int(keys[s]), fps[s : s + n])
        left.append(a)
        right.append(b)
    group = np.repeat(np.arange(len(starts)), sizes)
    use = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    f, g = fps[use], group[use]
    step = 1
    while step < _SMALL and len(f) > step:
        same = g[step:] == g[:-step]
        if not same.any():
            break
        near = same & (popcount(f[step:] ^ f[:-step]) <= RADIUS)
        left.append(f[step:][near])
        right.append(f[:-step][near])
        step += 1
    a, b = np.concatenate([*left, f[:0]]), np.concatenate([*right, f[:0]])
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def links(distinct_fps: DataFrame, partitions: int | None = None) -> DataFrame:
    """(a, b): verified links that connect exactly the fingerprints within the radius; distinct_fps has a column fp."""
    spark = distinct_fps.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _variants(distinct_fps.select("fp").repartition(n, "fp")).repartition(n, "view", "key").sortWithinPartitions("view", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []  # of the bucket that may go on in the next batch

        def out(v, k, f):
            a, b = _bucket_links(v, k, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def joined():
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            v, k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("view", "key", "fp"))
            k, f = k.view(np.uint64), f.view(np.uint64)
            other = np.flatnonzero((k != k[-1]) | (v != v[-1]))
            last = int(other[-1]) + 1 if len(other) else 0  # where the batch's last bucket begins
            if parts and (last or (parts[0][1][0], parts[0][0][0]) != (k[0], v[0])):
                parts.append((v[:last], k[:last], f[:last]))
                yield out(*joined())
                parts = []
            elif last:
                yield out(v[:last], k[:last], f[:last])
            parts.append((v[last:], k[last:], f[last:]))
        if parts:
            yield out(*joined())

    return rows.mapInArrow(run, "a long, b long").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), root the smallest node of the component, for every node of an edge.

    Alternating large-star and small-star steps until nothing moves; each round is materialised, so a
    lost executor repeats one round at most. Nodes must not be null.
    """
    def size(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = size(e)
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(low2, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(moved.union(low2.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        after = size(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def components_of(fps: DataFrame) -> DataFrame:
    """(fp, component fp) of every distinct fingerprint of fps (column fp) that has a link."""
    return connected_components(links(fps.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialize(fingerprints(docs, doc_id, text, words_per_shingle, seed))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = materialize(components_of(nodes))
    linked = nodes.join(stars, "fp").select("fp", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.select("fp", "root").join(of_root, "root").select(F.col("fp").alias("k"), "component_id")
    of_node = nodes.join(of_linked, F.col("fp") == F.col("k"), "left").select(F.col("fp").alias("k"), F.coalesce("component_id", "least").alias("component_id"))
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_node, F.col("fp") == F.col("k"), "left").select("doc_id", hex16.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs (all columns) with one row of each group: the smallest id, null ids last; of equal rows one."""
    row = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    place = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), row.alias("row"))
    slim = fingerprints(docs.select(place.alias("doc_id"), F.col(f"`{text}`").alias("text")), words_per_shingle=words_per_shingle, seed=seed)
    nodes = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = materialize(components_of(nodes))
    rooted = nodes.join(stars, "fp", "left").select("least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("_brindle_least")).select("_brindle_least")
    mark = "_brindle_place"
    while mark in docs.columns:
        mark += "_"
    kept = docs.withColumn(mark, place).join(best, F.col(mark) == F.col("_brindle_least"), "left_semi")
    return kept.dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
