"""Pairs of numbers that lists have in common, counted as arrays: a row holds many pairs, no pair is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize

#: Pairs that a bucket is to hold, or so; a task counts one bucket at a time.
BUCKET_PAIRS = 1_000_000


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts."""
    order = np.argsort(key)
    key, count = key[order], count[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    return key[new], np.add.reduceat(count, new) if len(new) else count


def common_pairs(lists: DataFrame, least: int) -> DataFrame:
    """Packed (a, b, weight), a < b: pairs of numbers that at least so many lists hold, with how many do.

    lists is (own: array<int>, copies: long), each list once, with how often it is there, its
    numbers from 0 on, sorted and without repeats; it is read twice. The pairs of some lists
    go, sorted, to buckets by their smaller number: each such number once, and the larger
    ones after it.
    """
    kept = lists.select("own", "copies").where(F.size("own") > 1)
    total, most = kept.agg(F.sum(F.size("own").cast("long") * (F.size("own") - 1) / 2), F.max(F.element_at("own", -1))).first()
    buckets = max(1, -(-int(total or 0) // BUCKET_PAIRS))
    width = (most or 0) // buckets + 1  # numbers of a bucket

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, copies = batch.column(0), batch.column(1).to_numpy()
            begins, flat = own.offsets.to_numpy().astype(np.int64), own.values.to_numpy()
            size = np.diff(begins)
            keys, counts = [], []
            for m in np.unique(size).tolist():
                rows = np.flatnonzero(size == m)
                held = flat[begins[rows][:, None] + np.arange(m)].astype(np.int64)
                first, second = np.triu_indices(m, 1)
                a = held % buckets * width + held // buckets  # a bucket's numbers lie side by side
                keys.append((a[:, first] << 32 | held[:, second]).ravel())
                counts.append(np.repeat(copies[rows], len(first)))
            if not keys:
                continue
            key, count = _summed(np.concatenate(keys), np.concatenate(counts))
            a, b = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
            cuts = np.searchsorted(a // width, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[k], cuts[k + 1]
                heads, sizes = np.unique(a[i:j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (heads.astype(np.int32), sizes.astype(np.int32), b[i:j], count[i:j]))], names=["bucket", "heads", "sizes", "b", "count"])

    def counted(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[c]]
        heads, sizes = np.concatenate(read("heads", "i4")).astype(np.int64), np.concatenate(read("sizes", "i4"))
        key, count = _summed(np.repeat(heads, sizes) << 32 | np.concatenate(read("b", "i4")), np.concatenate(read("count", "i8")))
        key, count = key[count >= least], count[count >= least]
        a = key >> 32
        return packed(a % width * buckets + a // width, key & 0xFFFFFFFF, count)

    parts = kept.mapInArrow(dealt, "bucket int, heads binary, sizes binary, b binary, count binary")
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 3)
    return materialize(parts.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(counted, PACKED))


PACKED = "a binary, b binary, weight binary"


def packed(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> pa.Table:
    """One row of packed edges."""
    return pa.table([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((a, "i8"), (b, "i8"), (weight, "f8"))], names=["a", "b", "weight"])


def arrays_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b, weight of edges, packed or not, as arrays."""
    for batch in batches:
        if pa.types.is_binary(batch.column(0).type):
            for row in zip(*batch.columns, strict=True):
                yield tuple(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("i8", "i8", "f8"), strict=True))
        elif batch.num_rows:
            yield tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns)


def is_packed(edges: DataFrame) -> bool:
    return dict(edges.dtypes)["a"] == "binary"


def unpacked(edges: DataFrame) -> DataFrame:
    """(a, b, weight) as rows."""
    if not is_packed(edges):
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, w in arrays_of(batches):
            yield from pa.table([a, b, w], names=["a", "b", "weight"]).to_batches(max_chunksize=100_000)

    return edges.mapInArrow(run, "a long, b long, weight double")


def both_ways(edges: DataFrame) -> DataFrame:
    """Packed edges and their reverse."""
    return edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))


def sizes_and_nodes(edges: DataFrame) -> tuple[int, DataFrame]:
    """How many edges there are, and the distinct a."""
    if not is_packed(edges):
        return edges.count(), edges.select("a").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, _, _ in arrays_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(a))], names=["a"])

    n = edges.agg(F.sum(F.length("a"))).first()[0] or 0
    return n // 8, edges.select("a", "b", "weight").mapInArrow(run, "a long").distinct()
