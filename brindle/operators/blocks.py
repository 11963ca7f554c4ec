"""All pairs of rows by blocks: a task holds two blocks as arrays, so that only pairs that count become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a vector of 64 floats takes 1 MB a block.
BLOCK = 4_096
#: Vectors of the first block that are compared at once.
SLICE = 256


def packed(df: DataFrame, key: str, value: str, size: int = BLOCK) -> tuple[DataFrame, int]:
    """((block, keys, values), number of blocks): about so many rows a block, dealt by the hash of their keys (counted first)."""
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    n = max(1, -(-rows.count() // size))
    packs = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("k", "v")).alias("r"))
    return packs.select("block", F.col("r.k").alias("keys"), F.col("r.v").alias("values")), n


def meet(left: tuple[DataFrame, int], right: tuple[DataFrame, int], run: Callable, schema: str, half: bool = False) -> DataFrame:
    """The rows that run(keys, values, other keys, other values, same block) makes of each block of left with each of right.

    run gets Arrow arrays and returns columns. half is for a table with itself: each two
    blocks meet once.
    """
    (a, n), (b, m) = left, right
    tasks = min(n * m, 1_000)
    here = a.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block") if half else F.lit(m - 1)))).repartition(tasks, "block", "other")
    there = b.select(F.col("block").alias("other"), F.col("keys").alias("keys2"), F.col("values").alias("values2"))
    there = there.withColumn("block", F.explode(F.sequence(F.col("other") if half else F.lit(0), F.lit(n - 1)))).repartition(tasks, "block", "other")
    pairs = here.join(there.hint("merge"), ["block", "other"])
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c) for c in ("block", "other", "keys", "values", "keys2", "values2")}
            for i in range(batch.num_rows):
                same = half and cols["block"][i].as_py() == cols["other"][i].as_py()
                for out in run(*(cols[c][i].values for c in ("keys", "values", "keys2", "values2")), same):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return pairs.mapInArrow(each, schema)


def hamming(keys, values, keys2, values2, same: bool, radius: int) -> Iterator[tuple]:
    """(a, b, distance), a < b, of 64-bit values within the radius."""
    k, k2 = keys.to_numpy(zero_copy_only=False), keys2.to_numpy(zero_copy_only=False)
    v, v2 = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (values, values2))
    for at in range(0, len(k), SLICE):
        far = np.bitwise_count(v[at : at + SLICE, None] ^ v2[None, :])
        x, y = np.nonzero(far <= radius)
        one, two = k[at : at + SLICE][x], k2[y]
        on = one < two if same else one != two
        x, y, one, two = x[on], y[on], one[on], two[on]
        yield np.minimum(one, two), np.maximum(one, two), far[x, y].astype(np.int32)


def _rows(values) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of doubles, sizes) of a list array; shorter vectors are filled with zeros, null ones and those with a null have the size -1."""
    sizes = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy()), -1)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=1)))))
    spot = np.arange(out.shape[1])[None, :] < sizes[:, None]
    flat = values.flatten()
    out[spot] = flat.to_numpy(zero_copy_only=False)
    gaps = np.zeros(out.shape, bool)
    gaps[spot] = flat.is_null().to_numpy(zero_copy_only=False)
    return out, np.where(gaps.any(axis=1), -1, sizes)


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of the rows from left to right, as an aggregate over an array adds them."""
    return np.add.accumulate(x, axis=1)[:, -1] + 0.0


def nearest(keys, values, keys2, values2, same: bool, n: int, least: float) -> Iterator[tuple]:
    """(key, key2, cosine) of other keys that can be among the first n of a key by cosine from least on, rounded to six digits.

    A matrix product finds them with some slack; their cosines are then added up in the
    order of vectors.cosine. Of rows with one cosine the first n by key are enough.
    """
    slack = 2e-6
    (a, size), (b, size2) = _rows(values), _rows(values2)
    k, k2 = keys.to_numpy(zero_copy_only=False), keys2.to_numpy(zero_copy_only=False)
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    norm, norm2 = (np.sqrt(_summed(x * x)) for x in (a, b))
    ua, ub = (x / np.where(y > 0, y, 1)[:, None] for x, y in ((a, norm), (b, norm2)))
    for at in range(0, len(k), SLICE):
        like = ua[at : at + SLICE] @ ub.T
        like[np.isnan(like)] = 3.0  # NaN is the greatest
        like[size[at : at + SLICE, None] != size2[None, :]] = 0.0
        like[k[at : at + SLICE, None] == k2[None, :]] = -2.0
        like[size[at : at + SLICE] < 0] = -2.0
        like[:, size2 < 0] = -2.0
        best = np.partition(like, -min(n, like.shape[1]), axis=1)[:, -min(n, like.shape[1])]
        x, y = np.nonzero((like >= np.maximum(best, least)[:, None] - slack) & (like > -2.0))
        s = np.empty(len(x))
        for j in range(0, len(x), 65_536):
            part = slice(j, j + 65_536)
            p, q = x[part] + at, y[part]
            length = norm[p] * norm2[q]
            alike = (size[p] == size2[q]) & (length != 0)
            s[part] = np.where(alike, _summed(a[p] * b[q]) / np.where(length == 0, 1, length), 0.0)
        rank = np.where(np.isnan(s), np.inf, s)
        order = np.lexsort((k2[y], -rank, x))
        x, y, s, rank = x[order], y[order], s[order], rank[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (rank[1:] != rank[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        on = np.arange(len(x)) - first < n
        yield k[at + x[on]], k2[y[on]], s[on]
