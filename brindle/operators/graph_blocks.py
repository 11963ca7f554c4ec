"""A graph of few nodes in blocks of edges: tasks pass over the blocks, the nodes' state is broadcast to them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .pairs import arrays_of, is_packed

#: What a block holds of its nodes: their numbers, where their edges begin, the other edges' ends and weights, the degrees, and what of them are loops.
_KINDS = {"own": "i4", "begins": "i8", "ends": "i4", "weights": "f8", "k": "f8", "loops": "f8"}


def _binary(arrays: tuple, kinds: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(arrays, kinds, strict=True)], names=[f"c{i}" for i in range(len(kinds))])


def _arrays(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns, kinds, strict=True)]


def _some(parts: Iterator[tuple], least: int = 500_000) -> Iterator[list[np.ndarray]]:
    """Arrays of so many edges at least, the last ones excepted."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= least:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _schema(n: int) -> str:
    return ", ".join(f"c{i} binary" for i in range(n))


class Blocks:
    """Edges (a, b, weight, both ways, n of them, packed or not) of nodes (a) that are few: numbered in their order, their edges dealt by node to blocks of at most size edges or so.

    names, k (degrees) and count (edges) of the nodes are arrays in the driver; the edges
    are in the shared folder, and a task holds one block.
    """

    def __init__(self, edges: DataFrame, n: int, nodes: DataFrame, size: int):
        self.sc = edges.sparkSession.sparkContext
        self.names = np.sort(nodes.select(F.col("a").cast("long")).toArrow().column(0).to_numpy())
        names = self.shared = self.sc.broadcast(self.names)

        blocks = max(1, math.ceil(n / size))
        spark = edges.sparkSession
        tasks = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        number = F.col("id").cast("int")
        place = {r["task"]: r["id"] for r in spark.range(20 * tasks).select("id", F.pmod(F.hash(number), F.lit(tasks)).alias("task")).collect()}
        keys = [place.get(k, 20 * tasks + k) for k in range(blocks)]  # numbers that go to different tasks

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b, w in _some(arrays_of(batches)):
                x, y = np.searchsorted(names.value, a).astype(np.int32), np.searchsorted(names.value, b).astype(np.int32)
                order = np.argsort(x % blocks, kind="stable")
                cuts = np.searchsorted((x % blocks)[order], np.arange(blocks + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[k] : cuts[k + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k]], pa.int32()), *(pa.array([z.tobytes()], pa.binary()) for z in (x[at], y[at], w[at]))], names=["block", "x", "y", "w"])

        def build(table: pa.Table) -> pa.Table:
            x, y, w = (np.concatenate([np.frombuffer(z.as_buffer(), kind) for z in table[c]]) for c, kind in (("x", "i4"), ("y", "i4"), ("w", "f8")))
            own, at = np.unique(x, return_inverse=True)
            k, other = np.bincount(at, w, len(own)), x != y
            loops = np.bincount(at[~other], w[~other], len(own))
            at, y, w = at[other], y[other], w[other]
            order = np.argsort(at * len(names.value) + y)
            begins = np.searchsorted(at[order], np.arange(len(own) + 1))
            return pa.Table.from_batches([_binary((own, begins, y[order], w[order], k, loops), tuple(_KINDS.values()))])

        rows = edges if is_packed(edges) else edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double"))
        parts = rows.mapInArrow(dealt, "block int, x binary, y binary, w binary")
        self.blocks = materialize(parts.repartition(tasks, "block").groupBy("block").applyInArrow(build, _schema(len(_KINDS))))
        self.k, self.count = np.zeros(len(self.names)), np.zeros(len(self.names), np.int64)
        for own, k, m in self.each(lambda own, begins, ends, weights, k, loops: (own, k, np.diff(begins)), ("i4", "f8", "i8")):
            self.k[own], self.count[own] = k, m

    def each(self, run: Callable, kinds: tuple[str, ...], *state, then: Callable | None = None) -> list[list[np.ndarray]]:
        """run(*block, *state) of every block, a tuple of arrays of these kinds; then: the nodes, and one more number of each, that one task makes of all of them."""
        held = self.sc.broadcast(state)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _arrays(batches, tuple(_KINDS.values())):
                yield _binary(run(*block, *held.value), kinds)

        found = self.blocks.mapInArrow(over, _schema(len(kinds)))
        if then:
            found = found.repartition(1).mapInArrow(lambda batches: iter([_binary(then(list(_arrays(batches, kinds)), *held.value), ("i4", "i4"))]), _schema(2))
        rows = found.collect()  # one a block
        held.destroy()
        return [[np.frombuffer(c, kind) for c, kind in zip(row, ("i4", "i4") if then else kinds, strict=True)] for row in rows]

    def rows(self, run: Callable, schema: str, *state) -> DataFrame:
        """The rows that run(names, *block, *state) gives of every block, as arrays of the schema's columns; kept."""
        held, names = self.sc.broadcast(state), self.shared
        columns = [x.split()[0] for x in schema.split(", ")]

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _arrays(batches, tuple(_KINDS.values())):
                yield from pa.table([pa.array(x) for x in run(names.value, *block, *held.value)], names=columns).to_batches(max_chunksize=100_000)

        return materialize(self.blocks.mapInArrow(over, schema))

    def components(self) -> np.ndarray:
        """The smallest node that each node can reach."""

        def near(own, begins, ends, weights, k, loops, root):
            some = np.flatnonzero(np.diff(begins))
            return own[some], np.minimum.reduceat(root[ends], begins[some]) if len(some) else ends[:0]

        root = np.arange(len(self.names), dtype=np.int32)
        while True:
            up = root.copy()
            for own, least in self.each(near, ("i4", "i4"), root):
                np.minimum.at(up, root[own], least)  # a node's root follows what the node has found
            while (up != up[up]).any():
                up = up[up]
            if (up[root] == root).all():
                return root
            root = up[root]

    def labels(self, label: np.ndarray, kept: np.ndarray) -> DataFrame:
        """(node, label) of the nodes kept."""

        def run(names, own, begins, ends, weights, k, loops, label, kept):
            own = own[kept[own]]
            return names[own], names[label[own]]

        return self.rows(run, "node long, label long", label, kept)

    def parts(self, key: np.ndarray, kept: np.ndarray) -> DataFrame:
        """(key, a, b, weight): the edges of the nodes kept, with a loop of a node that has one or nothing else."""

        def run(names, own, begins, ends, weights, k, loops, key, kept):
            m = np.diff(begins)
            x = np.repeat(own, m)
            on = kept[x]
            alone = kept[own] & ((m == 0) | (loops > 0))
            a, b = np.concatenate([x[on], own[alone]]), np.concatenate([ends[on], own[alone]])
            return key[a], names[a], names[b], np.concatenate([weights[on], loops[alone]])

        return self.rows(run, "key long, a long, b long, weight double", key, kept)

    def folded(self, label: np.ndarray, kept: np.ndarray) -> DataFrame:
        """(a, b, weight) between the labels of the nodes kept, loops included."""

        def run(names, own, begins, ends, weights, k, loops, label, kept):
            x = np.repeat(own, np.diff(begins))
            on, also = kept[x], kept[own]
            la, lb = np.concatenate([label[x[on]], label[own[also]]]), np.concatenate([label[ends[on]], label[own[also]]])
            pair, at = np.unique(la.astype(np.int64) * len(names) + lb, return_inverse=True)
            return names[pair // len(names)], names[pair % len(names)], np.bincount(at, np.concatenate([weights[on], loops[also]]), len(pair))

        each = self.rows(run, "a long, b long, weight double", label, kept)
        return materialize(each.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
