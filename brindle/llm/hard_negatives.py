"""Hard-negative mining by dual-tree search over anchors and candidates.

A tree of cells is fitted on a bounded sample (SAMPLE rows): each node halves the sample
at the median of its widest dimension. Every row is filed under its cell, and each cell
has a ball for its anchors and one for its candidates. The inner products of two balls
lie in an interval round that of their centres; a pair of nodes whose interval cannot
matter is dropped with all anchors and candidates below it. So a pair of cells either
goes, or the cell's anchors are sent to the candidates' chunks. There both get trees of
their own, node pairs are pruned by the same intervals with the bounds reached so far,
and the leaf pairs left are scored exactly.

Two searches follow each other: each anchor's best rows of its own label (positives),
then, as their scores set the bounds, the best rows of other labels in each positive's
range. Before each, a bounded number of rows (SCOUTS) is scored for first bounds; those
are bounds only, nothing is decided by them.

Chunks hold CHUNK rows at most on average, whatever a cell holds (a cell of one repeated
vector is dealt by hash into several), so that a task's memory is bounded; anchors pass
through it in blocks. Anchors go to chunks by shuffle, and partial results, a few an
anchor and chunk, come back by shuffle. Nothing but the sample, the cells' balls (CELLS
at most) and counts reaches the driver.

Components are whole numbers in doubles; where products fit 53 bits they are computed by
matrix products, otherwise as Python integers held within a long's range. Rows with a
null label, a null vector, or a null or non-finite component take no part. Shorter
vectors count as filled up with zeros. A row without an id takes part (never as an anchor
in the contract) and comes last among ties. Repeated rows take part each by itself; an
anchor's "other rows" are all but that row. An anchor without positives, and a positive
without a fitting negative, give no rows; nor does an empty table. Other columns are
ignored. Ids and labels are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 8_192
SCOUTS = 1_024
CELLS = 1_024
CHUNK = 65_536
LEAST_CHUNK = 1_024
LEAF = 256
ANCHOR_LEAF = 64
BLOCK = 2_048
LONG = (1 << 63) - 1


class Tree:
    """Balls over rows: node k covers rows start[k] to end[k] of the order; left and right are -1 in leaves."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.start, self.end, self.left, self.right, self.cut = [], [], [], [], []
        if len(points):
            self._node(0, len(points))
        todo = list(range(len(self.start)))
        while todo:
            k = todo.pop()
            s, e = self.start[k], self.end[k]
            if e - s <= leaf:
                continue
            own = points[self.order[s:e]]
            d = int(np.argmax(own.max(0) - own.min(0))) if points.shape[1] else 0
            if not points.shape[1] or own[:, d].max() == own[:, d].min():
                continue  # equal rows
            half = (e - s) // 2
            at = np.argpartition(own[:, d], half)
            self.order[s:e] = self.order[s:e][at]
            self.cut[k] = (d, points[self.order[s + half], d])
            self.left[k], self.right[k] = self._node(s, s + half), self._node(s + half, e)
            todo += [self.left[k], self.right[k]]
        self.start, self.end = np.array(self.start, int), np.array(self.end, int)
        self.left, self.right = np.array(self.left, int), np.array(self.right, int)
        placed = points[self.order]
        self.centre = np.array([placed[s:e].mean(0) for s, e in zip(self.start, self.end, strict=True)]).reshape(len(self.start), points.shape[1])
        self.radius = np.array([np.sqrt(((placed[s:e] - c) ** 2).sum(1).max()) for s, e, c in zip(self.start, self.end, self.centre, strict=True)])

    def _node(self, s: int, e: int) -> int:
        for column, value in ((self.start, s), (self.end, e), (self.left, -1), (self.right, -1), (self.cut, None)):
            column.append(value)
        return len(self.start) - 1

    def over(self, values: np.ndarray, fold: np.ufunc) -> np.ndarray:
        """fold of the values (in the tree's order) of each node."""
        return np.array([fold.reduce(values[s:e]) for s, e in zip(self.start, self.end, strict=True)])


def intervals(a_centre: np.ndarray, a_radius: np.ndarray, c_centre: np.ndarray, c_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of points of two balls, pair by pair, with slack for rounding."""
    middle = (a_centre * c_centre).sum(1)
    a_norm, c_norm = np.sqrt((a_centre**2).sum(1)), np.sqrt((c_centre**2).sum(1))
    wide = a_norm * c_radius + c_norm * a_radius + a_radius * c_radius
    wide = wide + 1e-9 * (wide + a_norm * c_norm) + 1e-6
    return middle - wide, middle + wide


def surviving(a: Tree, c: Tree, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor leaf, candidate leaf, least, greatest product) of the leaf pairs that no node pair above them rules out."""
    x, y = np.zeros(min(1, len(a.start)), int), np.zeros(min(1, len(a.start), len(c.start)), int)
    x, found = x[: len(y)], []
    while len(x):
        low, high = intervals(a.centre[x], a.radius[x], c.centre[y], c.radius[y])
        good = keep(x, y, low, high)
        x, y, low, high = x[good], y[good], low[good], high[good]
        x_leaf, y_leaf = a.left[x] < 0, c.left[y] < 0
        done = x_leaf & y_leaf
        found.append((x[done], y[done], low[done], high[done]))
        wider = ~x_leaf & (y_leaf | (a.radius[x] >= c.radius[y]))  # the wider node is opened
        other = ~done & ~wider
        x, y = np.concatenate([a.left[x[wider]], a.right[x[wider]], x[other], x[other]]), np.concatenate([y[wider], y[wider], c.left[y[other]], c.right[y[other]]])
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (int, int, float, float))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of every row and their columns, the first of equal ones first; scores is used up."""
    rows = np.arange(len(scores))
    values, columns = np.empty((len(scores), k), scores.dtype), np.empty((len(scores), k), int)
    for t in range(k):
        j = scores.argmax(1)
        values[:, t], columns[:, t] = scores[rows, j], j
        scores[rows, j] = -np.inf
    return values, columns


class Rows:
    """Rows of a chunk or a block: vectors (doubles), exact (what products are computed from), ids, labels, uids."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, exact: bool):
        batch = pa.Table.from_batches(parts)
        self.vectors = np.concatenate([matrix(p.column("vec"), dim) for p in parts])
        self.exact = self.vectors if exact else np.array([[int(v) for v in row] for row in self.vectors.tolist()], object).reshape(self.vectors.shape)
        self.label, self.uid = batch["label"].to_numpy(), batch["uid"].to_numpy()
        self.ids = batch["vec_id"].combine_chunks()
        id_null = self.ids.is_null().to_numpy(zero_copy_only=False)
        self.tie = np.empty(len(self.uid), int)
        self.tie[np.lexsort((self.uid, self.ids.fill_null(0).to_numpy(zero_copy_only=False), id_null))] = np.arange(len(self.uid))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    if (np.diff(ends) == dim).all():
        return flat[ends[0] : ends[-1]].reshape(len(column), dim).astype(float)
    out = np.zeros((len(column), dim))
    for i in range(len(column)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def whole(column: pa.Array, exact: bool) -> np.ndarray:
    """Arrays of longs of one length as a matrix of doubles, or of Python integers."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].reshape(len(column), -1)
    return flat.astype(float if exact else object)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    s = a @ c.T
    return s if s.dtype != object else np.minimum(np.maximum(s, -LONG - 1), LONG)


class Search:
    """The best k candidates of each slot of each anchor; a slot takes scores from low to high."""

    def __init__(self, k: int, same_label: bool):
        self.k, self.same = k, same_label

    def fits(self, a_label, c_label, a_uid, c_uid) -> np.ndarray:
        if self.same:
            return (a_label[:, None] == c_label[None]) & (a_uid[:, None] != c_uid[None])
        return a_label[:, None] != c_label[None]

    def first_bounds(self, a: Rows, scouts: Rows, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """low, raised to the k-th best score that the scouts have in a slot."""
        low = low.copy()
        if len(scouts.uid) >= self.k:
            for s in range(0, len(a.uid), 256):
                e = min(s + 256, len(a.uid))
                score = products(a.exact[s:e], scouts.exact)
                fit = self.fits(a.label[s:e], scouts.label, a.uid[s:e], scouts.uid)
                for j in range(low.shape[1]):
                    own = np.where(fit & (score >= low[s:e, j, None]) & (score <= high[s:e, j, None]), score, -np.inf)
                    low[s:e, j] = np.maximum(low[s:e, j], best(own, self.k)[0][:, -1])
        return low

    def run(self, a: Rows, low: np.ndarray, high: np.ndarray, c: Rows, c_tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor row, slot, score, candidate row) of the best that this chunk has for the anchors."""
        n, slots = low.shape
        a_tree = Tree(a.vectors, ANCHOR_LEAF)
        order = a_tree.order
        low, high, label, uid, exact = low[order], high[order], a.label[order], a.uid[order], a.exact[order]
        filled = np.where(low <= high, low, np.inf)
        least, most = a_tree.over(filled.min(1), np.minimum).astype(float), a_tree.over(np.where(low <= high, high, -np.inf).max(1), np.maximum).astype(float)
        a_label, c_label = ((t.over(x, np.minimum), t.over(x, np.maximum)) for t, x in ((a_tree, label), (c_tree, c.label)))

        def keep(x, y, lo, hi):
            one = (a_label[0][x] == a_label[1][x]) & (c_label[0][y] == c_label[1][y]) & (a_label[0][x] == c_label[0][y])
            apart = (a_label[1][x] < c_label[0][y]) | (a_label[0][x] > c_label[1][y])
            return (hi >= least[x]) & (lo <= most[x]) & ~(apart if self.same else one)

        x, y, _, hi = surviving(a_tree, c_tree, keep)
        top = np.full((n, slots, self.k), -np.inf, exact.dtype)
        at = np.full((n, slots, self.k), -1)
        for p in np.argsort(-hi, kind="stable"):
            s, e, cs, ce = a_tree.start[x[p]], a_tree.end[x[p]], c_tree.start[y[p]], c_tree.end[y[p]]
            if hi[p] < filled[s:e].min():
                continue
            score = products(exact[s:e], c.exact[cs:ce])
            fit = self.fits(label[s:e], c.label[cs:ce], uid[s:e], c.uid[cs:ce])
            for j in range(slots):
                good = fit & (score >= low[s:e, j, None]) & (score <= high[s:e, j, None])
                rows = np.flatnonzero(good.any(1))
                if not len(rows):
                    continue
                new, column = best(np.where(good[rows], score[rows], -np.inf), min(self.k, ce - cs))
                both, place = np.concatenate([top[s + rows, j], new], 1), np.concatenate([at[s + rows, j], cs + column], 1)
                place[both == -np.inf] = -1
                by_tie = np.argsort(np.where(place < 0, len(c.tie), c.tie[place]), axis=1, kind="stable")
                both, place = np.take_along_axis(both, by_tie, 1), np.take_along_axis(place, by_tie, 1)
                top[s + rows, j], chosen = best(both, self.k)
                at[s + rows, j] = np.take_along_axis(place, chosen, 1)
                low[s + rows, j] = np.maximum(low[s + rows, j], top[s + rows, j, -1])
                filled[s + rows, j] = np.where(low[s + rows, j] <= high[s + rows, j], low[s + rows, j], np.inf)
        r, j, t = np.nonzero(top != -np.inf)
        return order[r], j, top[r, j, t], at[r, j, t]


def _chunk_rows(parts: list[pa.RecordBatch], dim: int, exact: bool) -> tuple[Rows, Tree]:
    """A chunk's rows in its tree's order; within a leaf in the order of ties."""
    c = Rows(parts, dim, exact)
    tree = Tree(c.vectors, LEAF)
    for s, e in zip(tree.start[tree.left < 0], tree.end[tree.left < 0], strict=True):
        own = tree.order[s:e]
        tree.order[s:e] = own[np.argsort(c.tie[own])]
    c.exact, c.vectors, c.label, c.uid, c.tie, c.ids = c.exact[tree.order], None, c.label[tree.order], c.uid[tree.order], c.tie[tree.order], c.ids.take(pa.array(tree.order))
    return c, tree


FOUND = "anchor long, slot int, score long, vec_id long, uid long"


def _searched(candidates: DataFrame, sent: DataFrame, search: Search, dim: int, exact: bool, partitions: int) -> DataFrame:
    """The best of every chunk for the anchors sent to it; merged over the chunks to k a slot."""
    both = candidates.select("chunk", F.lit(0).alias("tag"), "cell", "uid", "vec_id", "label", "vec", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"))
    both = both.union(sent.select("chunk", F.lit(1), "cell", "uid", "vec_id", "label", "vec", "low", "high"))
    dealt = both.repartition(partitions, "chunk").sortWithinPartitions("chunk", "tag", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, built = None, [], None
        for batch in batches:
            chunk, tag = batch.column("chunk").to_numpy(), batch.column("tag").to_numpy()
            edges = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (tag[1:] != tag[:-1]), True]) if len(chunk) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if chunk[s] != now:
                    now, waiting, built = chunk[s], [], None
                if not tag[s]:
                    waiting.append(batch.slice(s, e - s))
                    continue
                if waiting:
                    built, waiting = _chunk_rows(waiting, dim, exact), []
                if built is None:
                    continue
                for at in range(s, e, BLOCK):
                    part = batch.slice(at, min(BLOCK, e - at))
                    a = Rows([part], dim, exact)
                    row, slot, score, place = search.run(a, whole(part.column("low"), exact), whole(part.column("high"), exact), *built)
                    c = built[0]
                    scores = pa.array(score.astype(np.int64) if exact else [int(v) for v in score], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a.uid[row]), pa.array(slot.astype(np.int32)), scores, c.ids.take(pa.array(place)), pa.array(c.uid[place])], names=["anchor", "slot", "score", "vec_id", "uid"])

    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return materialize(dealt.mapInArrow(run, FOUND).withColumn("place", F.row_number().over(order)).where(F.col("place") <= search.k))


def _cells(n: int, sample: list, dim: int, chunk: int) -> Tree:
    points = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        points[i, : len(r["vec"])] = r["vec"]
    wanted = min(CELLS, max(1, -(-n // chunk)))
    return Tree(points, max(1, -(-len(points) // wanted)))


def _filed(rows: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """rows with their cell (a leaf of the tree) and the distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), dim)
            node = np.zeros(len(x), int)
            while True:
                inner = np.flatnonzero(tree.left[node] >= 0)
                if not len(inner):
                    break
                for k in np.unique(node[inner]):
                    own = inner[node[inner] == k]
                    d, value = tree.cut[k]
                    node[own] = np.where(x[own, d] < value, tree.left[k], tree.right[k])
            away = np.sqrt(((x - tree.centre[node]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(run, "uid long, vec_id long, label long, vec array<double>, is_anchor boolean, cell long, away double")


def _chunk(cell: Column, salt: Column) -> Column:
    return cell * F.lit(1 << 32) + salt


def _covering(tree: Tree, radius: dict[int, float]) -> Tree:
    """The cells' tree with balls that cover what was filed under each; a cell without rows covers nothing."""
    out = object.__new__(Tree)
    out.__dict__ |= tree.__dict__
    out.radius = np.full(len(tree.start), -np.inf)
    for k in range(len(tree.start) - 1, -1, -1):
        if tree.left[k] < 0:
            out.radius[k] = radius.get(k, -np.inf)
        else:
            own = [np.sqrt(((tree.centre[k] - tree.centre[x]) ** 2).sum()) + out.radius[x] for x in (tree.left[k], tree.right[k])]
            out.radius[k] = max(own)
    return out


def _bounded(anchors: DataFrame, scouts: list, search: Search, dim: int, exact: bool) -> DataFrame:
    """anchors with low raised by the scouts, materialised."""
    fields = ["uid", "vec_id", "label", "vec"]
    kinds = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.float64()))])
    table = pa.RecordBatch.from_pydict({f: [r[f] for r in scouts] for f in fields}, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rows([table], dim, exact)
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, BLOCK):
                batch = all_rows.slice(at, BLOCK)
                low = search.first_bounds(Rows([batch], dim, exact), known, whole(batch.column("low"), exact), whole(batch.column("high"), exact))
                values = pa.array([int(v) for v in low.reshape(-1)], pa.int64())
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * low.shape[1]), values)
                yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), batch.column("cell"), batch.column("away"), out, batch.column("high")], names=[*fields, "cell", "away", "low", "high"])

    return materialize(anchors.mapInArrow(run, "uid long, vec_id long, label long, vec array<double>, cell long, away double, low array<long>, high array<long>"))


def _sent(anchors: DataFrame, tree: Tree, c_radius: dict[int, float], salts: DataFrame) -> DataFrame:
    """The anchors (with low and high), once for every chunk that their cell's node pairs leave."""
    spark = anchors.sparkSession
    open_low = F.array_min(F.transform(F.arrays_zip("low", "high"), lambda z: F.when(z["low"] <= z["high"], z["low"]).otherwise(F.lit(LONG))))
    cells = anchors.groupBy("cell").agg(F.max("away").alias("radius"), F.min(open_low).alias("low"), F.max(F.array_max("high")).alias("high")).collect()  # a row a cell
    a_tree = _covering(tree, {r["cell"]: r["radius"] for r in cells})
    c_tree = _covering(tree, c_radius)
    least, most = np.full(len(tree.start), np.inf), np.full(len(tree.start), -np.inf)
    for r in cells:
        least[r["cell"]], most[r["cell"]] = r["low"], r["high"]
    for k in range(len(tree.start) - 1, -1, -1):
        if tree.left[k] >= 0:
            least[k], most[k] = least[[tree.left[k], tree.right[k]]].min(), most[[tree.left[k], tree.right[k]]].max()

    def keep(x, y, lo, hi):
        return (a_tree.radius[x] > -np.inf) & (c_tree.radius[y] > -np.inf) & (hi >= least[x]) & (lo <= most[x])

    with np.errstate(invalid="ignore"):
        x, y, _, _ = surviving(a_tree, c_tree, keep)
    pairs = spark.createDataFrame([(int(a), int(c)) for a, c in zip(x, y, strict=True)], "a_cell long, c_cell long")  # CELLS squared at most
    chunks = pairs.join(F.broadcast(salts), F.col("c_cell") == F.col("salt_cell")).select("a_cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: F.struct(F.col("c_cell"), k.alias("salt")))).alias("to"))
    return anchors.join(chunks, F.col("cell") == F.col("a_cell")).withColumn("chunk", _chunk(F.col("to.c_cell"), F.col("to.salt")))


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, vec_id: str = "vec_id", label: str = "label", vector: str = "vector", anchor: str = "is_anchor") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows has an id, a label, a vector of whole numbers and whether the row is an anchor. Negatives of a positive with
    score p are rows of other labels with least * p <= 100 * score <= most * p.
    """
    spark = rows.sparkSession
    vec = F.col(f"`{vector}`").cast("array<double>")
    slim = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), vec.alias("vec"), F.coalesce(F.col(f"`{anchor}`"), F.lit(False)).alias("is_anchor"))
    fine = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    own = materialize(slim.where(fine))
    n, dim, widest = own.agg(F.count("*"), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda v: F.abs(v))))).first()
    dim, exact = dim or 0, (dim or 0) * (widest or 0.0) ** 2 < 2.0**53
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = min(CHUNK, max(LEAST_CHUNK, -(-n // (2 * partitions))))
    sample = own.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).collect()
    tree = _cells(n, sample, dim, chunk)
    filed = materialize(_filed(own, tree, dim)) if n else own.withColumns({"cell": F.lit(0).cast("long"), "away": F.lit(0.0)})
    cells = filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row a cell
    salts = spark.createDataFrame([(r["cell"], -(-r["n"] // chunk)) for r in cells], "salt_cell long, salts long")
    salt = F.pmod(F.xxhash64("uid", F.lit(1)), F.col("salts"))
    candidates = filed.join(F.broadcast(salts), F.col("cell") == F.col("salt_cell")).withColumn("chunk", _chunk(F.col("cell"), salt))
    radius = {r["cell"]: r["radius"] for r in cells}
    tasks = max(partitions, 1)

    near = Search(positives, same_label=True)
    anchors = filed.where("is_anchor").withColumns({"low": F.array(F.lit(-LONG - 1)), "high": F.array(F.lit(LONG))})
    anchors = _bounded(anchors, sample[:SCOUTS], near, dim, exact)
    found = _searched(candidates, _sent(anchors, tree, radius, salts), near, dim, exact, tasks)
    found = found.select("anchor", F.col("place").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    exactly = "decimal(28,0)"
    scaled = lambda share: F.col("positive_score").cast(exactly) * F.lit(share).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    ranges = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", F.ceil(scaled(least)).cast("long").alias("low"), F.floor(scaled(most)).cast("long").alias("high")))).alias("all"))
    padded = lambda f, fill: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.try_element_at(F.col("all"), k)[f], fill))
    ranges = ranges.select("anchor", padded("low", F.lit(1).cast("long")).alias("low"), padded("high", F.lit(0).cast("long")).alias("high"))
    bounded = anchors.drop("low", "high").join(ranges, F.col("uid") == F.col("anchor"))
    hard = Search(negatives, same_label=False)
    bounded = _bounded(bounded.where(F.exists(F.arrays_zip("low", "high"), lambda z: z["low"] <= z["high"])), sample[:SCOUTS], hard, dim, exact)
    mined = _searched(candidates, _sent(bounded, tree, radius, salts), hard, dim, exact, tasks)
    mined = mined.select(F.col("anchor").alias("uid"), (F.col("slot") + 1).alias("_slot"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("uid").alias("_uid"), F.col("vec_id").alias("anchor_id"))
    out = mined.join(found, (F.col("uid") == F.col("anchor")) & (F.col("_slot") == F.col("slot"))).join(ids, F.col("uid") == F.col("_uid"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def contract(embeddings: DataFrame) -> DataFrame:
    """Labels of ids divisible by 7 move on by one, components become floor(256 x), anchors are ids divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = lambda v: v.cast("double") * 256  # noqa: E731  a double of 53 bits and more is whole
    whole = F.transform("embedding", lambda v: F.when(F.abs(x(v)) < 2.0**53, F.floor(x(v)).cast("double")).when(F.abs(x(v)) < F.lit(float("inf")), x(v)))
    return hard_negatives(embeddings.select("vec_id", label.alias("label"), whole.alias("vector"), (F.col("vec_id") % 50 == 0).alias("is_anchor")))


#: The same in DuckDB, all anchors against all rows.
SQL = """
WITH own AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
scored AS (
  SELECT a.uid, a.vec_id AS anchor_id, a.label AS anchor_label, c.uid AS c_uid, c.vec_id, c.label, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM own a JOIN own c ON a.vec_id % 50 = 0 AND a.uid <> c.uid),
positives AS (
  SELECT uid, anchor_id, vec_id AS positive_id, c_uid AS p_uid, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST, c_uid) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.uid, p.p_uid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.c_uid) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.uid = s.uid AND s.label <> s.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
