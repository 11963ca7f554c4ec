"""Community detection by modularity: ordered folds of small pieces of a graph, sweeps over blocks of the nodes of a large piece."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .graph_blocks import Blocks
from .pairs import sizes_and_nodes, unpacked

#: A move has to gain more modularity than this, and in a large graph, where that is much, more than this share of the node's own.
GAIN, SHARE = 1e-9, 1e-4
#: Up to so many edges (both ways) one task holds at a time, as arrays: some 200 MB.
FOLD_EDGES = 2_000_000
#: Up to so many nodes (counted) their labels, some bytes a node, are broadcast; those of more are joined.
FEW_NODES = 2_000_000
#: From so many edges on, a node's are summed as arrays.
MANY_ENDS = 40
#: Up to so many nodes, those nearest to a gain move with the ones that gain.
NEAR_NODES = 4_000


def _csr(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Edges by x and y, equal ones summed, loops left out: where each x begins, the other ends, the weights."""
    order = np.lexsort((y, x))
    x, y, weight = x[order], y[order], weight[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, int)
    x, y, weight = x[new], y[new], np.add.reduceat(weight, new) if len(new) else weight
    other = x != y
    return np.searchsorted(x[other], np.arange(n + 1)).tolist(), y[other], weight[other]


def _moved(near: tuple, degree: np.ndarray, label: np.ndarray, sigma: np.ndarray, m2: float, resolution: float, fixed: tuple | None = None, place: list[int] | None = None, order: list[int] | None = None, once: bool = False) -> np.ndarray:
    """Labels of nodes 0..n-1 after local moving in a fixed shuffled order, sweep after sweep until no node gains (once: one sweep).

    near is _csr of the edges, label where the nodes begin, sigma the degrees of the
    communities; fixed is _csr from nodes to communities, by edges to nodes that stay.
    place has the nodes' places in label, which is changed.
    """
    begins, ends, weights = near
    if order is None:
        order = list(range(len(degree)))
        random.Random(42).shuffle(order)
    degree, summed, going = degree.tolist(), np.zeros(len(sigma)), True
    while going:
        going = False
        for v in order:
            i, j = begins[v], begins[v + 1]
            found, w = label[ends[i:j]], weights[i:j]
            if fixed:
                i, j = fixed[0][v], fixed[0][v + 1]
                found, w = np.concatenate([found, fixed[1][i:j]]), np.concatenate([w, fixed[2][i:j]])
            if not len(found):
                continue
            at = place[v] if place else v
            own, k = int(label[at]), degree[v]
            sigma[own] -= k
            pull, gain = resolution * k / (m2 * m2), min(GAIN, SHARE * k / m2)
            if len(found) >= MANY_ENDS:
                np.add.at(summed, found, w)
                values = summed[found] / m2 - pull * sigma[found]
                value = values.max()
                best = own if value <= summed[own] / m2 - pull * sigma[own] + gain else int(found[values == value].min())
                summed[found] = 0.0
            else:
                inside: dict[int, float] = {}
                names = found.tolist()
                for c, x in zip(names, w.tolist(), strict=True):
                    inside[c] = inside.get(c, 0.0) + x
                held = dict(zip(names, sigma[found].tolist(), strict=True))
                best, most = own, inside.get(own, 0.0) / m2 - pull * float(sigma[own]) + gain
                for c in sorted(inside):
                    value = inside[c] / m2 - pull * held[c]
                    if value > most:
                        best, most = c, value
            sigma[best] += k
            if best != own:
                label[at], going = best, not once
    return label


def _folded(a: np.ndarray, b: np.ndarray, weight: np.ndarray, m2: float, resolution: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of edges as arrays, all levels; labels are the smallest nodes."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    place = np.arange(len(names))  # of each node, in the level at hand
    for _ in range(levels if m2 else 0):
        n = int(place.max()) + 1
        degree = np.bincount(x, weight, n)
        label = _moved(_csr(x, y, weight, n), degree, np.arange(n), degree.copy(), m2, resolution)
        if (label == np.arange(n)).all():
            break
        _, first, number = np.unique(label, return_index=True, return_inverse=True)
        label = np.argsort(np.argsort(first))[number]  # numbered in the order of their first node
        place, x, y = label[place], label[x], label[y]
    least = np.full(int(place.max()) + 1, names.max())
    np.minimum.at(least, place, names)
    return names, least[place]


def _fold(edges: DataFrame, m2: float, resolution: float, levels: int, key: str | None = None) -> DataFrame:
    """(node, label): all levels of each piece (key; one without it) in one task, a piece having no edges to others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, label = _folded(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["weight"].to_numpy(), m2, resolution, levels)
        return pd.DataFrame({"node": node, "label": label})

    rows = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double"), (F.col(key) if key else F.lit(0)).alias("key"))
    return materialize(rows.groupBy("key").applyInPandas(run, "node long, label long"))


def _swept(own, begins, ends, weights, k, loops, label, sigma, active, m2, resolution, part, sweep):
    """A block's nodes (a share of them, by chance) move once, one after the other; others stay. The nodes that moved, where to, and the weight inside the communities before."""
    inside = weights[label[ends] == np.repeat(label[own], np.diff(begins))].sum()
    chance = np.random.default_rng((sweep, int(own[0])))
    order = chance.permutation(len(own))
    order = order[active[own[order]] & (chance.random(len(own)) < part)].tolist()
    to = _moved((begins.tolist(), ends, weights), k, label.copy(), sigma.copy(), m2, resolution, None, own.tolist(), order, True)[own]
    moved = to != label[own]
    return own[moved], to[moved], np.array([inside])


def _gains(own, begins, ends, weights, k, loops, label, sigma, m2, resolution):
    """What each node of a block would gain by its best move, in shares of its weight; below zero: lose. And the weight inside."""
    n, m = len(label), np.diff(begins)
    key = np.repeat(np.arange(len(own)), m) * n + label[ends]
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    inside = np.add.reduceat(weights[order], new) if len(new) else weights
    x, c = key[new] // n, key[new] % n
    mine, pull = label[own], resolution * k / m2
    here = c == mine[x]
    value = inside - pull[x] * (sigma[c] - np.where(here, k[x], 0.0))
    stay = -pull * (sigma[mine] - k)
    stay[x[here]] = value[here]
    best = np.full(len(own), -np.inf)
    np.maximum.at(best, x[~here], value[~here])
    return own, (best - stay - np.minimum(GAIN * m2, SHARE * k)) / np.where(k > 0, k, 1.0), np.array([inside[here].sum()])


def _chosen(own, begins, ends, weights, k, loops, label, sigma, mask, m2, resolution):
    """The edges of the nodes in mask."""
    on, m = mask[own], np.diff(begins)
    each = np.repeat(on, m)
    return own[on], m[on], ends[each], weights[each], k[on]


def _resolved(parts, label, sigma, mask, m2, resolution):
    """The nodes of _chosen move in one task until none of them gains; all others stay."""
    own, m, ends, weights, k = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(own).tolist()
    random.Random(42).shuffle(order)
    to = _moved((np.r_[0, np.cumsum(m)].tolist(), ends, weights), k, label.copy(), sigma.copy(), m2, resolution, None, own.tolist(), order)[own]
    moved = to != label[own]
    return own[moved], to[moved]


def _settled(graph: Blocks, active: np.ndarray, m2: float, resolution: float) -> np.ndarray:
    """Labels of a graph's nodes, of which the active ones move until none gains.

    First all blocks sweep at once, each over its own nodes, by the labels of the sweep
    before. Modularity is summed each time: where it fell the sweep is undone, and where it hardly
    rose fewer nodes move at a time. When those that still move have few edges, the nodes
    that gain, and some nearest to it, up to FOLD_EDGES edges, move in one task among all that
    stay. That raises modularity by each move, and it ends where no node of the graph gains.
    """
    n = len(graph.names)
    label = kept = np.arange(n, dtype=np.int32)
    degrees = lambda x: np.bincount(x, graph.k, n)
    value = lambda inside, sigma: inside / m2 - resolution * float(np.sum((sigma / m2) ** 2))
    part, was, sweep, going = 1.0, -math.inf, 0, math.inf
    while part > 0.01:
        sweep += 1
        sigma = degrees(label)
        found = graph.each(_swept, ("i4", "i4", "f8"), label, sigma, active, m2, resolution, part, sweep)
        now = value(sum(float(x[2][0]) for x in found), sigma)
        if now <= was:
            label, part = kept, part / 2
            continue
        moved = np.concatenate([x[0] for x in found])
        rose, kept, was, label = now - was > 0.01 * abs(now), label, now, label.copy()
        label[moved] = np.concatenate([x[1] for x in found])
        before, going = going, len(moved) / part
        if going <= NEAR_NODES and graph.count[moved].sum() * 2 <= part * FOLD_EDGES:
            break
        if not rose and going > 0.9 * before:
            part /= 2
    while True:
        sigma = degrees(label)
        found = graph.each(_gains, ("i4", "f8", "f8"), label, sigma, m2, resolution)
        if value(sum(float(x[2][0]) for x in found), sigma) < was:
            label, was = kept, -math.inf  # the last sweep of the blocks
            continue
        was = -math.inf
        gain = np.full(n, -np.inf)
        for own, x, _ in found:
            gain[own] = x
        gain[~active] = -np.inf
        gaining = int((gain > 0).sum())
        if not gaining:
            return label
        first = np.argsort(-gain, kind="stable")[: min(max(gaining, NEAR_NODES), int(np.isfinite(gain).sum()))]
        mask = np.zeros(n, bool)
        mask[first[: max(1, np.searchsorted(np.cumsum(graph.count[first]), FOLD_EDGES, "right"))]] = True
        (moved, to), = graph.each(_chosen, ("i4", "i8", "i4", "f8", "f8"), label, sigma, mask, m2, resolution, then=_resolved)
        if not len(moved):
            return label  # what is left is rounding
        label = label.copy()
        label[moved] = to


def local_moving(edges: DataFrame, resolution: float = 1.0, m2: float | None = None) -> DataFrame:
    """(node, label): nodes move to the neighbouring community with the best gain in modularity, until none gains. Ties go to the smallest label.

    Up to FEW_NODES nodes (counted) their labels are broadcast to blocks of edges; beyond, edges
    and labels are joined.
    """
    n, nodes = sizes_and_nodes(edges)
    nodes = materialize(nodes)
    if nodes.count() > FEW_NODES:
        return _moving_by_joins(edges, resolution, m2)
    graph = Blocks(edges, n, nodes, FOLD_EDGES // 2)
    m2, all_nodes = m2 or float(graph.k.sum()), np.ones(len(graph.names), bool)
    return graph.labels(_settled(graph, all_nodes, m2, resolution) if m2 else np.arange(len(graph.names)), all_nodes)


def _moving_by_joins(edges: DataFrame, resolution: float = 1.0, m2: float | None = None) -> DataFrame:
    """local_moving of nodes too many to broadcast their labels.

    Modularity is a sum over communities. So each round deals the communities into groups
    by hash, anew each time, and a task moves the nodes of one group among the group's
    communities, node by node: groups share no community, and their gains add up exactly.
    Where a group has more than FOLD_EDGES edges, a part of its nodes, by hash, moves and the
    others stay, summed by community. When few nodes have moved, all nodes look for their best
    move, and those move whose gain is the greatest of all that leave or enter their two
    communities. Every move raises the modularity, so the loop ends, and it ends only where
    no node gains. Ties go to the smallest label.
    """
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("double")))
    n = edges.count()
    m2 = m2 or edges.agg(F.sum("weight")).first()[0]
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")).select("node", F.col("node").alias("label"), "k"))
    if not m2:
        return labels.select("node", "label")
    nodes = labels.count()
    between = edges.where("a <> b")
    groups, sweep = math.ceil(math.sqrt(n / FOLD_EDGES)), 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {kind: rows for kind, rows in pdf.groupby("kind")}
        none = pdf.iloc[:0]
        own, com = part.get(0, none), part[1]
        names, spots = np.sort(own["x"].to_numpy()), np.sort(com["x"].to_numpy())
        own, com = own.sort_values("x"), com.sort_values("x")
        e, f = part.get(2, none), part.get(3, none)
        near = _csr(np.searchsorted(names, e["x"].to_numpy()), np.searchsorted(names, e["y"].to_numpy()), e["w"].to_numpy(), len(names))
        x, y = np.searchsorted(names, f["x"].to_numpy()), np.searchsorted(spots, f["y"].to_numpy())
        at = np.argsort(x, kind="stable")
        fixed = np.searchsorted(x[at], np.arange(len(names) + 1)).tolist(), y[at], f["w"].to_numpy()[at]
        label = np.searchsorted(spots, own["y"].to_numpy())
        to = _moved(near, own["w"].to_numpy(), label.copy(), com["w"].to_numpy(float, copy=True), m2, resolution, fixed if len(f) else None)
        return pd.DataFrame({"node": names[to != label], "to": spots[to[to != label]]})

    def best_moves() -> DataFrame:
        sigma = labels.groupBy("label").agg(F.sum("k").alias("sigma"))
        near = between.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("inside"))
        own = labels.join(sigma, "label").select("node", F.col("label").alias("old"), "k", (-resolution * F.col("k") * (F.col("sigma") - F.col("k")) / (m2 * m2)).alias("alone"))
        here = F.col("label") == F.col("old")
        value = F.col("inside") / m2 - resolution * F.col("k") * (F.col("sigma") - F.when(here, F.col("k")).otherwise(0)) / (m2 * m2)
        offers = near.join(sigma, "label").join(own, "node").select("node", "old", "k", "alone", F.when(here, value).alias("stay"), F.when(~here, F.struct(value.alias("value"), (-F.col("label")).alias("least"))).alias("go"))
        best = offers.groupBy("node", "old", "k").agg(F.max("go").alias("go"), F.coalesce(F.max("stay"), F.max("alone")).alias("stay")).where(F.col("go.value") > F.col("stay") + F.least(F.lit(GAIN), SHARE * F.col("k") / m2))
        return materialize(best.select("node", "old", (-F.col("go.least")).alias("to"), (F.col("go.value") - F.col("stay")).alias("gain")))

    while True:
        sweep += 1
        dealt = labels.withColumn("g", F.pmod(F.xxhash64("label", F.lit(sweep)), F.lit(groups)).cast("int"))
        ends = [dealt.select(F.col("node").alias(x), F.col("label").alias("l" + x), F.col("g").alias("g" + x)) for x in "ab"]
        near = materialize(between.join(ends[0], "a").join(ends[1], "b").where("ga = gb").select(F.col("ga").alias("g"), "a", "b", "lb", "weight"))
        share = [1] * groups
        for g, m in near.groupBy("g").agg(F.count("*")).collect():  # one row a group
            share[g] = math.ceil(m / FOLD_EDGES)
        moves = lambda x: F.pmod(F.xxhash64(x, F.lit(sweep)), F.get(F.array(*map(F.lit, share)), F.col("g"))) == 0  # noqa: B023, E731
        near = near.where(moves("a"))
        other = moves("b")
        row = lambda kind, x, y, w: ["g", F.lit(kind).alias("kind"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(w).alias("w")]
        rows = dealt.where(moves("node")).select(*row(0, "node", "label", "k")).union(dealt.groupBy("g", "label").agg(F.sum("k").alias("k")).select(*row(1, "label", "label", "k"))).union(near.where(other).select(*row(2, "a", "b", "weight")))
        if max(share) > 1:
            rows = rows.union(near.where(~other).groupBy("g", "a", "lb").agg(F.sum("weight").alias("weight")).select(*row(3, "a", "lb", "weight")))
        moved = materialize(rows.groupBy("g").applyInPandas(run, "node long, to long"))
        changed = moved.count()
        if changed:
            labels = materialize(labels.join(moved, "node", "left").select("node", F.coalesce("to", "label").alias("label"), "k"))
        if groups == 1 and max(share) == 1 or changed == 0 or changed * 1000 < nodes:
            best = best_moves()
            if best.isEmpty():
                return labels.select("node", "label")
            claims = best.select("node", "gain", F.explode(F.array("old", "to")).alias("community"))
            first = claims.groupBy("community").agg(F.max(F.struct("gain", "node"))["node"].alias("node"))
            winners = first.groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node")
            labels = materialize(labels.join(best.join(winners, "node").select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label"), "k"))


def pieces(edges: DataFrame) -> DataFrame:
    """(node, root): the connected components of edges (a, b both ways). The edges to each node's smallest neighbour join most nodes, then the few edges between what they joined."""
    from .graph import components

    roots = components(edges.groupBy("a").agg(F.min("b").alias("b")))
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab"]
    across = materialize(edges.where("a < b").join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select("ra", "rb").distinct())
    if across.isEmpty():
        return roots
    higher = components(across, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(roots.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _levels_by_joins(edges: DataFrame, resolution: float, levels: int, m2: float | None = None, split: bool = True) -> DataFrame:
    edges = materialize(edges)
    m2 = m2 or edges.agg(F.sum("weight")).first()[0] or 0.0
    n = edges.count()
    done = None
    if split:  # no community spans two components: those that one task holds are folded apart
        placed = materialize(edges.join(pieces(edges).select(F.col("node").alias("a"), "root"), "a"))
        sizes = materialize(placed.groupBy("root").agg(F.count("*").alias("size")))
        sized = placed.join(sizes, "root")
        bins = max(1, math.ceil(2 * n / FOLD_EDGES))
        key = F.when(F.col("size") * 10 > FOLD_EDGES, F.concat(F.lit("p"), F.col("root").cast("string"))).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64("root"), F.lit(bins)).cast("string")))
        done = _fold(sized.where(F.col("size") <= FOLD_EDGES).withColumn("key", key), m2, resolution, levels, "key")
        edges = materialize(sized.where(F.col("size") > FOLD_EDGES).select("a", "b", "weight"))
        if edges.isEmpty():
            return done
    labels = _moving_by_joins(edges, resolution, m2)
    if levels > 1 and not labels.where("node <> label").isEmpty():
        up = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        folded = edges.join(up[0], "a").join(up[1], "b").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("weight").alias("weight"))
        higher = _levels(folded, resolution, levels - 1, m2, False).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = materialize(labels.join(higher, "label").select("node", F.col("to").alias("label")))
    return labels if done is None else done.union(labels)


def _levels(edges: DataFrame, resolution: float, levels: int, m2: float | None = None, split: bool = True) -> DataFrame:
    n, nodes = sizes_and_nodes(edges)
    if n <= FOLD_EDGES:
        edges = unpacked(edges)
        return _fold(edges, m2 or edges.agg(F.sum("weight")).first()[0] or 0.0, resolution, levels)
    nodes = materialize(nodes)
    if nodes.count() > FEW_NODES:
        return _levels_by_joins(unpacked(edges), resolution, levels, m2, split)
    graph = Blocks(edges, n, nodes, FOLD_EDGES // 2)
    m2 = m2 or float(graph.k.sum())
    done, active = None, np.ones(len(graph.names), bool)
    if split:  # no community spans two components: those that one task holds are folded apart
        roots = graph.components()
        sizes = np.bincount(roots, graph.count, len(roots))[roots]
        active = sizes > FOLD_EDGES
        if not active.all():
            bins = max(1, math.ceil(2 * graph.count[~active].sum() / FOLD_EDGES))
            key = np.where(sizes * 10 > FOLD_EDGES, roots, -1 - roots.astype(np.int64) * 7919 % bins)
            done = _fold(graph.parts(key, ~active), m2, resolution, levels, "key")
        if not active.any():
            return done
    label = _settled(graph, active, m2, resolution) if m2 else np.arange(len(graph.names))
    labels = graph.labels(label, active)
    if levels > 1 and (label != np.arange(len(label))).any():
        higher = _levels(graph.folded(label, active), resolution, levels - 1, m2, False).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = materialize(labels.join(higher, "label").select("node", F.col("to").alias("label")))
    return labels if done is None else done.union(labels)


def louvain(edges: DataFrame, resolution: float = 1.0, levels: int = 1_000, least: int = 2) -> DataFrame:
    """(node, community): local moving, then again between the communities found, until a level adds nothing.

    edges are (a, b, weight), both ways, nodes longs, as rows or packed. A graph or connected component of at
    most FOLD_EDGES edges (counted) is folded in one task, node by node; in a larger one blocks of
    nodes move, and the graph of its communities is folded as soon as it is small. edges are
    read some times, so what is costly to make should be kept before. Communities of
    fewer than least nodes are left out; the rest are numbered ``c_0_i`` by size, ties by
    their smallest node. levels=1 is a single level.
    """
    labels = _levels(edges, resolution, levels)
    sizes = materialize(labels.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first")).where(F.col("size") >= least))
    return labels.join(numbered(sizes), "label").select("node", "community")


def numbered(sizes: DataFrame) -> DataFrame:
    """(label, community): ``c_0_i`` in the order of size and first node, without a sort in one task."""
    from .rank import ranked

    return ranked(sizes, "size", "first").select("label", F.concat(F.lit("c_0_"), (F.col("rank") - 1).cast("string")).alias("community"))
