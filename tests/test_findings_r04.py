"""Tests of the findings of the fourth round, by their numbers."""

import random

import pytest
from pyspark.sql import functions as F


def _clusters(spark, nodes, size, ends, seed=8, share=0.8):
    """A connected graph of groups of so many nodes, both ways."""
    from brindle.operators import graph as gr

    rng, edges = random.Random(seed), {}
    for a in range(1, nodes):
        edges[rng.randrange(max(0, a - size), a), a] = 1.0
        for _ in range(ends):
            b = rng.randrange(a // size * size, min(nodes, a // size * size + size)) if rng.random() < share else rng.randrange(nodes)
            if a != b:
                edges[min(a, b), max(a, b)] = rng.choice([1.0, 2.0])
    return gr.undirected(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")).cache()


def _settled(both, label, slack=1e-8):
    """Whether no node gains modularity by a move to a neighbour's community."""
    near, m2, sigma = {}, both.agg({"weight": "sum"}).first()[0], {}
    for a, b, w in both.collect():
        near.setdefault(a, {})[b] = w
    for v, x in near.items():
        sigma[label[v]] = sigma.get(label[v], 0) + sum(x.values())
    for v, x in near.items():
        inside, k = {}, sum(x.values())
        for u, w in x.items():
            inside[label[u]] = inside.get(label[u], 0) + w
        gain = {c: inside.get(c, 0) / m2 - k * (sigma[c] - (k if c == label[v] else 0)) / m2**2 for c in {*inside, label[v]}}
        if max(gain.values()) > gain[label[v]] + slack:
            return False
    return True


def test_f1_a_connected_graph_larger_than_a_task_settles_in_few_jobs(spark, monkeypatch):
    """Blocks of a large component move at once; the result is a local optimum as good as the one of a single task."""
    from brindle.operators import communities as cm
    from brindle.operators import graph as gr

    both = _clusters(spark, 2000, 50, 4)
    whole = gr.modularity(both, cm.louvain(both, least=1)).first()[0]
    monkeypatch.setattr(cm, "FOLD_EDGES", both.count() // 4)
    spark.sparkContext.setJobGroup("f1", "local moving")
    label = {r.node: r.label for r in cm.local_moving(both).collect()}
    spark.sparkContext.setJobGroup("rest", "rest")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("f1"))
    assert jobs < 60, jobs  # a round of joins alone takes ten
    assert len(label) == 2000 and _settled(both, label)
    found = cm.louvain(both, least=1).cache()
    assert found.count() == 2000 and gr.modularity(both, found).first()[0] > whole - 0.02


@pytest.mark.parametrize("few", [0, 1000])
def test_f1_labels_that_cannot_be_broadcast(spark, monkeypatch, few):
    """More nodes than are broadcast: edges and labels are joined, to the same end."""
    from brindle.operators import communities as cm

    both = _clusters(spark, 24, 8, 3)
    monkeypatch.setattr(cm, "FOLD_EDGES", both.count() // 2)
    monkeypatch.setattr(cm, "FEW_NODES", few)
    label = {r.node: r.label for r in cm.local_moving(both).collect()}
    assert len(label) == 24 and _settled(both, label)


def test_f1_blocks_hold_the_whole_graph(spark):
    """Degrees, loops, components, parts and the graph of communities, by blocks of two edges or so."""
    import numpy as np

    from brindle.operators.graph_blocks import Blocks

    pairs = [(1, 2, 1.0), (2, 3, 2.0), (7, 8, 1.5), (-5, 7, 4.0)]
    rows = pairs + [(b, a, w) for a, b, w in pairs] + [(3, 3, 5.0), (9, 9, 2.0)]
    edges = spark.createDataFrame(rows, "a long, b long, weight double")
    graph = Blocks(edges, len(rows), edges.select("a").distinct(), 2)
    every = np.ones(7, bool)
    assert graph.names.tolist() == [-5, 1, 2, 3, 7, 8, 9]
    assert graph.k.tolist() == [4.0, 1.0, 3.0, 7.0, 5.5, 1.5, 2.0] and graph.count.tolist() == [1, 1, 2, 1, 2, 1, 0]
    assert graph.components().tolist() == [0, 1, 1, 1, 0, 0, 6]
    assert sorted(map(tuple, graph.parts(np.zeros(7, int), every).select("a", "b", "weight").collect())) == sorted(rows)
    label = np.array([0, 1, 1, 1, 0, 5, 6])
    assert {(r.a, r.b): r.weight for r in graph.folded(label, every).collect()} == {(-5, -5): 8.0, (1, 1): 11.0, (-5, 8): 1.5, (8, -5): 1.5, (8, 8): 0.0, (9, 9): 2.0}
    assert sorted(map(tuple, graph.labels(label, label > 0).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 9)]


def test_f2_f3_pairs_are_counted_as_arrays(spark, monkeypatch):
    """Pairs of lists of any length, in any number of buckets, as a plain count; copies count, no pair is a row of a shuffle."""
    from collections import Counter
    from itertools import combinations

    from brindle.operators import pairs

    rng = random.Random(2)
    lists = {tuple(sorted(rng.sample(range(60), rng.choice([0, 1, 2, 3, 7, 40])))): rng.randrange(1, 4) for _ in range(300)}
    want = Counter()
    for own, copies in lists.items():
        for pair in combinations(own, 2):
            want[pair] += copies
    df = spark.createDataFrame([(list(own), n) for own, n in lists.items()], "own array<int>, copies long").repartition(3)
    for size in (50, 1_000_000):
        monkeypatch.setattr(pairs, "BUCKET_PAIRS", size)
        packed = pairs.common_pairs(df, 5)
        assert {(r.a, r.b): r.weight for r in pairs.unpacked(packed).collect()} == {p: n for p, n in want.items() if n >= 5}
        n, nodes = pairs.sizes_and_nodes(pairs.both_ways(packed))
        assert n == 2 * sum(n >= 5 for n in want.values()) and {r.a for r in nodes.collect()} == {x for p, n in want.items() if n >= 5 for x in p}
    assert pairs.unpacked(pairs.common_pairs(df.where("size(own) < 2"), 1)).count() == 0


def test_f2_f3_no_pair_of_entities_is_exploded(spark):
    """The graph of a corpus: no plan makes a row of each pair, and chunks of one id count once."""
    from brindle.operators import graph_rag

    rows = [(i // 2, f"zeppelin harbour pilots{i % 5} lights") for i in range(12)] + [(i, "filler words of no interest") for i in range(100, 700)]
    chunks, mentions, relations, communities = graph_rag.graph_index(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = relations._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan
    assert {(r.source, r.target): r.weight for r in relations.collect()}["harbour", "zeppelin"] == 6
    assert {r.entity for r in communities.collect()} >= {"harbour", "zeppelin", "lights"}
    assert communities.where("entity = 'zeppelin'").first().summary.startswith("harbour, lights, zeppelin")
