"""Communities against a sequential search, ranks with ties, claims, marginal relevance, archives and retried batches."""

import random
import zipfile

import numpy as np

from brindle.operators import claims, communities, dedup, graph, multivector, rank
from brindle.sources import web
from brindle.streaming import events


def modularity(edges, label):
    m2 = 2 * sum(edges.values())
    degree, inside = {}, 0.0
    for (a, b), w in edges.items():
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
        inside += 2 * w * (label[a] == label[b])
    total = {}
    for v, k in degree.items():
        total[label[v]] = total.get(label[v], 0) + k
    return inside / m2 - sum((t / m2) ** 2 for t in total.values())


def sequential(edges, rng):
    """Plain local moving in a shuffled order, best gain first, until nothing moves."""
    near, m2 = {}, 2 * sum(edges.values())
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    label = {v: v for v in near}
    degree = {v: sum(x.values()) for v, x in near.items()}
    for _ in range(50):
        order, moved = list(near), False
        rng.shuffle(order)
        for v in order:
            def gain(c):
                inside = sum(w for u, w in near[v].items() if label[u] == c)
                return inside / m2 - degree[v] * sum(degree[u] for u in near if label[u] == c and u != v) / m2**2
            here = gain(label[v])
            best = max(({label[u] for u in near[v]} - {label[v]}), key=lambda c: (gain(c), -c), default=None)
            if best is not None and gain(best) > here + 1e-12:
                label[v], moved = best, True
        if not moved:
            break
    return label


def test_communities_are_as_good_as_a_sequential_search(spark):
    rng = random.Random(3)
    edges = {}
    for a in range(27):
        for b in range(a):
            if rng.random() < (0.7 if a // 9 == b // 9 else 0.03):
                edges[b, a] = rng.choice([1.0, 2.0])
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    both = graph.undirected(df)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # tiny joins, many of them
    try:
        found = communities.louvain(both, least=1).cache()
        found.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    label = {r.node: r.community for r in found.collect()}
    own = modularity(edges, label)
    assert own >= modularity(edges, sequential(edges, rng)) - 1e-3
    assert abs(graph.modularity(both, found).first()[0] - own) < 1e-9
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert [sizes[f"c_0_{i}"] for i in range(len(sizes))] == sorted(sizes.values(), reverse=True)


def test_ranks_with_many_ties(spark):
    rng = random.Random(1)
    rows = [(i, 1.0 if rng.random() < 0.7 else rng.random()) for i in range(3000)]
    got = {r.k: r["rank"] for r in rank.ranked(spark.createDataFrame(rows, "k long, s double"), "s", "k", 6).collect()}
    assert got == {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    assert rank.ranked(spark.createDataFrame([], "k long, s double"), "s", "k").count() == 0


def test_hamming_pairs_at_every_radius(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 14))) for b in base for _ in range(6)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "k long, v long")
    for radius in (0, 3, 5, 12):
        got = {(r.a, r.b): r.distance for r in dedup.hamming_pairs(df, "k", "v", radius).collect()}
        first = {v: values.index(v) for v in values}
        keys = sorted(first.values())
        want = {(a, b): bin(values[a] ^ values[b]).count("1") for a in keys for b in keys if a < b and bin(values[a] ^ values[b]).count("1") <= radius}
        assert got == want


def test_claim_clusters_follow_leaders(spark):
    rows = [(1, "the water of the river is cold", "a", 1, [1]), (2, "the water of the river is very cold", "a", 3, [2]), (3, "an unrelated claim on prices", "b", 1, [3]), (4, "The water of the river is cold!", "b", 3, [1, 4]), (5, "", "b", 1, [9])]
    df = spark.createDataFrame(rows, "claim_id long, text string, topic string, weight long, evidence array<long>")
    got = {r.leader: (r.claim_id, r.members, list(r.evidence)) for r in claims.deduplicated(df).collect()}
    assert got == {1: (4, 3, [1, 2, 4]), 3: (3, 1, [3]), 5: (5, 1, [9])}


def test_marginal_relevance_matches_a_greedy_search(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(k), [float(x) for x in rng.normal(size=6)], float(rng.choice([1.0, 1.2]))) for g in range(3) for k in range(20 * g, 20 * g + 8 + 5 * g)]
    df = spark.createDataFrame(rows, "g long, k long, v array<double>, w double")
    got = {(r.g, r["rank"]): r.k for r in multivector.mmr_top(df, "g", "k", "v", "w", ratio=0.4, least=2, most=6).collect()}
    want = {}
    for g in range(3):
        own = [(k, np.array(v) / np.linalg.norm(v), w) for h, k, v, w in rows if h == g]
        c = np.mean([v for _, v, _ in own], axis=0)
        c /= np.linalg.norm(c)
        chosen = []
        for place in range(1, min(6, max(2, int(len(own) * 0.4))) + 1):
            def gain(x):
                return 0.7 * (x[1] @ c) * x[2] - 0.3 * max([0.0, *(x[1] @ y[1] for y in chosen)])
            best = max((x for x in own if all(x[0] != y[0] for y in chosen)), key=lambda x: (gain(x), -x[0]))
            chosen.append(best)
            want[g, place] = best[0]
    assert got == want


def test_every_archive_has_a_status(spark, tmp_path):
    def zipped(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, t in entries:
                z.writestr(n, t)

    zipped("good.zip", [("a.md", "md"), ("b.txt", "text")])
    zipped("large.zip", [("a.txt", "x" * 50)])
    zipped("none.zip", [("a.bin", "x")])
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    got = sorted((r.path.rsplit("/", 1)[1], r.entry, r.text, r.status) for r in web.archive_entries(spark, str(tmp_path), 40).collect())
    assert got == [("broken.zip", None, None, "broken"), ("good.zip", "b.txt", "text", "ok"), ("large.zip", "a.txt", None, "too large"), ("none.zip", None, None, "no text")]


def test_a_retried_batch_is_written_once(spark, tmp_path, monkeypatch):
    """The same batch put twice leaves its rows once."""
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    held = {}

    class Writer:
        def __getattr__(self, name):
            return lambda *a, **k: held.__setitem__(name, a) or self

    class Stream:
        writeStream = Writer()

    events.drain(Stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    put = held["foreachBatch"][0]
    batch = spark.range(5)
    put(batch, 7), put(batch, 7), put(batch, 8)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    assert stream.isStreaming


def test_map_reduce_ends_with_one_summary_a_group(spark):
    from brindle.operators import summaries

    rng = random.Random(5)
    rows = [(g, t, " ".join(rng.choice("abc") * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) + ". Rest.") for g in range(4) for t in range(12 * g + 1)] + [(9, 0, None), (9, 1, "")]
    got = {r.g: r.summary for r in summaries.map_reduce(spark.createDataFrame(rows, "g long, t long, x string"), "g", "t", "x", 60).collect()}
    assert set(got) == {0, 1, 2, 3, 9} and all(len(s) <= 200 for s in got.values())
    assert got[0] == summaries_of(rows[0][2]) and got[9] == " "


def summaries_of(text, most=200):
    first = text.split(". ")[0] + "."
    return first if len(first) <= most else first[:most].rsplit(" ", 1)[0]
