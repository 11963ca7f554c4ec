"""Tests of the findings of the third round, by their numbers."""

import numpy as np
import pytest

from brindle.operators import ocr


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f1_dictionary_keys_are_not_broadcast(spark):
    """Nothing of the lookup is built in the driver."""
    words = spark.createDataFrame([("helo",), ("a-very-long-word-indee",)], "word string")
    known = spark.createDataFrame([("hello", "hello"), ("a-very-long-word-indeed", "a-very-long-word-indeed")], "word string, place string")
    found = ocr.closest(words, known)
    assert "Broadcast" not in _plan(found) and "SortMergeJoin" in _plan(found)
    assert sorted(map(tuple, found.collect())) == [("a-very-long-word-indee", "a-very-long-word-indeed", 1), ("helo", "hello", 1)]
    texts = spark.createDataFrame([(1, "helo you"), (2, None)], "k long, t string")
    fixed = ocr.by_dictionary(texts, "k", "t", known)
    assert "Broadcast" not in _plan(fixed)
    assert sorted(map(tuple, fixed.collect())) == [(1, "hello you", 1), (2, None, 0)]


def test_f2_nearest_by_blocks(spark, monkeypatch):
    """Blocks of any size give the nearest of the whole table: copies, ties, nulls and other sizes included; no pair of rows is a row."""
    from functools import partial

    from pyspark.sql import functions as F

    from brindle.functions import vector as vx
    from brindle.operators import blocks, rank

    rng = np.random.default_rng(5)
    v = [[float(x) for x in rng.integers(-3, 4, 6)] for _ in range(60)]
    v[7:20] = [v[7]] * 13
    v[30], v[31], v[32], v[33] = None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6
    v[40] = [1.0, 2.0]
    df = spark.createDataFrame(list(enumerate(v)), "k long, v array<float>")
    q = df.where("k % 2 = 1").select(F.col("k").alias("q"), F.col("v").alias("w"))
    pairs = df.join(q, F.col("k") != F.col("q")).select("q", "k", F.round(vx.cosine(F.col("w"), F.col("v")), 6).alias("s")).where("s >= 0.2")
    want = {(r.q, r.k, repr(r.s)) for r in rank.per_group_top(pairs, ["q"], "s", "k", 5).collect()}
    met = blocks.meet(blocks.packed(q, "q", "w", 9), blocks.packed(df, "k", "v", 9), partial(blocks.nearest, n=5, least=0.2), "q long, k long, s double")
    found = met.withColumn("s", F.round("s", 6)).where("s >= 0.2")
    assert {(r.q, r.k, repr(r.s)) for r in rank.per_group_top(found, ["q"], "s", "k", 5).collect()} == want
    from brindle.plans import retrieval

    monkeypatch.setattr(retrieval, "table", lambda *_: df.select(F.col("k").alias("vec_id"), F.col("v").alias("embedding")))
    plan = _plan(retrieval.t3_related_items(spark, ""))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_f8_wide_hamming_pairs_by_blocks(spark, monkeypatch):
    """Small blocks lose no link at radius 12, and no pair of rows is joined through keys of bits; F9 rests on these links."""
    from brindle.operators import blocks, dedup

    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 5)
    v = [int(b) ^ int(sum(1 << int(p) for p in rng.choice(63, n, replace=False))) for b in base for n in (0, 1, 6, 7, 12, 13)]
    rows = [(i, x) for i, x in enumerate(v)] + [(98, v[3]), (99, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    monkeypatch.setattr(blocks.packed, "__defaults__", (4,))
    found = dedup.hamming_pairs(df, "k", "v", 12)
    first = {}
    for k, x in rows:
        first.setdefault(x, k) if x is not None else None
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(i, j, far(x, y)) for x, i in first.items() for y, j in first.items() if i < j and far(x, y) <= 12}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and "MapInArrow" in found._jdf.queryExecution().analyzed().toString()
    led = {r.k: r.leader for r in dedup.hamming_leaders(df, "k", "v", 12).collect()}
    follow = {}
    for k in sorted(first.values()):
        lead = [a for a, b, _ in sorted(want) if b == k and follow[a] == a]
        follow[k] = lead[0] if lead else k
    assert led == {k: k if x is None else follow[first[x]] for k, x in rows}


def test_f6_marginal_relevance_in_few_rounds(spark, monkeypatch):
    """The choice is that of a greedy search however few segments a round takes, and with enough of them one round does all."""
    from brindle.operators import multivector
    from brindle.sources import storage

    rng = np.random.default_rng(6)
    rows = [(g, k, [float(x) for x in rng.normal(size=5)], float(rng.choice([1.0, 1.2]))) for g in range(2) for k in range(30 * g, 30 * g + 25)]
    rows += [(2, 90, [1.0, 0.0], 1.0), (2, 91, [0.0, 0.0], 1.0), (2, 92, None, 1.0)]
    df = spark.createDataFrame(rows, "g long, k long, v array<double>, w double")
    kept = []
    monkeypatch.setattr(storage, "materialize", lambda x, f=storage.materialize: kept.append(1) or f(x))
    found = {}
    for choice in (1_024, 4, 1):
        kept.clear()
        monkeypatch.setattr(multivector, "CHOICE", choice)
        found[choice] = {(r.g, r["rank"]): r.k for r in multivector.mmr_top(df, "g", "k", "v", "w", ratio=0.2, least=2, most=5).collect()}
        assert choice < 1_024 or len(kept) == 2  # it was one more than twice the target
    assert found[1] == found[4] == found[1_024] and len(found[1]) == 12 and found[1][2, 1] == 90


#: The greatest is two and a half times the mean, but above it as doubles add up.
TIE = [0.09, 0.09, 0.09, 0.0, 0.03, 0.06, 0.0, 0.06, 0.03, 0.15000000000000002]


def _same(spark, tmp_path, name, **tables):
    """The query's rows on small tables, after a comparison with its SQL."""
    import duckdb

    import __spark_entry__
    from tests.oracle import rows_of

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(__spark_entry__.oracle_sql()[name])
    assert rows_of(df.columns, rows) == rows_of([c[0] for c in res.description], res.fetchall())
    return sorted(rows)


def test_f10_a_difference_at_the_limit_is_no_scene_change(spark):
    """Two and a half times the mean, up to the rounding of sums, is not above it."""
    from brindle.operators import frames

    rows = [(1, i, d, 0.0, 0, 0, 0) for i, d in enumerate(TIE)]
    df = spark.createDataFrame(rows, "image long, frame long, difference double, entropy double, r int, g int, b int")
    assert frames.complexity(df).first()["scene_changes"] == 0


def test_f11_denials_are_whole_words(spark, tmp_path):
    """A letter beyond ASCII beside it makes a denial part of a longer word, in the query and in SQL."""
    turns = ["water flows under bridges", "Pasèlo water flows here", "water flows, pas", "noël water flows"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn long, text string")
    assert _same(spark, tmp_path, "x26_fact_contradictions", conversations=df) == [(1, 0, 2), (1, 1, 2), (1, 2, 3)]


@pytest.mark.parametrize("lines, nodes", [([(3, 1), (4, 1), (4, 2), (8, 2), (5, 1), (5, 2)], [3, 10**9 + 1, 4, 10**9 + 2, 8]), ([(3, 1), (8, 1), (8, 2)], [3, 10**9 + 1, 8]), ([(3, 1), (8, 2)], [])])
def test_f12_shortest_path_of_any_length(spark, tmp_path, lines, nodes):
    """Paths of four hops, of two, and none."""
    df = spark.createDataFrame(lines, "l_suppkey long, l_partkey long")
    assert _same(spark, tmp_path, "kg16_shortest_path", lineitem=df) == list(enumerate(nodes))


def test_f13_online_clusters_of_many_vectors(spark):
    """Clusters are those of a plain loop, and a group of 5,000 vectors that are all alone takes seconds (it was a minute and a half)."""
    import time

    from brindle.operators import folds

    rng = np.random.default_rng(13)
    v = (rng.normal(size=(4, 8))[rng.integers(0, 4, 150)] + 0.5 * rng.normal(size=(150, 8))).astype("float32")
    v[::9], v[5] = v[0], 0
    sums, want = [], {}
    for i, x in enumerate(v.astype(float)):
        sims = [float(x @ s) / max(float(np.linalg.norm(x) * np.linalg.norm(s)), 1e-12) for s in sums]
        if not sims or max(sims) < 0.7:
            sums.append(x.copy())
            want[i] = len(sums) - 1
        else:
            want[i] = int(np.argmax(sims))
            sums[want[i]] += x
    df = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)] + [(2, 0, [1.0] * 8), (2, 1, [float("nan")] * 8), (2, 2, [1.0] * 8)], "g long, k long, v array<float>")
    got = {(r.g, r.k): r.cluster for r in folds.online_clusters(df, "g", "k", "v", 0.7).collect()}
    assert got == {(1, i): c for i, c in want.items()} | {(2, 0): 0, (2, 1): 1, (2, 2): 0}
    many = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(rng.normal(size=(5_000, 64)))], "g long, k long, v array<double>")
    began = time.time()
    assert folds.online_clusters(many, "g", "k", "v").where("cluster = k").count() == 5_000
    assert time.time() - began < 40


def test_f7_patterns_meet_few_words(spark):
    """Words without a fixed correction pass by a lookup; what is corrected is the same, with white space and capitals."""
    from pyspark.sql import functions as F

    texts = ["tne cat", "Tne\tcat \ttne\n", "dont\nDont", "5O5 aO l0 O", "", None, "a tn\x0b", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: (r.t, r.corrections) for r in ocr.corrected(df, "k", "t").collect()}
    assert got[0] == ("the cat", 1) and got[1][0] == "Tne\tcat \tthe\n" and got[2][0] == "dont\nDont" and got[4] == ("", 0) and got[5] == (None, 0) and got[6][0] == "a in\x0b" and got[7][0] == "\n"
    plan = df.select(ocr._fixed_word(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN lower(translate(" in plan


def test_f14_f15_pairs_arise_behind_the_shuffle(spark, tmp_path):
    """Shared values and peers as SQL has them; no pair is shuffled, and the tasks grow with the rows."""
    from brindle.plans import relational

    lines = [(k, v) for v in range(12) for k in range(1 + v % 4, 7)] * 2
    line = spark.createDataFrame(lines, "l_suppkey long, l_partkey long")
    supplier = spark.createDataFrame([(k, k / 4) for k in range(8)], "s_suppkey long, s_acctbal double")
    assert len(_same(spark, tmp_path, "j9_shared_chunks", lineitem=line)) == 15
    assert len(_same(spark, tmp_path, "j18_peers_sharing_vectors", lineitem=line, supplier=supplier)) == 6
    plan = _plan(relational.j9_shared_chunks(spark, str(tmp_path)))
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_f3_groups_of_communities_and_components(spark, monkeypatch):
    """Components that a task holds are folded apart; folds of groups of communities and of parts of groups end where no node gains."""
    import random

    from brindle.operators import communities as cm
    from brindle.operators import graph as gr

    rng = random.Random(5)
    edges = [(c * 100 + a, c * 100 + b, rng.choice([1.0, 2.0])) for c in range(3) for a in range(30) for b in range(a) if rng.random() < (0.6 if a // 10 == b // 10 else 0.05)]
    both = gr.undirected(spark.createDataFrame(edges, "src long, dst long, weight double")).cache()
    whole = gr.modularity(both, cm.louvain(both, least=1)).first()[0]
    n = both.where("a < 100").count()
    monkeypatch.setattr(cm, "local_moving", None)  # components that a task holds need no rounds
    monkeypatch.setattr(cm, "FOLD_EDGES", both.count() // 2)
    apart = cm.louvain(both, least=1).cache()
    assert apart.count() == both.select("a").distinct().count()
    assert abs(gr.modularity(both, apart).first()[0] - whole) < 0.02  # nodes come in another order
    assert apart.withColumn("c", apart["node"] > 99).groupBy("community").agg({"c": "max"}).count() >= 6
    monkeypatch.undo()
    monkeypatch.setattr(cm, "FOLD_EDGES", n // 6)
    one = both.where("a < 100").cache()
    label = {r.node: r.label for r in cm.local_moving(one).collect()}
    near, m2 = {}, one.agg({"weight": "sum"}).first()[0]
    for a, b, w in one.collect():
        near.setdefault(a, {})[b] = w
    sigma = {}
    for v, x in near.items():
        sigma[label[v]] = sigma.get(label[v], 0) + sum(x.values())
    for v, x in near.items():
        inside, k = {}, sum(x.values())
        for u, w in x.items():
            inside[label[u]] = inside.get(label[u], 0) + w
        gain = {c: inside.get(c, 0) / m2 - k * (sigma[c] - (k if c == label[v] else 0)) / m2**2 for c in {*inside, label[v]}}
        assert max(gain.values()) <= gain[label[v]] + 1e-8


def test_f18_to_f21_tasks_grow_with_the_edges(spark, monkeypatch):
    """Edges are grouped and met in tasks of so many rows; results are those of one task."""
    from brindle.operators import graph as gr

    df = spark.createDataFrame([(i % 7, 100 + i % 30) for i in range(400)] * 2, "src long, dst long")
    once = {tuple(r) for r in gr.undirected(df, weight=None).collect()}
    hops = sorted(map(tuple, gr.k_hop(df, spark.createDataFrame([(3,)], "node long"), 2).collect()))
    placed = df.selectExpr("src as node", "src % 2 as community").union(df.selectExpr("dst", "dst % 2")).distinct()
    monkeypatch.setattr(gr, "GROUP_ROWS", 40)
    both = gr.undirected(df, weight=None)
    assert both.rdd.getNumPartitions() == 40 and {tuple(r) for r in both.collect()} == once
    assert sorted(map(tuple, gr.k_hop(df, spark.createDataFrame([(3,)], "node long"), 2).collect())) == hops
    monkeypatch.setattr(gr, "GROUP_ROWS", 4)
    kept = both.cache()
    q = gr.modularity(kept, placed)
    q.collect()
    assert f", {-(-kept.count() // 4)})" in _plan(q)
    m2 = sum(w for _, _, w in once)
    want = sum(sum(w for a, b, w in once if a % 2 == b % 2 == c) / m2 - (sum(w for a, _, w in once if a % 2 == c) / m2) ** 2 for c in (0, 1))
    assert abs(q.first()[0] - want) < 1e-9


@pytest.mark.parametrize("name", ["j8_cooccurrence", "kg5_cooccurrence_edges", "a2_graph_stats"])
def test_f25_f27_f28_tasks_grow_with_the_line_items(spark, monkeypatch, name):
    from brindle.operators import graph as gr
    from brindle.plans import registry

    query, d = registry.queries()[name], "/root/testdata/sf0.001"
    want = sorted(map(tuple, query(spark, d).collect()))
    monkeypatch.setattr(gr, "GROUP_ROWS", 500)
    found = query(spark, d)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert name.startswith("kg5") or f", {-(-lines // 500)})" in _plan(found)
    assert "REPARTITION_BY_NUM" in _plan(found) and sorted(map(tuple, found.collect())) == want


def test_f22_f23_words_meet_their_frequencies_by_blocks(spark, monkeypatch):
    """No row of a document and a term is shuffled; rows of one id are one document; ties, nulls and empty texts."""
    import math
    from collections import Counter

    from brindle.operators import texts

    monkeypatch.setattr(texts, "BLOCK_CHARS", 40)
    rows = [(i, " ".join(f"w{(i * j) % 9}" for j in range(12)) + f" own{i}") for i in range(20)] + [(3, "w1 again"), (50, None), (51, ""), (52, "bb aa cc dd")]
    df = spark.createDataFrame(rows, "k long, t string")
    found = texts.tfidf(df, "k", "t", 3)
    plan = _plan(found)
    assert "hashpartitioning(doc_id" not in plan.split("FlatMapCoGroupsInPandas")[-1]
    counts = {}
    for k, t in rows:
        counts.setdefault(k, Counter()).update((t or "").split())
    often = Counter(w for c in counts.values() for w in c)
    want = {(k, w, round(n * math.log(len(rows) / often[w]), 6)) for k, c in counts.items() for w, n in sorted(c.items(), key=lambda x: (-round(x[1] * math.log(len(rows) / often[x[0]]), 6), x[0]))[:3]}
    assert {tuple(r) for r in found.collect()} == want
    shares = {r[0]: r[1] for r in texts.known_share(df, "k", "t", 10).collect()}
    assert shares == {k: round(sum(n for w, n in c.items() if often[w] >= 10) / sum(c.values()), 6) for k, c in counts.items() if c}


def test_f17_document_scores_read_a_text_once(spark):
    """Every pattern's count as the pattern itself finds it, with letters, marks and digits of other scripts beside the words; few patterns read whole texts."""
    import random

    from pyspark.sql import functions as F

    from brindle.operators import judgement as jd

    rng = random.Random(5)
    bits = [*jd._WORDS, *jd._RUNS] * 2 + "he said|she  walked|mr. x|miss y|`a b`|```|v1.20|v2|flipflop|flip-flop|logic gate|and gate|or gate|setup time|state machine|virtual dom|(smith, 2001)|(smith2001)|et al.|et al|op. cit|opcit|op cit|figure 3|table4|q3|q5|fy2020|may not|is prohibited|section 9|according to|step 1|step2|first,|how to|see also|quick start|quickstart|asked questions|frequently asked|hooks|officials|std_logic|_said|said_|saids|2said|été|é|́|K|K|İ|ß|\"|'|a long line of twenty letters|x".split("|")
    glue = [" ", " ", " ", ". ", ", ", "\n", "", "é", "́", "_", "-", "—", "“", "”", " ", "'", '"', "(", ")", "7", "字", "\U0001d400", "`"]
    make = lambda n: "".join(rng.choice(glue) + rng.choice(bits) for _ in range(n))
    rows = [(i, make(rng.choice([1, 2, 3, 6, 40])), make(rng.randint(0, 3))) for i in range(1500)] + [(1500, "", ""), (1501, "SAID Said saıd", "Chapter 3")]
    df = spark.createDataFrame(rows, "i int, t string, h string")
    low, heads = F.lower("t"), F.lower("h")
    plain = [F.round(sum((F.lit(w) * F.least(F.regexp_count(low, F.lit(p)), F.lit(3)) + F.when(heads.rlike(p), F.lit(w * 0.5)).otherwise(0.0) for p, w in own), F.lit(0.0)), 9) for own in jd.DOCUMENT_TYPES.values()]
    got = df.select("i", jd.document_scores(F.col("t"), F.col("h")).alias("r")).select("i", F.transform("r", lambda x: x["score"]).alias("s"), F.transform("r", lambda x: x["type"]).alias("k"))
    both = got.join(df.select("i", F.array(*plain).alias("want")), "i").collect()
    assert len(both) == len(rows) and all(r.s == r.want and r.k == list(jd.DOCUMENT_TYPES) for r in both)
    assert sum(max(r.s) > 0 for r in both) > 1000
    patterns = [p for own in jd.DOCUMENT_TYPES.values() for p, _ in own]
    assert set(patterns) == set(jd._WHOLE) | set(jd._NEEDS) and not set(jd._WHOLE) & set(jd._NEEDS)


def test_f16_segments_are_read_once_and_go_to_their_documents(spark):
    """The plan reads no Markdown again and shuffles no row of a document and a word; scores as by plain loops."""
    import math
    import re

    from pyspark.sql import functions as F

    from brindle.operators import multivector as mv

    say = [f"w{(i * 7) % 11} w{(i * 5) % 13} Ünder_{i % 4} w{i % 3} w{i % 3} 50%" if i % 9 == 0 else f"w{(i * 7) % 11} w{(i * 5) % 13} the at w{i % 5}x w{i % 5}x" for i in range(90)]
    rows = [(d, n, "sentence", f"h{n // 30}" if d else "", 1, say[(n * (d + 3)) % 90]) for d in range(3) for n in range(1, 61)] + [(9, 1, "sentence", "", 0, None), (10, 1, "code", "x", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, n long, type string, heading string, level int, text string")
    found = mv.prefilter(df, 12, 5)
    plan = _plan(found)
    assert "LocalTableScan" not in plan and "Scan ExistingRDD" in plan
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, [a-z_]", plan)
    own = {}
    for r in rows:
        own.setdefault(r[0], {})[r[1]] = r
    words = lambda t: [w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 2 and w not in mv.STOP]
    want = set()
    for d, segs in own.items():
        w = {n: words(r[5]) for n, r in segs.items()}
        df_, tf = {}, {}
        for x in w.values():
            for t in x:
                tf[t] = tf.get(t, 0) + 1
            for t in set(x):
                df_[t] = df_.get(t, 0) + 1
        q = dict(sorted(((t, round(tf[t] * math.log(len(segs) / (df_[t] + 1)), 9)) for t in tf if df_[t] < 0.8 * len(segs)), key=lambda x: (-x[1], x[0]))[:5])
        score = {n: round(sum(q[t] for t in set(x) if t in q), 6) for n, x in w.items()}
        sure, heads = {}, {}
        for n, r in sorted(segs.items()):
            heads.setdefault(r[3], []).append(n)
        for n, r in segs.items():
            inside = [m for m in heads[r[3]] if segs[m][2] == r[2]]
            if r[2] == "sentence":
                sure[n] = "first" if r[3] and n == inside[0] else "last" if r[3] and n == inside[-1] else "binding" if re.search(r"\d+%\w", r[5] or "") else None
            else:
                sure[n] = "code" if r[3] and n == inside[0] else None
        kept = [n for h, ns in heads.items() for n in sorted(ns, key=lambda n: (-score[n], n))[: max(10, 12 // len(heads))]]
        order = sorted({*kept, *(n for n in segs if sure[n])}, key=lambda n: (sure[n] is None, -score[n], n))
        want |= {(d, n, sure[n] or "score") for i, n in enumerate(order, 1) if sure[n] or i <= 12}
    assert {tuple(r) for r in found.collect()} == want
    texts = ["50%x", "5 % a", "MUST go", "must", "$5", "Note: x", "require x", "REQUIRED now", "shall\tnot", "free", "", None]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(mv.binding(F.col("t")).alias("a"), F.col("t").rlike(mv.BINDING).alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_f26_graph_of_the_questions_is_read_once(spark):
    """Modes share what is kept of the mentions, the best documents and the local answer; none of them reads the documents again."""
    from brindle.plans import registry

    found = registry.queries()["kg13_three_modes"](spark, "/root/testdata/sf0.001")
    assert "FileScan" not in _plan(found)
    assert sorted(r["mode"] for r in found.collect()) == ["drift", "global", "local"]
