"""Operators without SQL, against stated values and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.operators import dedup, graph, rank, signals, store, texts
from brindle.sources import web
from brindle.streaming import events as ev


def test_adaptive_top_k(spark):
    df = spark.createDataFrame([(100,), (500,), (1000,), (2000,), (3000,)], "n long")
    got = [tuple(r) for r in df.select(rank.adaptive_k(F.col("n")), rank.adaptive_k(F.col("n"), narrative=True)).collect()]
    assert got == [(15, 15), (25, 38), (50, 75), (100, 100), (100, 100)]


def test_signal_strategies(spark):
    rows = [("a", 10.0, 0.8, 3, 1), ("a", 20.0, 0.6, 1, 2), ("a", 30.0, 0.4, 2, 3), ("b", None, 0.5, 1, 4)]
    df = spark.createDataFrame(rows, "k string, value double, confidence double, ts int, event_id int")
    got = {s: {r.k: r.value for r in signals.aggregate(df, ["k"], s).collect()} for s in signals.STRATEGIES}
    assert got["highest_confidence"]["a"] == 10 and got["most_recent"]["a"] == 10
    assert abs(got["weighted_average"]["a"] - 32 / 1.8) < 1e-9 and got["weighted_average"]["b"] is None
    assert got["majority_vote"]["a"] == 10 and got["collect"]["a"] == [20.0, 30.0, 10.0]
    with pytest.raises(ValueError):
        signals.aggregate(df, ["k"], "other")


def test_globs(spark):
    df = spark.createDataFrame([("color.dominant",), ("color.grid",), ("ocr.text",)], "k string")
    assert [r.k for r in df.where(signals.matches_globs(F.col("k"), "color.*")).collect()] == ["color.dominant", "color.grid"]
    assert df.where(signals.matches_globs(F.col("k"), "@own", {"own": ["ocr.text"]})).count() == 1
    assert df.where(signals.matches_globs(F.col("k"), "")).count() == 3
    assert signals.glob_regex("a.*.b") == "(?i)^a\\.[^.]+\\.b$" and signals.glob_regex("a.**") == "(?i)^a\\..*$"


def test_ranks_without_one_partition(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([1, 2, 3, 5, 8, 13, i]))) for i in range(500)]
    got = {r.k: r["rank"] for r in rank.ranked(spark.createDataFrame(rows, "k long, s double"), "s", "k", 8).collect()}
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_mmr_is_a_permutation_led_by_the_most_relevant(spark):
    rng = np.random.default_rng(0)
    rows = [("d", i, rng.normal(size=4).tolist(), 1.0) for i in range(30)]
    r = rank.mmr(spark.createDataFrame(rows, "d string, k long, v array<double>, w double"), "d", "k", "v", "w").collect()
    assert sorted(x.k for x in r) == list(range(30)) and sorted(x["rank"] for x in r) == list(range(1, 31))
    x = np.array([row[2] for row in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert next(y.k for y in r if y["rank"] == 1) == int(np.argmax(x @ x.mean(axis=0)))


def test_hash_embedder(spark):
    df = spark.createDataFrame([("alpha beta gamma",), ("gamma beta alpha",), ("",), (None,)], "t string").select(rank.hash_embedder(64)("t").alias("v")).collect()
    assert df[0].v == df[1].v and abs(sum(x * x for x in df[0].v) - 1) < 1e-9 and df[2].v == [0.0] * 64 == df[3].v


def test_chunks_keep_the_text(spark):
    rng = random.Random(3)
    rows = [(i, "\n\n".join("x" * rng.randint(0, 300) for _ in range(rng.randint(1, 20)))) for i in range(20)] + [(99, None)]
    df = spark.createDataFrame(rows, "d long, t string")
    got = {}
    for r in texts.budget_chunks(df, "d", "t", 100).orderBy("d", "chunk").collect():
        got.setdefault(r.d, []).append(r.text)
    assert {d: "\n\n".join(c) for d, c in got.items()} == {d: t for d, t in rows if t is not None}
    assert all(len(c) // 4 <= 100 or "\n\n" not in c for cs in got.values() for c in cs)


def test_windows_cover_the_text(spark):
    df = spark.createDataFrame([("abcdefghij" * 7,), ("ab",)], "t string").select(tx.windows(F.col("t"), 30, 10).alias("w")).collect()
    assert [len(x) for x in df[0].w] == [30, 30, 30] and df[1].w == ["ab"]
    with pytest.raises(ValueError):
        tx.windows(F.lit("a"), 5, 5)


def test_titles_and_names(spark):
    r = spark.range(1).select(tx.title_of(F.lit("x" * 60)).alias("a"), tx.truncate_at_word(F.lit("one two three"), 9).alias("b"), tx.normalise_name(F.lit('  A "B"\t c ')).alias("c")).first()
    assert r.a == "x" * 47 + "..." and r.b == "one two" and r.c == "a b c"


def test_jaro_winkler():
    assert abs(texts.jaro_winkler("martha", "marhta") - 0.9611111) < 1e-6
    assert abs(texts.jaro_winkler("dixon", "dicksonx") - 0.8133333) < 1e-6
    assert texts.jaro_winkler("", "a") == 0 and texts.jaro_winkler("a", "a") == 1


def test_citations(spark):
    df = spark.createDataFrame([("x [chunk-0] y [chunk-1]",), ("none [1]",), ("[chunk-7]",)], "t string")
    assert [(r.total, r.invalid, r.valid) for r in texts.validate_citations(df, "t", 3).collect()] == [(2, 0, True), (0, 0, False), (1, 1, False)]


def test_leaders_are_greedy(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    got = {r.k: r.leader for r in dedup.leaders(spark.createDataFrame([(i,) for i in range(40)], "k long"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {}
    for i in range(40):
        led = [a for a, b in pairs if b == i and want.get(a) == a]
        want[i] = min(led) if led else i
    assert got == want


def test_hamming_pairs_match_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(i, base[i % 20] ^ sum(1 << p for p in rng.sample(range(63), rng.randint(0, 4)))) for i in range(120)]
    got = {(r.a, r.b) for r in dedup.hamming_pairs(spark.createDataFrame(rows, "k long, v long"), "k", "v", 5).collect()}
    one = {}
    for k, v in rows:
        one.setdefault(v, k)
    want = {(a, b) for (v, a), (w, b) in itertools.permutations(one.items(), 2) if a < b and bin(v ^ w).count("1") <= 5}
    assert got == want


def test_similar_names_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = {(r.a, r.b) for r in dedup.similar_names(df, "k", "s", 0.75).collect()}
    a, b = df.alias("a"), df.alias("b")
    near = a.join(b, F.col("a.k") < F.col("b.k")).where(tx.levenshtein_similarity(F.col("a.s"), F.col("b.s")) >= 0.75)
    assert got == {(r[0], r[1]) for r in near.select("a.k", "b.k").collect()}


def test_paths_and_communities(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 4, 1), (4, 3, 1), (10, 11, 5), (11, 12, 5), (10, 12, 5), (3, 10, 1)], "src long, dst long, weight long")
    assert [r.node for r in graph.shortest_path(edges, 1, 3, 5).collect()] == [1, 2, 3]
    assert graph.shortest_path(edges, 1, 99, 5).count() == 0 and graph.shortest_path(edges, 1, 12, 2).count() == 0
    assert {r.node: r.hop for r in graph.k_hop(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()} == {1: 0, 2: 1, 4: 1, 3: 2}
    both = graph.undirected(edges)
    found = {r.node: r.community for r in graph.label_propagation(both, 10).collect()}
    assert found[10] == found[11] == found[12]
    whole = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.lit(0))
    assert abs(graph.modularity(both, whole).first()[0]) < 1e-12


def test_robots(spark):
    content = "User-agent: *\nDisallow: /a*\nAllow: /a/b # comment\nbroken\n\nUser-agent: other\nDisallow: /\n"
    rules = web.robots_rules(spark.createDataFrame([("h", content), ("all", "User-agent: brindle\nDisallow: /"), ("none", "")], "host string, content string"))
    probes = [("h", "/a/x", False), ("h", "/a/b/c", True), ("h", "/z", True), ("all", "/", False), ("none", "/q", True), ("unknown", "/", True)]
    got = {(r.host, r.path): r.allowed for r in web.allowed(spark.createDataFrame([p[:2] for p in probes], "host string, path string"), rules).collect()}
    assert got == {(h, p): a for h, p, a in probes}


def test_blocked_addresses():
    assert all(map(web.blocked_address, ["127.0.0.1", "10.1.2.3", "169.254.1.1", "localhost", "::1", "[fe80::1]", "0.0.0.0"]))
    assert not any(map(web.blocked_address, ["8.8.8.8", "example.org"]))


def test_archives_and_markdown(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.html", "<p>h</p>")
        z.writestr("y.txt", "text")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "n.md").write_text("no")
    (tmp_path / "doc.md").write_text("# Yes")
    assert [(r.entry, r.text) for r in web.read_archives(spark, str(tmp_path)).collect()] == [("y.txt", "text")]
    assert [r.text for r in web.read_markdown(spark, str(tmp_path)).collect()] == ["# Yes"]
    assert web.read_images(spark, str(tmp_path)).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, body string, seq long")
    new = spark.createDataFrame([(1, "c", 2), (3, None, 1)], "id long, body string, seq long")
    assert {r.id: r.body for r in store.upsert_last(old, new, ["id"], "seq").collect()} == {1: "c", 2: "b", 3: None}
    line = store.csv_lines(spark.createDataFrame([('a"b', 1.25, None)], "x string, y double, z string"), {"y": "%.1f"}).first().line
    assert line == '"a""b",1.3,' or line == '"a""b",1.2,'


def test_streams_equal_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(src, tmp_path / "in" / "e.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = {}

    def keep(df, _):
        for r in df.collect():
            out[r.event_type] = (r.n, round(r.average, 9))

    q = ev.running_average(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination(120)
    want = {}
    for r in batch.orderBy("ts", "event_id").collect():
        n, a = want.get(r.event_type, (0, 0.0))
        want[r.event_type] = (n + 1, r.value if n == 0 else 0.3 * r.value + 0.7 * a)
    assert out == {k: (n, round(a, 9)) for k, (n, a) in want.items()}
    good = F.col("value") >= 0
    ev.drain(stream, str(tmp_path / "good"), str(tmp_path / "c2"), good=good, quarantine=str(tmp_path / "bad")).awaitTermination(120)
    n_good = spark.read.parquet(str(tmp_path / "good")).count()
    assert n_good == batch.where(good).count()


def test_waves_follow_needs_and_guards(spark):
    from brindle.operators import waves

    w = [
        waves.Wave("b", lambda df: {"b": F.col("a") + 1}, 1, frozenset({"x"}), frozenset({"a"}), frozenset({"b"})),
        waves.Wave("a", lambda df: {"a": F.col("id") * 2}, 2, frozenset({"x"}), emits=frozenset({"a"}), when=F.col("id") > 0),
        waves.Wave("c", lambda df: {"c": F.lit(1)}, 3, needs=frozenset({"gone"}), emits=frozenset({"c"})),
    ]
    assert [x.name for x in waves.needed(w, {"b"})] == ["a", "b"] and waves.orphans(w, {"id"}) == {"c": {"gone"}}
    assert [tuple(r) for r in waves.run(spark.range(2), w, {"x"}).orderBy("id").collect()] == [(0, None, None), (1, 2, 3)]
    with pytest.raises(ValueError):
        waves.needed(w, {"zzz"})
    with pytest.raises(ValueError):
        waves.from_config(spark.range(1), [{"step": "nope"}])
    got = waves.from_config(spark.range(6), '[{"step": "derive", "columns": {"k": "id % 2"}}, {"step": "aggregate", "by": ["k"], "columns": {"n": "sum(id)"}}]')
    assert {r.k: r.n for r in got.collect()} == {0: 6, 1: 9}


def test_folds(spark):
    from brindle.operators import folds

    items = spark.createDataFrame([([(True, 30, 1), (False, 40, 2), (False, 50, 3), (False, 5, 4)],)], "x array<struct<required:boolean,size:long,id:long>>")
    assert items.select(folds.within_budget(F.col("x"), 100)).first()[0] == [1, 2]
    v = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.9, 0.1]), ("g", 3, [0.0, 1.0])], "g string, k long, v array<double>")
    assert {r.k: r.cluster for r in folds.online_clusters(v, "g", "k", "v").collect()} == {1: 0, 2: 0, 3: 1}
    n = spark.createDataFrame([("g", 1, "Anna Smith"), ("g", 2, "Anna Smithson"), ("g", 3, "Bob")], "g string, k long, n string")
    assert [r.canonical for r in folds.merge_names(n, "g", "k", "n").orderBy("k").collect()][2] == "Bob"
    s = spark.createDataFrame([("g", 1, "hello"), ("g", 2, "hello there"), ("g", 3, "something else")], "g string, k long, t string")
    assert [r.text for r in folds.subtitles(s, "g", "k", "t").orderBy("k").collect()] == ["hello there", "something else"]
    e = spark.createDataFrame([("g", 1, 0, True), ("g", 2, 0, False)], "g string, k long, d int, ok boolean")
    w = folds.effectiveness(e, "g", "k", "d", "ok").first()
    assert abs(w.weight - (2 - 1 / np.sqrt(2))) < 1e-9 and w.n == 2
