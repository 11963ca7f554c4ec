"""Streams with state against plain replays, jobs with retries, files, and structured map-reduce."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.operators import structured
from brindle.streaming import events as ev
from brindle.streaming import ingest, intake

SEGMENT = "doc_id long, chunk long, segment long, kind string, text string, weight double, hash string, vector array<double>"


def test_stable_hash():
    assert ingest.stable_hash("") == 23
    assert ingest.stable_hash("a") == 23 * 31 + 97
    h = 23
    for c in "stable é 漢":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert ingest.stable_hash("stable é 漢") == h


def segments(rng, docs=12):
    rows = []
    for d in range(docs):
        for c in range(rng.randint(1, 14)):
            for s in range(rng.randint(0, 25)):
                kind = rng.choice(["heading", "sentence", "sentence", "sentence", "code", "list"])
                rows.append((d, c, s, kind, "w" * rng.randint(0, 300), rng.choice([0.5, 1.0, 1.5]), f"{rng.getrandbits(64):016x}", None if rng.random() < 0.1 else [rng.gauss(0, 1) for _ in range(4)]))
    return rows


def replay(rows, lim):
    """The rule again, written apart from the operator."""
    out, by_doc = [], defaultdict(lambda: defaultdict(list))
    for r in sorted(rows, key=lambda r: r[:3]):
        by_doc[r[0]][r[1]].append(r)
    for d, chunks in by_doc.items():
        used, total, n = 0, None, 0
        for count, (c, own) in enumerate(sorted(chunks.items()), 1):
            sentences = [r for r in own if r[3] == "sentence"]
            sure = []
            for r in [r for r in own if r[3] == "heading"] + sentences[:2] + sentences[-2:]:
                if r not in sure:
                    sure.append(r)
            rest = [r for r in own if r not in sure]

            def score(r):
                base = r[5] * {"heading": 1.2, "code": 1.1, "list": 1.05}.get(r[3], 1) + 0.2 * min(len(r[4]) / 200, 1)
                if not n or r[7] is None:
                    return base
                dot, a, b = sum(x * y for x, y in zip(total, r[7])), math.sqrt(sum(x * x for x in total)), math.sqrt(sum(x * x for x in r[7]))
                return 0.7 * dot / (a * b) + 0.3 * base

            left = lim.budget - used
            free = max(0, left - (0 if count >= int(lim.expected_chunks * lim.tail_from) else lim.tail_reserve))
            if free and count < lim.bootstrap_chunks:
                picked = (sure + sorted(rest, key=lambda r: ingest.stable_hash(r[6]))[: min(lim.bootstrap_cap, math.ceil(lim.bootstrap_rate * len(rest)))])[:free]
            elif free:
                picked = (sure + sorted(rest, key=score, reverse=True)[: lim.chunk_cap])[:free]
            elif count % lim.trickle_every == 0:
                picked = (sure + sorted(rest, key=score, reverse=True)[: lim.trickle])[:left]
            else:
                picked = []
            for r in picked:
                used += 1
                out.append((d, c, r[2], used))
                if r[7] is not None:
                    total, n = [x + y for x, y in zip(total or [0.0] * 4, r[7])], n + 1
        assert used <= lim.budget
    return sorted(out)


LIMITS = ingest.Limits(budget=45, bootstrap_chunks=3, chunk_cap=5, expected_chunks=9, tail_reserve=30)


def test_budget_in_batch_and_stream_equal_a_replay(spark, tmp_path):
    rows = segments(random.Random(5))
    want = replay(rows, LIMITS)
    df = spark.createDataFrame(rows, SEGMENT)
    got = ingest.budgeted(df.repartition(5), LIMITS)
    assert sorted((r.doc_id, r.chunk, r.segment, r.used) for r in got.collect()) == want
    assert {r.why for r in got.collect()} == {"sure", "sample", "score", "trickle"}
    for k in range(0, 14, 3):  # micro-batches of three chunks of each document
        df.where(F.col("chunk").between(k, k + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k:02d}"))
    out = []
    stream = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    seen = []

    def keep(batch, n):
        seen.append(n)
        out.extend((r.doc_id, r.chunk, r.segment, r.used) for r in batch.collect())

    ingest.budgeted_stream(stream, LIMITS).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(300)
    assert len(seen) >= 5 and sorted(out) == want
    assert ingest.budgeted(df.limit(0)).collect() == []


def test_progress_drops_the_oldest_and_expires(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{k % 60:02d}", f"m{k:03d}", False) for k in range(30)] + [("b", "2024-01-01 00:10:00", "x", False), ("b", "2024-01-01 00:11:00", "y", True), (None, "2024-01-01 00:11:00", "y", True)]
    later = [("c", "2024-01-01 02:00:00", "z", None), ("b", "2024-01-01 01:59:00", "again", False)]
    last = [("c", "2024-01-01 02:01:00", "end", True)]
    for k, part in enumerate((rows, later, last)):
        df = spark.createDataFrame(part, "doc_id string, t string, message string, done boolean")
        df.select("doc_id", F.to_timestamp("t").alias("ts"), "message", "done").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("doc_id string, ts timestamp, message string, done boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    ev.drain(intake.progress(stream, most=20), str(tmp_path / "out"), str(tmp_path / "c"), mode="update").awaitTermination(300)
    got = sorted((r.doc_id, r.status, r.received, r.dropped, len(r.updates)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "abandoned", 30, 10, 20), ("a", "open", 30, 10, 20), ("b", "complete", 2, 0, 2), ("b", "open", 1, 0, 1), ("c", "complete", 2, 0, 2), ("c", "open", 1, 0, 1)]
    ring = [r.updates for r in spark.read.parquet(str(tmp_path / "out")).where("status = 'abandoned'").collect()]
    assert ring == [[f"m{k:03d}" for k in range(10, 30)]]


def test_jobs_retry_and_go_to_quarantine(spark, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.json(str(tmp_path / "in" / f"j{k}"))
    stream = intake.jobs(spark, str(tmp_path / "in" / "j*"), "id long", files_at_once=1)
    calls = []

    def work(batch):
        calls.append(sorted(r.id for r in batch.select("id").collect()))
        return batch.withColumn("error", F.when(F.col("id") == 7, "poisoned").when((F.col("id") % 5 == 3) & (F.col("attempt") < 1), "busy"))

    rounds = intake.drain_jobs(stream, work, str(tmp_path / "w"), attempts=3)
    done = {r.id: r.attempt for r in spark.read.parquet(str(tmp_path / "w" / "done")).collect()}
    bad = {r.id: (r.attempt, r.error) for r in spark.read.parquet(str(tmp_path / "w" / "quarantine")).collect()}
    assert bad == {7: (3, "poisoned")} and set(done) == set(range(40)) - {7}
    assert all(n == (2 if i % 5 == 3 else 1) for i, n in done.items())
    assert rounds >= 5 and all(len(c) <= 13 for c in calls)  # ten new jobs a round, with the few that wait
    # a repeated round overwrites its folders
    before = spark.read.parquet(str(tmp_path / "w" / "done")).count()
    again = spark.createDataFrame([(0, 0)], "id long, attempt int")
    intake._settle(again, lambda b: b.withColumn("error", F.lit(None).cast("string")), str(tmp_path / "w"), rounds + 1, 3)
    intake._settle(again, lambda b: b.withColumn("error", F.lit(None).cast("string")), str(tmp_path / "w"), rounds + 1, 3)
    assert spark.read.parquet(str(tmp_path / "w" / "done")).count() == before + 1
    with pytest.raises(ValueError):
        intake._settle(again, lambda b: b, str(tmp_path / "w"), rounds + 2, 3)


def test_files_settle_and_seed(spark, tmp_path):
    for name, text in (("a.md", "one"), ("b.txt", "two"), ("c.bin", "three"), ("d.md", "one")):
        (tmp_path / name).write_text(text)
    seed = intake.watched_files(spark, str(tmp_path), [".md", "txt"], stream=False)
    assert sorted(r.path.rpartition("/")[2] for r in seed.collect()) == ["a.md", "b.txt", "d.md"]
    known = seed.where(F.col("path").endswith("b.txt")).select("hash")
    assert sorted(r.path.rpartition("/")[2] for r in intake.unseen(seed, known).collect()) == ["a.md", "d.md"]
    assert intake.watched_files(spark, str(tmp_path), ["md"]).isStreaming
    rows = [("f", "2024-01-01 00:00:00", 0, "h0"), ("f", "2024-01-01 00:00:02", 5, "h1"), ("f", "2024-01-01 00:00:06", 9, "h2"), ("f", "2024-01-01 00:00:20", 4, "h3"), ("g", "2024-01-01 00:00:01", 0, "h"), (None, "2024-01-01 00:00:01", 3, "h")]
    events = spark.createDataFrame(rows, "path string, t string, length long, hash string").withColumn("ts", F.to_timestamp("t")).drop("t")
    got = sorted((r.path, r.length, r.hash, r.events) for r in intake.settled(events).collect())
    assert got == [("f", 4, "h3", 1), ("f", 9, "h2", 3)]  # written three times within the quiet time: one row
    for k, at in enumerate((0, 1, 2, 3)):
        spark.createDataFrame([rows[at]], "path string, t string, length long, hash string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "ev" / f"e{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev" / "e*"))
    ev.drain(intake.settled(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(300)
    assert [(r.path, r.length, r.hash, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("f", 9, "h2", 3)]


ENTITY = "doc_id long, chunk long, place long, name string, type string, description string, aliases array<string>"


def test_aliases_join_in_chains(spark):
    rows = [
        (1, 0, 0, "IBM", "Organization", "short", ["Big Blue"]), (1, 1, 0, "International Business Machines", "Organization", "a longer text", ["I.B.M."]), (1, 2, 0, "big blue", "Company", None, ["The Blue Giant"]),
        (1, 3, 0, "I.B.M.", "Organization", None, ["the blue giant"]), (1, 1, 1, "Parse()", "Function", None, None), (1, 2, 1, "_parse(x, y)", "Function", "parses", []), (1, 0, 1, None, "x", "y", None),
        (2, 0, 0, "Big Blue", "Movie", None, None), (2, 0, 1, "alone", "Concept", None, ["alone"]),
    ]
    merged = structured.stitched(spark.createDataFrame(rows, ENTITY))
    got = {(r.doc_id, r.name): r for r in merged.collect()}
    assert set(got) == {(1, "IBM"), (1, "Parse()"), (2, "Big Blue"), (2, "alone")}
    ibm = got[1, "IBM"]
    assert ibm.chunks == [0, 1, 2, 3] and ibm.description == "a longer text" and ibm.types == ["Company", "Organization"]
    assert ibm.aliases == ["big blue", "i.b.m.", "international business machines", "the blue giant"]
    assert got[1, "Parse()"].chunks == [1, 2] and got[1, "Parse()"].aliases == ["_parse(x, y)"] and got[2, "alone"].aliases == []
    assert [(r.name, r.reason) for r in structured.collisions(merged).collect()] == [("IBM", "Conflicting types: Company, Organization")]


def test_structured_report(spark):
    entities = spark.createDataFrame([(1, 0, 0, "Engine", "Concept", "drives", None), (1, 1, 0, "engine", "Concept", None, None)], ENTITY)
    facts = spark.createDataFrame([(1, 0, 0, "The engine turns the wheels", 3), (1, 1, 0, "The engine does not turn wheels", 2), (1, 1, 1, "weak", 1), (1, 0, 1, "the engine never touches wheels", 3)], "doc_id long, chunk long, place long, statement string, confidence int")
    flows = spark.createDataFrame([(1, 2, 0, ["start", "stop"], "Workflow")], "doc_id long, chunk long, place long, steps array<string>, type string")
    chunks = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "C"), (1, 3, "D"), (1, 4, " "), (2, 0, None)], "doc_id long, chunk long, heading string")
    got = {r.doc_id: r for r in structured.report(chunks, entities, facts, flows).collect()}
    r = got[1]
    assert (r.entities, r.collisions, r.facts, r.sure, r.conflicts) == (1, 0, 4, 2, 2)
    assert r.coverage == (2 + 0.5) / 4 and r.entity_lines == ["- Engine (Concept): drives"] and r.flow_lines == ["- start -> stop (Workflow)"]
    assert r.fact_lines == ["- The engine turns the wheels [0] (confidence: High)", "- the engine never touches wheels [0] (confidence: High)", "- The engine does not turn wheels [1] (confidence: Medium)"]
    assert (got[2].facts, got[2].coverage, got[2].confidence, got[2].fact_lines) == (0, 0.0, "Low", [])
