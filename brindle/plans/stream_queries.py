"""The streaming operators' batch forms over events; tests hold the streams to the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.storage import shared_folder
from ..streaming import events as ev
from ..streaming import ingest as ig
from ..streaming import intake as ik
from .registry import query, table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st9_tumbling_windows(spark, d):
    return ev.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def st9_session_windows(spark, d):
    return ev.sessions(table(spark, d, "events"))


def _folder(spark, name: str) -> str:
    """A new folder in the session's shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, d, name: str):
    """A table's files as a stream; a pattern, since a stream's plain path has to be a folder and a table may be one file."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS doc_id, ts, event_type || ' ' || event_id AS message, event_type = 'error' AND event_id % 3 = 0 AS done FROM events), o AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY doc_id ORDER BY ts, message ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
 g AS (SELECT doc_id, k, bool_or(done) AS done, count(*) AS received, min(ts) AS created, list(message ORDER BY ts, message) AS l FROM o GROUP BY 1, 2), s AS (SELECT *, greatest(0, received - 20) AS dropped, l[greatest(1, received - 19):] AS updates FROM g)
 SELECT doc_id, CASE WHEN done THEN 'complete' ELSE 'open' END AS status, received, dropped, updates FROM s
 UNION ALL SELECT doc_id, 'abandoned', received, dropped, updates FROM s WHERE NOT done AND created + INTERVAL 1 HOUR < (SELECT max(ts) FROM events)"""
)
def st2_progress_channels(spark, d):
    """Channels of twenty messages a user, as a stream leaves them: complete, open, and given up an hour after their start."""
    e = _stream(spark, d, "events")
    updates = e.select(F.col("user_id").cast("string").alias("doc_id"), "ts", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("message"), ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("done"))
    folder = _folder(spark, "progress")
    ev.drain(ik.progress(updates, most=20), f"{folder}/out", f"{folder}/stream", mode="update").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query()
def st4_budgeted_ingest(spark, d):
    """Which sentences of each conversation are taken in under a budget, turn after turn."""
    return ig.budgeted(ingest_segments(spark, d), ig.Limits(budget=40, bootstrap_chunks=3, chunk_cap=4, expected_chunks=8, tail_reserve=6))


def ingest_segments(spark, d):
    """Sentences of turns with a vector of letter shares; the first of a user's turn is its heading."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ", -1)).alias("segment", "text"))
    share = lambda letters: F.length(F.regexp_replace(F.lower("text"), f"[^{letters}]", "")) / F.greatest(F.lit(1), F.length("text"))
    kind = F.when((F.col("role") == "user") & (F.col("segment") == 0), "heading").otherwise("sentence")
    return c.select("doc_id", "chunk", "segment", kind.alias("kind"), "text", (1 / (F.col("segment") + 1)).alias("weight"), F.md5("text").alias("hash"), F.array(share("aeiou"), share("nrst"), share("bcdfg"), share("hjklm")).alias("vector"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'quarantine' ELSE 'done' END AS status, CASE WHEN o_orderkey % 97 = 0 THEN 3 WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END::INT AS attempts FROM orders"
)
def st1_jobs_with_retries(spark, d):
    """Orders as jobs: some fail once, some always; those end in quarantine after three attempts, the rest are done."""
    def work(batch):
        key = F.col("o_orderkey")
        return batch.withColumn("error", F.when(key % 97 == 0, "poisoned").when((key % 13 == 0) & (F.col("attempt") == 0), "try again"))

    folder = _folder(spark, "jobs")
    ik.drain_jobs(_stream(spark, d, "orders").select("o_orderkey"), work, folder)
    read = lambda part: spark.read.parquet(f"{folder}/{part}").select("o_orderkey", F.lit(part).alias("status"), F.col("attempt").alias("attempts"))
    return read("done").union(read("quarantine"))


@query(
    """WITH e AS (SELECT event_type || user_id AS path, ts, CAST(floor(value) AS BIGINT) AS length, md5(event_id::VARCHAR) AS hash FROM events), g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
 b AS (SELECT path, max(ts) AS ts, arg_max(length, (ts, length)) AS length, arg_max(hash, (ts, length)) AS hash, count(*) AS events FROM s GROUP BY path, k) SELECT * FROM b WHERE length > 0"""
)
def src14_settled_files(spark, d):
    """Bursts of events of a file, two hours apart, as their last event leaves them."""
    e = table(spark, d, "events")
    files = e.select(F.concat("event_type", F.col("user_id").cast("string")).alias("path"), "ts", F.floor("value").alias("length"), F.md5(F.col("event_id").cast("string")).alias("hash"))
    return ik.settled(files, "2 hours")
