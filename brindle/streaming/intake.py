"""Jobs and files that come in: progress channels with a bounded ring and expiry, retries and quarantine, settled files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RING = 500
MAX_AGE_MS = 3_600_000
MAX_FILES = 100
SEPARATOR = "\x1e"

CHANNEL = "doc_id string, status string, received long, dropped long, updates array<string>"


def progress(updates: DataFrame, most: int = RING, max_age_ms: int = MAX_AGE_MS, late: str = "0 seconds") -> DataFrame:
    """A channel a document from updates (doc_id string, ts, message, done): its state after each micro-batch; update mode.

    A channel holds the last ``most`` messages and drops the oldest beyond that. It ends
    with an update that is done (status complete), or when the watermark is max_age past
    its first update (status abandoned); either way its state is gone, and a later update
    opens a new one. Messages of one time come in their own order.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        created, received, dropped, ring = state.get if state.exists else (None, 0, 0, "")
        kept = ring.split(SEPARATOR)[1:]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "status": ["abandoned"], "received": [received], "dropped": [dropped], "updates": [kept]})
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "message"])
        out = []
        for ts, message, done in zip(rows["ts"], rows["message"], rows["done"], strict=True):
            created = int(ts.value // 10**6) if created is None else created
            kept.append(("" if message is None else message).replace(SEPARATOR, " "))
            received += 1
            if len(kept) > most:
                dropped += len(kept) - most
                kept = kept[-most:]
            if done:
                out.append((key[0], "complete", received, dropped, kept))
                created, received, dropped, kept = None, 0, 0, []
        if created is None:
            if state.exists:
                state.remove()
        else:
            state.update((created, received, dropped, "".join(SEPARATOR + m for m in kept)))
            state.setTimeoutTimestamp(max(created + max_age_ms, state.getCurrentWatermarkMs() + 1))
            out.append((key[0], "open", received, dropped, kept))
        yield pd.DataFrame(out, columns=["doc_id", "status", "received", "dropped", "updates"])

    slim = updates.select("doc_id", F.col("ts").cast("timestamp").alias("ts"), "message", F.coalesce("done", F.lit(False)).alias("done")).where("doc_id is not null and ts is not null")
    return slim.withWatermark("ts", late).groupBy("doc_id").applyInPandasWithState(update, CHANNEL, "created long, received long, dropped long, ring string", "update", GroupStateTimeout.EventTimeTimeout)


def jobs(spark: SparkSession, folder: str, schema: str, files_at_once: int = MAX_FILES) -> DataFrame:
    """A stream of job files (JSON lines): at most so many a micro-batch, the rest wait in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _settle(batch: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, number: int, most: int) -> int:
    """One round of work on batch (with attempt): done, waiting and failed rows, each in the folder of the round; how many wait."""
    told = work(batch)
    if "error" not in told.columns:
        raise ValueError("work has to add a column error, null where a job went well")
    told = told.withColumn("attempt", F.col("attempt") + 1)
    path = f"{folder}/rounds/round={number}"
    told.write.mode("overwrite").parquet(path)  # the work is done once; what follows reads its outcome
    outcome = batch.sparkSession.read.parquet(path)
    outcome.where("error is null").drop("error").write.mode("overwrite").parquet(f"{folder}/done/round={number}")
    outcome.where(F.col("error").isNotNull() & (F.col("attempt") >= most)).write.mode("overwrite").parquet(f"{folder}/quarantine/round={number}")
    waiting = outcome.where(F.col("error").isNotNull() & (F.col("attempt") < most))
    waiting.drop("error").select(batch.columns).write.mode("overwrite").parquet(f"{folder}/waiting/round={number}")
    return waiting.count()


def drain_jobs(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, attempts: int = 3) -> int:
    """Works off all jobs of a stream that are there; returns how many rounds it took.

    work adds a column error (null: it went well) and must not raise for a bad job. A
    failed job waits for the next round, with new jobs, until it has had its attempts;
    then it goes to quarantine and the rest go on. Each round's rows are a folder of
    their own (done, waiting, quarantine) that a repeated round overwrites, so a round
    that a lost driver cut short is done again without doubles.
    """
    spark = stream.sparkSession

    def joined(new: DataFrame | None, number: int) -> DataFrame | None:
        before = f"{folder}/waiting/round={number - 1}"
        old = spark.read.parquet(before) if number and _exists(spark, before) else None
        if new is None or old is None:
            return new if old is None else old
        return new.unionByName(old)

    def put(batch: DataFrame, number: int) -> None:
        _settle(joined(batch.withColumn("attempt", F.lit(0)), number), work, folder, number, attempts)

    query = stream.writeStream.option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    number = 0
    while _exists(spark, f"{folder}/waiting/round={number}"):
        number += 1
    left = joined(None, number)
    while left is not None and not left.isEmpty():  # no new jobs: what waits gets its further attempts
        _settle(left, work, folder, number, attempts)
        number += 1
        left = joined(None, number)
    return number


def watched_files(spark: SparkSession, folder: str, extensions: list[str], stream: bool = True) -> DataFrame:
    """(path, ts, length, hash) of a folder's files with these extensions, as a stream of new files or as the batch that is there (the seed)."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    return reader.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", F.col("modificationTime").alias("ts"), "length", F.sha2("content", 256).alias("hash"))


def settled(events: DataFrame, quiet: str = "5 seconds", settle: str = "1 second") -> DataFrame:
    """(path, ts, length, hash, events): one row for each burst of a file's events (path, ts, length, hash), as its last event leaves it.

    A burst ends when no event has come for the quiet time; a row is given once the
    watermark is the settle time past that. Files that are empty then (not yet written)
    give none. Works on batches too.
    """
    bursts = events.where("path is not null").withWatermark("ts", settle).groupBy("path", F.session_window("ts", quiet)).agg(F.max_by(F.struct("ts", "length", "hash"), F.struct("ts", "length")).alias("last"), F.count("*").alias("events"))
    return bursts.select("path", "last.ts", "last.length", "last.hash", "events").where("length > 0")


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """files whose content (hash) is not among the known documents yet."""
    return files.join(known.select("hash"), "hash", "left_anti")
