"""Structured Streaming: windowed counts, debounce, running centroids and averages, quarantine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by event time; rows later than the watermark are dropped. Works on batches too."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, stop, n): sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def debounced(events: DataFrame, keys: list[str], wait: str = "5 seconds") -> DataFrame:
    """The first event of a key within the wait."""
    return events.withWatermark("ts", wait).dropDuplicatesWithinWatermark(keys)


def running_average(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(event_type, n, average): exponential moving average by key in event order, kept as state between micro-batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, average = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            average = v if n == 0 else alpha * v + (1 - alpha) * average
            n += 1
        state.update((n, float(average)))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "average": [float(average)]})

    return events.select("event_type", "ts", "event_id", "value").groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, average double", "n long, average double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", good=None, quarantine: str | None = None):
    """Writes a stream as Parquet until all that is available is done; rows that fail good go to quarantine.

    A micro-batch is a folder of its own (batch=number) that a retry overwrites, so no row is written twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        if good is None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
            return
        marked = batch.withColumn("_good", F.coalesce(good, F.lit(False)))
        marked.where("_good").drop("_good").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if quarantine:
            marked.where("not _good").drop("_good").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
