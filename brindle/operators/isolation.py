"""Work on items that may fail, each by itself: a failure is a row with its error, and the rest goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_ERROR = 200


def isolated(items: DataFrame, work: Callable[[object], dict], fields: str, key: str = "key", value: str = "value", at_once: int = 256) -> DataFrame:
    """(key, status, error, and the fields): what work makes of each value, or why it failed.

    work gets one value and gives a dictionary of the fields (others are null); it may
    raise anything. Python runs in Arrow batches, in slices of at_once items; items are
    spread as they lie, so the partitions are the parallelism. A null value is given on as
    None. Results that do not fit the fields' types count as failures of their item.
    """
    kind = items.schema[key].dataType.simpleString()
    names = [f.name for f in StructType.fromDDL(fields).fields]
    arrow = items.sparkSession.createDataFrame([], fields).limit(0).toArrow().schema

    def fits(made: dict) -> dict:
        for f in arrow:
            pa.scalar(made.get(f.name), f.type)
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                made, status, error = [], [], []
                for v in batch.column("value").to_pylist():
                    try:
                        made.append(fits(work(v)))
                        status.append("done")
                        error.append(None)
                    except Exception as e:  # noqa: BLE001  whatever an item brings about stays with it
                        made.append({})
                        status.append("failed")
                        error.append(f"{type(e).__name__}: {e}"[:MOST_ERROR])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(status, pa.string()), pa.array(error, pa.string()), *(pa.array([m.get(n) for m in made], arrow.field(n).type) for n in names)], names=["key", "status", "error", *names])

    slim = items.select(F.col(key).alias("key"), F.col(value).alias("value"))
    return slim.mapInArrow(run, f"key {kind}, status string, error string, {fields}").withColumnRenamed("key", key)


def folder_items(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(key, value): path and bytes of the files that match, read by Spark from any store."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select(F.col("path").alias("key"), F.col("content").alias("value"))


def batch_report(results: DataFrame) -> DataFrame:
    """One row: items, done, failed, and the errors with their counts, the most frequent first (ties by kind)."""
    kinds = results.where("status = 'failed'").groupBy(F.substring_index("error", ":", 1).alias("kind")).agg(F.count("*").alias("n"))
    errors = kinds.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind"))), lambda x: F.concat(x["kind"], F.lit(" x"), (-x["o"]).cast("string"))).alias("errors"))  # a row a kind of error
    counts = results.agg(F.count("*").alias("items"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.crossJoin(errors)  # one row each
