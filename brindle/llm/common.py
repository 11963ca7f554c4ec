"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared folder, spark.checkpoint.dir. Where it is unset, a session on one machine (tests) takes one of its own; a cluster may not."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def bounded_slices(batches: Iterator[pa.RecordBatch], text: str | int, max_bytes: int = 3 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about max_bytes of text (a longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + max_bytes, side="right"))
            to = min(n, max(at + 1, to), at + max_rows)
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value; null becomes empty."""
    binary = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [b"" if x is None else x for x in binary.to_pylist()]


MASK = (1 << 64) - 1
#: Odd multipliers of the splitmix64 finaliser, fixed values.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64, copy=False))
