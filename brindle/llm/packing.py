"""Tokenise documents and pack them into fixed-length sequences, bounded-space online best-fit.

A packer holds a fixed number of open bins, filed by their free space; a bitset
of the free spaces in use finds the tightest bin that still holds an item in a
few machine instructions. When a new bin is needed and all places are taken, the
fullest open bin closes. Memory is the open bins, whatever the input.

Items are dealt by hash into groups of a bounded size, and each group is a stream
that is packed by itself, so a lost executor only repeats its groups. A stream
comes in windows of about twice as many items as there are open bins, the longest
items of a window first (ties by hash): the short items at a window's end fill
what its long ones left, so that hardly more sequences are made than by sorting
the whole group, which no bounded number of open bins could follow.

Null texts are empty and give a piece of one token (the end id); ids may repeat
or be null, every row is packed; equal rows are spread over the groups by their
place in the tokenised table; a text of any length is cut into pieces; an empty
table gives no rows; other columns are ignored. Of equally tight bins the one
filed last is taken. Pieces longer than a sequence do not occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_slices, materialize
from .tokens import ByteBpe

LENGTH = 1024
END_ID = 2
OPEN_BINS = 1_024
GROUP_ITEMS = 50_000

PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: the first may be shorter, all others are full."""
    if n <= length:
        return [(0, n)]
    first = n % length
    out = [(0, first)] if first else []
    return out + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.shared(vocabulary)
        for batch in bounded_slices(batches, "text"):
            row, piece, start, size, crc = [], [], [], [], []
            for i, data in enumerate(as_bytes(batch.column("text"))):
                ids = bpe.ids(data) + end
                for k, (s, n) in enumerate(cut(len(ids) >> 2, length)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)] if n << 2 != len(ids) else ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES.format(kind=kind))


class BestFit:
    """Bounded-space online best-fit. place(n) gives (bin number, offset)."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most, self.open, self.made = length, open_bins, 0, 0
        self.spaces = 0  # bit s: some open bin has s free
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            self.spaces ^= 1 << space
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        fits = self.spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1  # the tightest
            number = self._take(space)
        else:
            if n < self.length and self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes
            number, space = self.made, self.length
            self.made += 1
        left = space - n
        if left:
            stack = self.bins[left]
            if not stack:
                self.spaces |= 1 << left
            stack.append(number)
            self.open += 1
        return number, self.length - space


def pack(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """items (a column length of 1 up to the sequence's) with sequence_id and offset appended."""
    items = materialize(items)
    n, short = items.agg(F.count("*"), F.count_if(F.col("length") < length)).first()
    groups = max(1, -(-n // group_items))
    windows = max(1, -(-short // (2 * open_bins * groups)))
    key = F.xxhash64(*[F.col(f"`{c}`") for c in items.columns], F.monotonically_increasing_id())  # a written table has fixed places
    dealt = items.withColumn("_key", key).withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups))).withColumn("_window", F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(windows)))
    dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", "_window", F.desc("length"), "_key")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields), "sequence_id long", "offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fit = None, None
        for batch in batches:
            numbers, offsets = [], []
            for group, n in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if group != now:
                    now, fit = group, BestFit(length, open_bins)
                number, offset = fit.place(n)
                numbers.append(group << 36 | number)
                offsets.append(offset)
            kept = [c for c in batch.schema.names if c not in ("_key", "_group", "_window")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], names=[*kept, "sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, open_bins: int = OPEN_BINS, group_items: int = GROUP_ITEMS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(pieces(docs, vocabulary, length, END_ID, doc_id, text), length, open_bins, group_items)
