"""Language-model scoring by deleted interpolation of n-grams (n = 3 or 2).

    P(w | u v) = L3(b(u v)) c(u v w) / c(u v) + (1 - L3) P(w | v)
    P(w | v)   = L2(b(v)) c(v w) / c(v) + (1 - L2) P1(w)

b is the context-frequency bucket (binary orders of the context's count) and P1 the
add-one unigram estimate, which keeps a share for unseen words. The weights L are
learned by expectation-maximisation on held-out counts, the lower order first: a
tenth of the training rows is deleted from the counts for that, its tokens are
scored with the counts of the rest, and they return to the counts before the final
scores. The first token of a text has the beginning as its only context.

Counts never meet in one place. Tasks cut their rows into blocks of a bounded
number of bytes as they come, written once to the shared folder. A block sends
each of its distinct n-grams once: hashed keys (words 63 bits, longer n-grams
``MARGIN`` bits more than it takes to number all tokens, so that about one in
2^MARGIN shares a key), sorted, cut by key range, one compressed frame a range. A
key range adds up what all blocks sent it and answers each block with the totals
in the order of its keys. A block then scores its own rows. What is shuffled grows
with the text: a frame's own bytes (about 40) count only where a block has few
keys in a range, and there are never more frames than keys. No table of counts is
broadcast, and a frequent n-gram is one entry a block.

Null texts are empty: one end token. Rows with a null id are scored but not
learned from. Ids and rows may repeat, each row is scored; other columns are
ignored; an empty table gives no rows. A text longer than a block makes a block
larger, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, bounded_slices, crc_mod, materialize, mix64

BLOCK_BYTES = 4 << 20
PART_KEYS = 1 << 21
MARGIN = 14
DELETED = 10
BUCKETS = 48
STEPS = 32  # histogram steps per unit of the natural log of a ratio of estimates
NEVER = -10_000
STORE = 400_000
END, BEGIN = np.uint64(0x656E64) << np.uint64(1), np.uint64(0x626567696E) << np.uint64(1)
_ONE, _ODD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)

_words: dict[bytes, int] = {}


def _hashed(words: list[bytes]) -> np.ndarray:
    """Even 64-bit keys of lower-cased words."""
    if len(_words) > STORE:
        _words.clear()
    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(_words):
        _words[w] = digest(w, 0) >> 1  # fits a signed integer
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words)).view(np.uint64) << _ONE


class Block:
    """The tokens of a block's rows, and for each order the distinct keys, the place of each token's n-gram, and its context's."""

    def __init__(self, texts: list[bytes], order: int = 2, key_bits: int = 63):
        words = [t.lower().split() for t in texts]
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = int(sizes.sum())
        token = np.full(n, END, np.uint64)
        body = np.ones(n, bool)
        body[self.ends - 1] = False
        token[body] = _hashed(list(chain.from_iterable(words)))
        context = np.r_[BEGIN, token[:-1]][:n]
        context[self.starts] = BEGIN
        blank = np.uint64(64 - key_bits)
        first = np.zeros(n, bool)
        first[self.starts] = True
        values, self.token = np.unique(token, return_inverse=True)
        self.keys, self.shift = [values], [0]
        before = np.r_[0, self.token[:-1]][:n]
        #: For each order above one: (tokens that have such an n-gram, place of the n-gram, place of its context one order below).
        self.grams = []
        whole = mix64(mix64(context) + token)
        values, place = np.unique(whole >> blank, return_inverse=True)
        self.keys.append(values)
        self.shift.append(int(blank))
        self.grams.append((np.arange(n), place, np.where(first, self.token[-1] if n else 0, before)))  # there are as many begins as ends
        if order > 2:
            at = np.flatnonzero(~first)
            values, third = np.unique(mix64(mix64(whole[at - 1]) * _ODD + token[at]) >> blank, return_inverse=True)
            self.keys.append(values)
            self.shift.append(int(blank))
            self.grams.append((at, third, place[at - 1]))

    def count(self, role: np.ndarray) -> list[list[np.ndarray]]:
        """For each order, the counts of each key in rows with role 1 and 2."""
        of = np.repeat(role, self.ends - self.starts)
        places = [(np.arange(len(self.token)), self.token), *((at, place) for at, place, _ in self.grams)]
        return [[np.bincount(place[of[at] == r], minlength=len(keys)).astype(np.uint32) for r in (1, 2)] for (at, place), keys in zip(places, self.keys, strict=True)]

    def total(self, values: np.ndarray) -> np.ndarray:
        run = np.r_[0.0, np.cumsum(values)]
        return run[self.ends] - run[self.starts]


def _bundle(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def _unbundle(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


def _frame(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers in one compressed piece; bytes of equal weight stand together."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], np.uint32).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays if len(a)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *planes]))


def _unframe(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:4].view(np.uint32)[0])
    head = raw[4 : 4 + 8 * n].view(np.uint32).tolist()
    out, at = [], 4 + 8 * n
    for length, size in zip(head[:n], head[n:], strict=True):
        end = at + length * size
        out.append(np.ascontiguousarray(raw[at:end].reshape(size, length).T).view(f"u{size}").ravel() if length else np.zeros(0, f"u{size}"))
        at = end
    return out


def _ranges(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the non-empty key ranges of sorted keys; the part is what is left of the shift."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True))


def fit_weights(histogram: list[tuple[int, int, float]], rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket; histogram rows are (bucket, step of the ratio's log or NEVER, count)."""
    out = np.full(BUCKETS, np.nan)
    for b in {h[0] for h in histogram}:
        own = [h for h in histogram if h[0] == b]
        step = np.array([h[1] for h in own], float)
        weight = np.array([h[2] for h in own], float)
        ratio = np.where(step == NEVER, 0.0, np.exp(np.clip(step / STEPS, -600, 600)))
        share = 0.5
        for _ in range(rounds):
            mixed = share * ratio
            share = min(max(float((weight * mixed / (mixed + 1 - share)).sum() / weight.sum()), 1e-6), 1 - 1e-6)
        out[b] = share
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.full(BUCKETS, 0.5)
    return np.interp(np.arange(BUCKETS), known, out[known])


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), BUCKETS - 1)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, size, rows): compressed blocks of rows as they come; blocks of deleted rows have numbers below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.RecordBatch]] = [[], []]
        sizes, made = [0, 0], 0
        own = TaskContext.get().partitionId() << 32

        def flush(away: int) -> pa.RecordBatch:
            nonlocal made
            rows = pa.Table.from_batches(held[away]).combine_chunks()
            made += 1
            number = own + made
            out = [pa.array([-number if away else number]), pa.array([sizes[away]]), pa.array([_bundle(rows)], pa.binary())]
            held[away], sizes[away] = [], 0
            return pa.RecordBatch.from_arrays(out, names=["block", "size", "rows"])

        for batch in bounded_slices(batches, "text", block_bytes):
            role = batch.column("role").to_numpy(zero_copy_only=False)
            for away in (0, 1):
                part = batch.filter(pa.array((role == 2) == bool(away)))
                if not part.num_rows:
                    continue
                size = sum(map(len, as_bytes(part.column("text")))) + 8 * part.num_rows
                if sizes[away] and sizes[away] + size > block_bytes:
                    yield flush(away)
                held[away].append(part)
                sizes[away] += size
        for away in (0, 1):
            if held[away]:
                yield flush(away)

    return docs.mapInArrow(run, "block long, size long, rows binary")


def deleted_interpolation(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS, order: int = 2) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score of every row; learned where train holds."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    kind = docs.schema[doc_id].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[doc_id].dataType)
    deleted = F.pmod(F.xxhash64(doc_id, F.lit("deleted")), F.lit(DELETED)) == 0
    trained = F.coalesce(train, F.lit(False))
    role = F.when(~trained, 0).when(deleted, 2).otherwise(1).cast("byte")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), trained.alias("trained"), role.alias("role"))
    blocks = materialize(_blocks(slim, block_bytes))
    n_blocks, amount = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(0, int(amount // 4 // part_keys).bit_length())
    key_bits = min(63, max(40, int(amount).bit_length() + MARGIN))
    tasks = max(8, max(n_blocks, 1 << bits) // 2)  # of the exchanges: two blocks or ranges each, so that a task reads as much at any size

    def block_of(rows: pa.RecordBatch) -> Block:
        return Block(as_bytes(rows.column("text")), order, key_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                rows = _unbundle(data)
                block = block_of(rows)
                out: dict[int, list] = {}
                for at, (keys, counts) in enumerate(zip(block.keys, block.count(rows.column("role").to_numpy(zero_copy_only=False)), strict=True)):
                    for part, a, b in _ranges(keys, 64 - block.shift[at] - bits):
                        own = keys[a:b]
                        empty = [np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)] * order
                        out.setdefault(part, empty)[3 * at : 3 * at + 3] = [np.r_[own[:1], np.diff(own)], counts[0][a:b], counts[1][a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array([_frame(x) for x in out.values()], pa.binary())], names=["part", "block", "frame"])

    def answer(key, rows):
        """Totals of a range, for each block in the order of its keys: kept and deleted rows apart for deleted blocks, together for others."""
        numbers = rows.column("block").to_pylist()
        frames = [_unframe(x) for x in rows.column("frame").to_pylist()]
        back: list[list[np.ndarray]] = [[] for _ in numbers]
        figures = [0, 0, 0]
        for at in range(order):
            own = [np.cumsum(f[3 * at], dtype=np.uint64) for f in frames]
            ends = np.cumsum([len(x) for x in own]).tolist()
            keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
            kept, away = (np.bincount(inverse, weights=np.concatenate([f[3 * at + k] for f in frames]), minlength=len(keys)).astype(np.uint64) for k in (1, 2))
            both = kept + away
            for k, (a, e) in enumerate(zip([0, *ends], ends, strict=False)):
                back[k] += [kept[inverse[a:e]], away[inverse[a:e]]] if numbers[k] < 0 else [both[inverse[a:e]]]
            if not at:
                figures = [int(both.sum()), int((both > 0).sum()), int(kept.sum())]
        n = len(numbers)
        columns = [pa.array([*numbers, None], pa.int64()), pa.array([key[0].as_py()] * (n + 1), pa.int64()), pa.array([*map(_frame, back), None], pa.binary())]
        return pa.table(columns + [pa.array([None] * n + [x], pa.int64()) for x in figures], names=["block", "part", "frame", "tokens", "types", "kept_tokens"])

    sent = blocks.mapInArrow(send, "part long, block long, frame binary").repartition(tasks, "part")
    answers = materialize(sent.groupBy("part").applyInArrow(answer, "block long, part long, frame binary, tokens long, types long, kept_tokens long"))
    n, v, n_kept = (int(x or 0) for x in answers.where("block is null").agg(F.sum("tokens"), F.sum("types"), F.sum("kept_tokens")).first())
    answers = answers.where("block is not null").select("block", "part", "frame")

    def totals_of(rows, away: bool) -> list[list[np.ndarray]]:
        """For each order the totals in the order of a block's keys: [kept, deleted] for deleted blocks, else [both]."""
        frames = [_unframe(x) for x in rows.sort_by("part").column("frame").to_pylist()]
        width = 2 if away else 1
        return [[np.concatenate([f[at * width + k] for f in frames]).astype(np.float64) for k in range(width)] for at in range(order)]

    def estimates(block: Block, counts: list[np.ndarray], unigram: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        """Mixed estimate of every token by the orders that have weights."""
        mixed = unigram
        for k, weight in enumerate(weights):
            at, place, context = block.grams[k]
            seen = counts[k][context]
            share = np.where(seen > 0, weight[_bucket(seen)], 0.0)
            mixed = mixed.copy()
            mixed[at] = share * counts[k + 1][place] / np.maximum(seen, 1) + (1 - share) * mixed[at]
        return mixed

    def held_out(weights: list[np.ndarray]):
        """Cells of the next order's ratio to the estimate below it, over deleted rows by the counts of the kept ones."""

        def run(rows, found):
            names = ["bucket", "step", "n"]
            if not rows.num_rows:
                return pa.table([pa.array([], pa.int64())] * 3, names=names)
            block = block_of(_unbundle(rows.column("rows")[0].as_py()))
            counts = [x[0] for x in totals_of(found, True)]
            below = estimates(block, counts, (counts[0][block.token] + 1) / (n_kept + v + 1), weights)
            at, place, context = block.grams[len(weights)]
            seen, own = counts[len(weights)][context], counts[len(weights) + 1][place]
            use = seen > 0
            ratio = own[use] / seen[use] / below[at][use]
            with np.errstate(divide="ignore"):
                step = np.where(ratio > 0, np.round(np.log(np.maximum(ratio, 1e-300)) * STEPS), NEVER).astype(np.int64)
            cells, many = np.unique(_bucket(seen[use]) * 100_000 + (step + 20_000), return_counts=True)
            return pa.table([pa.array(cells // 100_000), pa.array(cells % 100_000 - 20_000), pa.array(many.astype(np.int64))], names=names)

        return run

    weights: list[np.ndarray] = []
    some = max(1, tasks // DELETED)
    away = blocks.where("block < 0").select("block", "rows").repartition(some, "block").groupBy("block")
    away_answers = answers.where("block < 0").repartition(some, "block").groupBy("block")
    for _ in range(order - 1):
        cells = away.cogroup(away_answers).applyInArrow(held_out(weights), "bucket long, step long, n long").groupBy("bucket", "step").agg(F.sum("n").alias("n")).collect()  # a bounded grid
        weights = [*weights, fit_weights([(c["bucket"], c["step"], c["n"]) for c in cells])]

    def score(rows, found):
        names = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not rows.num_rows:
            return pa.table([pa.array([], id_type), pa.array([], pa.bool_()), *[pa.array([], pa.int64())] * 3, *[pa.array([], pa.float64())] * 2], names=names)
        number = rows.column("block")[0].as_py()
        rows = _unbundle(rows.column("rows")[0].as_py())
        block = block_of(rows)
        counts = [sum(x[1:], x[0]) for x in totals_of(found, number < 0)]
        own = counts[0][block.token]
        one = (own + 1) / (n + 1 * (v + 1))
        mixed = estimates(block, counts, one, weights)
        known = block.total((own > 0).astype(np.float64)).astype(np.int64)
        return pa.table(
            [rows.column("doc_id"), rows.column("trained"), pa.array(block.ends - block.starts), pa.array(known), pa.array(np.full(rows.num_rows, n)), pa.array(block.total(np.log10(one))), pa.array(block.total(np.log10(mixed)))], names=names
        )

    both = blocks.select("block", "rows").repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block"))
    return both.applyInArrow(score, f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def contract(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learned from rows whose crc32 of the id is not 2 modulo 7."""
    remainder = crc_mod("doc_id", 7)
    found = deleted_interpolation(docs, remainder != 2, order=order)
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
