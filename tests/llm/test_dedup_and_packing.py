import random
import re
import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer

from brindle.llm import packing, simhash_dedup
from brindle.llm.tokens import ByteBpe, vocabulary_path
from tests.llm.conftest import make

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    w = WORDS.findall((text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check_components(rows, got):
    fps = [brute_fp(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _, _), f, r in zip(rows, fps, roots, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_near_duplicates_match_brute_force(docs, rows):
    check_components(rows, simhash_dedup.near_duplicates(docs).collect())


def test_near_copies_and_chains(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        w = [rng.choice(words) for _ in range(300)]
        for k in range(12):
            v = list(w)
            for _ in range(k % 4):
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((g * 100 + k, " ".join(v), "x"))
    check_components(rows, simhash_dedup.near_duplicates(make(spark, rows)).collect())


def test_buckets_of_all_sizes_match_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(12):
        base, fps = int(rng.integers(0, 2**63)), set()
        while len(fps) < 150:
            x = base
            for p in rng.choice(64 if trial % 2 else 12, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(p) * (1 if trial % 2 else 3)
            fps.add(x)
        own = sorted(fps)
        rows = []
        for v, h in enumerate(simhash_dedup._HIDDEN):
            for f in own:
                rows += [(v, f & ~h, f)] + [(v, f & ~h ^ 1 << p, f) for p in range(64) if not h >> p & 1]
        rows.sort()
        v, k, f = np.array([r[0] for r in rows], np.int8), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows], np.uint64)
        for small, pairs in ((2, 4), (2, 2048), (32, 2048)):
            monkeypatch.setattr(simhash_dedup, "_SMALL", small)
            monkeypatch.setattr(simhash_dedup, "_ALL_PAIRS", pairs)
            a, b = simhash_dedup._bucket_links(v, k, f)
            place = {x: i for i, x in enumerate(own)}
            sets = simhash_dedup._Sets(len(own))
            sets.join(np.array([place[x] for x in a.tolist()], int), np.array([place[x] for x in b.tolist()], int))
            assert [sets.find(i) for i in range(len(own))] == brute_components(own)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.root for r in simhash_dedup.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_no_documents(no_docs):
    assert simhash_dedup.near_duplicates(no_docs).count() == 0 and simhash_dedup.keep_one(no_docs).count() == 0
    assert packing.best_fit_packing(no_docs).count() == 0


def test_one_of_each_group_stays(docs, rows):
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    roots = brute_components([brute_fp(t) for _, t, _ in rows])
    groups = {}
    for (i, t, _), r in zip(rows, roots, strict=True):
        groups.setdefault(r, []).append(i)
    want = sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    parts = [" ", " ", "a", "Bc", "\n", "\t", "\xa0", " ", "é", "1", "!", "'s", "​", "\x1c", "\x85", "漢", "<|endoftext|>", "　", "word", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x" * 5000, " " * 3000]
    bpe = ByteBpe.shared("byte_bpe_50k.json")
    for x in texts:
        assert bpe.ids(x.encode()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_packing_round_trip(docs, rows):
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = packing.best_fit_packing(docs, length=256).toPandas()
    want = []
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 256 if len(ids) > 256 else len(ids)
        starts = [0, *range(first, len(ids), 256)] if first else list(range(0, len(ids), 256))
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else len(ids)
            want.append((i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
    assert sorted([(None if i != i else i, *r) for i, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)], key=repr) == sorted(want, key=lambda x: repr((None if x[0] is None else float(x[0]), *x[1:])))
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert (bin_.length.cumsum() - bin_.length == bin_.offset).all() and bin_.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.1 * -(-got.length.sum() // 256)


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert fit.place(6) == (0, 0) and fit.place(7) == (1, 0)
    assert fit.place(3) == (1, 7) and fit.place(4) == (0, 6)
    assert fit.open == 0
    fit.place(6), fit.place(8)
    assert fit.place(9) == (4, 0)  # the bin with 8 closed
    assert fit.place(2) == (2, 6) and fit.place(2) == (2, 8)
    rng, plain = random.Random(2), []
    fit = packing.BestFit(100, 10**9)
    for n in [rng.randint(1, 100) for _ in range(3000)]:
        number, offset = fit.place(n)
        best = min((x for x in range(len(plain)) if plain[x] >= n), key=lambda x: plain[x], default=None)
        if best is None:
            plain.append(100)
            assert number == len(plain) - 1
            best = number
        assert plain[number] == plain[best] and offset == 100 - plain[number]
        plain[number] -= n


def test_the_closing_rule_is_in_force_through_the_query(spark):
    """With few open bins every sequence is what a plain list of open bins makes of the same stream, and bins do close."""
    rng = random.Random(8)
    items = spark.createDataFrame([(i, rng.randint(1, 60)) for i in range(2000)] + [(5, 30)] * 500, "doc_id long, length int")
    by_bins = {}
    for open_bins in (3, 40, 1024):
        rows = packing.pack(items, length=100, open_bins=open_bins, group_items=10**6).collect()
        assert len(rows) == 2500
        open_, closed = {}, 0
        for r in rows:  # one group: the rows come in the stream's order
            number, n = r.sequence_id & (1 << 36) - 1, r.length
            fits = [left for left in open_.values() if left >= n]
            if fits:
                assert open_[number] == min(fits) and r.offset == 100 - min(fits)
            else:
                assert number not in open_ and r.offset == 0
                if len(open_) >= open_bins:
                    least = min(open_.values())
                    gone = [k for k, left in open_.items() if left == least]
                    again = {x.sequence_id & (1 << 36) - 1 for x in rows[rows.index(r) :]} if len(gone) > 1 else set()
                    del open_[next((k for k in gone if k not in again), gone[-1])]
                    closed += 1
                open_[number] = 100
            open_[number] -= n
            if not open_[number]:
                del open_[number]
            assert len(open_) <= open_bins
        by_bins[open_bins] = len({r.sequence_id for r in rows}), closed
    assert by_bins[3][1] > 0 and by_bins[40][1] > 0
    assert by_bins[3][0] >= by_bins[40][0] >= by_bins[1024][0]


def test_repeated_rows_spread_over_the_groups(spark):
    items = spark.createDataFrame([(1, 7)] * 6000, "doc_id long, length int")
    groups = {}
    for r in packing.pack(items, length=100, open_bins=16, group_items=1000).collect():
        groups[r.sequence_id >> 36] = groups.get(r.sequence_id >> 36, 0) + 1
    assert len(groups) == 6 and max(groups.values()) < 1300


def test_few_sequences_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = packing.best_fit_packing(docs).agg({"length": "sum", "sequence_id": "count"}).first()
    made = packing.best_fit_packing(docs).select("sequence_id").distinct().count()
    assert made <= 1.002 * got["sum(length)"] / 1024
