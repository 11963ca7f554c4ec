import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import lm_scoring
from brindle.llm.common import crc_mod
from tests.llm.conftest import make, prose
from tests.llm.test_models_and_matching import WORDS, brute_base


@pytest.mark.parametrize("block, keys", [(1 << 22, 1 << 21), (2000, 100)])
def test_third_order_matches_brute_force(spark, monkeypatch, block, keys):
    """Every score from plain counters; the weights are those that were learned from the deleted rows."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 30)), "x") for i in range(150)] + [(7, "same row here", "x")] * 20 + [(None, "no id at all", "x"), (151, None, "x")]
    learned, seen = lm_scoring.fit_weights, []
    monkeypatch.setattr(lm_scoring, "fit_weights", lambda h: seen.append((h, learned(h))) or seen[-1][1])
    found = lm_scoring.deleted_interpolation(make(spark, rows), crc_mod("doc_id", 7) != 2, block_bytes=block, part_keys=keys, order=3)
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6), r.n_tokens) for r in found.collect())
    two, three = seen[0][1], seen[1][1]
    tokens = [[*WORDS.findall((t or "").lower()), "</s>"] for _, t, _ in rows]
    train = [k for k, (i, _, _) in enumerate(rows) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    grams = [Counter(tuple((["<s>"] + tokens[k])[a : a + n]) for k in train for a in range(n == 1, len(tokens[k]) + 2 - n)) for n in (1, 2, 3)]
    n, v = sum(grams[0].values()), len(grams[0])
    want = []
    for (i, _, _), own in zip(rows, tokens, strict=True):
        total, marked = 0.0, ["<s>", *own]
        for a in range(1, len(marked)):
            p = (grams[0][marked[a],] + 1) / (n + v + 1)
            c = len(train) if a == 1 else grams[0][marked[a - 1],]
            if c:
                share = two[min(int(math.log2(c)), lm_scoring.BUCKETS - 1)]
                p = share * grams[1][marked[a - 1], marked[a]] / c + (1 - share) * p
            if a > 1 and (c := grams[1][marked[a - 2], marked[a - 1]]):
                share = three[min(int(math.log2(c)), lm_scoring.BUCKETS - 1)]
                p = share * grams[2][tuple(marked[a - 2 : a + 1])] / c + (1 - share) * p
            total += math.log10(p)
        want.append((i is None, i or 0, round(total, 6), len(own)))
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted(want)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))


def test_base_is_the_same_at_every_order(docs, rows):
    r = lm_scoring.contract(docs, order=3).toPandas()
    assert sorted(zip(r.n_tokens, r.n_known, r.train_tokens, r.base_score.round(5), strict=True)) == sorted(brute_base(rows))


def test_third_order_is_no_worse_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    two, three = (lm_scoring.contract(docs, order=k).where("held_out").agg(F.sum("score")).first()[0] for k in (2, 3))
    assert three >= two - 1e-6


def test_frames_round_trip():
    import numpy as np

    arrays = [np.array([1, 2**63, 5], np.uint64), np.zeros(0, np.uint32), np.array([7, 2**31], np.uint32)]
    for a, b in zip(arrays, lm_scoring._unframe(lm_scoring._frame(arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_no_rows_at_order_three(no_docs):
    assert lm_scoring.contract(no_docs, order=3).count() == 0
    with pytest.raises(ValueError):
        lm_scoring.contract(no_docs, order=4)
