import math
import random

import numpy as np
import pytest

from brindle.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int, score double, cell long, chunk long, uid long, anchor long, slot int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, 5) for r in rows], KIND)


def brute(rows):
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        own.append((i, [int(math.floor(256 * float(np.float32(x)))) for x in v], label))
    top = (1 << 63) - 1
    out = []
    for a, (i, v, label) in enumerate(own):
        if i is None or i % 50:
            continue
        scored = [(-max(-top - 1, min(top, sum(x * y for x, y in zip(v, w)))), j is None, j or 0, k, j) for k, (j, w, _) in enumerate(own) if k != a]
        near = sorted(s for s in scored if own[s[3]][2] == label)[:5]
        far = sorted(s for s in scored if own[s[3]][2] != label)
        for p in near:
            good = [s for s in far if 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(i, p[4], r + 1, s[4], -p[0], -s[0]) for r, s in enumerate(good)]
    return sorted(out, key=repr)


def mined(spark, rows):
    return sorted((tuple(r) for r in hn.contract(table(spark, rows)).collect()), key=repr)


def clusters(rng, n, dim, spread=0.3, centres=6):
    middle = rng.normal(size=(centres, dim))
    return (middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def odd_rows():
    rng = np.random.default_rng(3)
    x = clusters(rng, 700, 6)
    rows = [(int(i), x[i].tolist(), int(rng.integers(0, 4))) for i in range(700)]
    hot = x[5].tolist()
    rows += [(1000 + k, hot, k % 3) for k in range(250)]  # one vector, a quarter of the rows, and its ties
    rows += [(50, x[9].tolist(), 1), (50, x[9].tolist(), 1), rows[100], rows[100]]
    rows += [(None, x[3].tolist(), 1), (None, x[3].tolist(), 2), (None, hot, 0), (2000, None, 1), (2050, [0.0, float("nan"), 1.0, 1.0, 1.0, 1.0], 1), (2100, [0.0, float("inf"), 1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(2150, [0.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2200, x[2].tolist(), None), (2250, [], 1), (2300, [0.5, -0.25], 2), (2350, [0.0] * 6, 9), (-50, x[7].tolist(), 3)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [40, 1024])
def test_mining_matches_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(hn, "LEAST_CHUNK", least)
    monkeypatch.setattr(hn, "CHUNK", max(60, least))
    rows = odd_rows()
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_whole_trees_and_high_dimension(spark):
    rng = np.random.default_rng(8)
    x = clusters(rng, 2500, 24, 0.6, 20)
    rows = [(int(i), x[i].tolist(), int(rng.integers(0, 10))) for i in range(len(x))]
    assert mined(spark, rows) == brute(rows)


def test_products_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 25, (rng.normal(size=3) * 10.0 ** rng.integers(0, 7)).astype(np.float32).tolist(), i % 3) for i in range(60)]
    got, want = mined(spark, rows), brute(rows)
    assert max(abs(r[4]) for r in want) > 2**53
    assert [r[:3] for r in got] == [r[:3] for r in want] and got == want
    assert mined(spark, [(i, [3e38, -3e38], i % 2) for i in range(0, 200, 25)]) is not None


def test_empty_and_lone_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0, 0.0], 1)]) == []
    assert mined(spark, [(51, [1.0, 0.0], 1), (52, [1.0, 0.0], 2)]) == []
    assert mined(spark, [(50, [0.0], 1), (51, [0.0], 1), (52, [0.0], 2)]) == [(50, 51, 1, 52, 0, 0)]


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(0)
    a, c = hn.Tree(clusters(rng, 900, 5, 0.05), 16), hn.Tree(clusters(rng, 900, 5, 0.05), 16)
    rng = np.random.default_rng(0)
    x, y = clusters(rng, 900, 5, 0.05), clusters(rng, 900, 5, 0.05)
    p, q, low, high = hn.surviving(a, c, lambda x, y, lo, hi: hi >= 8)
    leaves = (a.left < 0).sum() * (c.left < 0).sum()
    assert 0 < len(p) < leaves / 2  # most leaf pairs fall with the nodes above them
    score = x[a.order].astype(float) @ y[c.order].astype(float).T
    seen = np.zeros(score.shape, bool)
    for i, j, lo, hi in zip(p, q, low, high, strict=True):
        part = score[a.start[i] : a.end[i], c.start[j] : c.end[j]]
        assert lo <= part.min() and part.max() <= hi
        seen[a.start[i] : a.end[i], c.start[j] : c.end[j]] = True
    assert (score[~seen] < 8).all()
