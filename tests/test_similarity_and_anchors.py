"""Topic anchors and combined name similarity against plain loops."""

import math
import random
from collections import Counter

from brindle.operators import rank, texts


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def brute_anchors(rows, k):
    rows = sorted((key, unit(v)) for key, v in rows if v is not None)
    chosen = rows[:1]
    while len(chosen) < min(k, len(rows)):
        rest = [r for r in rows if r not in chosen]
        chosen.append(min(rest, key=lambda r: (max(round(sum(x * y for x, y in zip(r[1], c[1])), 12) for c in chosen), r[0])))
    return [key for key, _ in chosen]


def test_anchors_are_the_farthest_points(spark):
    rng = random.Random(2)
    groups = {g: [(100 * g + i, None if rng.random() < 0.1 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)] for g, n in ((1, 40), (2, 3), (3, 1), (4, 80))}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows] + [(None, 9000, [1.0] * 6)], "g long, k long, v array<double>")
    got = {}
    for r in rank.anchors(df, "g", "k", "v", 5).orderBy("place").collect():
        got.setdefault(r.g, []).append(r.k)
    assert got == {g: brute_anchors(rows, 5) for g, rows in groups.items() if brute_anchors(rows, 5)} | {None: [9000]}


def jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, hit_a, hit_b = max(0, max(len(a), len(b)) // 2 - 1), [], [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == c:
                hit_b[j] = True
                hit_a.append(c)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(hit_a, [b[j] for j in range(len(b)) if hit_b[j]])) // 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + p * 0.1 * (1 - j)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def bigram_cosine(a, b):
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    size = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    return sum(n * y[g] for g, n in x.items()) / size if size else 0.0


def test_combined_name_similarity(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12))), "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))) for _ in range(200)] + [("martha", "marhta"), ("dixon", "dicksonx"), ("same", "same"), ("in", "within")]
    got = {r.i: r for r in texts.name_similarity(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string"), "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        mixed = 0.5 * jaro_winkler(a, b) + 0.3 * (1 - edits(a, b) / max(len(a), len(b))) + 0.2 * bigram_cosine(a, b)
        assert abs(got[i].combined - (1.0 if a == b else 0.9 if a in b or b in a else mixed)) < 1e-6
        assert abs(got[i].jaro_winkler - jaro_winkler(a, b)) < 1e-9
