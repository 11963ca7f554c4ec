import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import spelling
from tests.llm.conftest import make

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    n = Counter()
    for i, text, _ in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_near(words):
    known, near = set(words), defaultdict(set)
    letters = sorted({c for w in words for c in w})
    for w in words:
        for v in {w[:p] + w[p + 1 :] for p in range(len(w))} | {w[:p] + c + w[p + 1 :] for p in range(len(w)) for c in letters}:
            if v != w and v in known:
                near[w].add(v)
                near[v].add(w)
    return near


def brute_variants(n):
    near, form = brute_near(n), {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def typo_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12))) for _ in range(60)]
    base += ["Prefixed" * 3 + w for w in base[:25]] + ["aaaaaaaaaa", "aaaaaaaaa", "aaaaaaaa", "ÀÉÎaaaaÿ", "ÀÉÎaaaÿÿ", "multipl×y÷", "multipl×÷y"]
    weight = [1000 // (k + 1) + 1 for k in range(len(base))]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choices(base, weight, k=rng.randint(1, 120)):
            if rng.random() < 0.1:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcx") + w[p:], w[:p] + rng.choice("abcx") + w[p + 1 :], w.upper()])
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "漢", "\n"]).join(words), "xa"))
    rows += [(None, rows[0][1], "xa"), (None, None, None), (900, None, "x"), (901, "", "x"), (902, "x " * 50000 + "longestword " * 9000, "x"), rows[3], rows[3], (903, "y" * 5000 + " " + "y" * 5001 + " " + "y" * 5000 + "z", "x"), (903, "y" * 5000 + " " + "y" * 5001 + " " + "y" * 5000 + "z", "x")]
    return rows


def test_query_matches_brute_force(spark):
    rows = typo_rows()
    want = brute_variants(brute_counts(rows))
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 30
    assert rows_of(spelling.contract(make(spark, rows))) == want


@pytest.mark.parametrize("chunk_chars, task_chars", [(40, 500), (900, 2000), (10**6, 10**6)])
def test_pairs_across_chunks(spark, chunk_chars, task_chars):
    rng = random.Random(chunk_chars)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(700)} | {"same" * 9 + "".join(rng.choice("ab") for _ in range(7)) for _ in range(90)} | {"é", "éa", "ça", "日本語", "日本", "\U00010400b", "ﬀb"}
    n = {w: rng.choice([1, 2, 30, 400, 5000, 60000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.variants(df, chunk_chars=chunk_chars, task_chars=task_chars)) == brute_variants(n)


def test_trie_pairs_on_small_alphabets():
    for seed in range(60):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice("abé"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 150))})
        lengths = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        u, v = spelling.near_pairs(spelling.trie(chars, np.r_[0, np.cumsum(lengths)[:-1]], lengths))
        got = [(words[a], words[b]) for a, b in zip(u, v, strict=True)]
        want = {(w, v) for w, all_near in brute_near(words).items() for v in all_near if w < v}
        assert len(got) == len(set(got)) and set(got) == want


def test_chain_of_forms_and_ties(spark):
    n = {"abcdefgh": 10_000, "abcdefg": 900, "abcdef": 50, "abcde": 3, "bbcdefgh": 10_000, "cbcdefgh": 4}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert [got["abcde"][c] for c in ("form", "root", "form_n")] == ["abcdef", "abcdefgh", 50]
    assert got["cbcdefgh"]["form"] == "abcdefgh"  # of equally frequent words the first
    assert got["abcdefgh"]["form"] is None and got["abcdefgh"]["n_near"] == 3


def test_no_words(spark, no_docs):
    assert spelling.contract(no_docs).collect() == []
    assert spelling.contract(make(spark, [(1, "short ones only", "x"), (2, None, None)])).collect() == []
