"""The fitted models against independent counts and optimality conditions."""

import math
import random
from collections import Counter

import numpy as np

from brindle.llm import language_id, quality_classifier
from tests.llm.conftest import make, prose


def test_language_scores_match_brute_force(spark):
    """Counts, smoothing and back-off recomputed from strings; held against every row's prediction."""
    rng = random.Random(7)
    vocabularies = {"xa": ["bana", "keli", "toram", "minas", "sudo"], "xb": ["quorn", "zelt", "wympf", "minas", "keld"]}
    rows = [(i, prose(rng, rng.randint(5, 40), vocabularies[lang]), lang) for i in range(80) for lang in [rng.choice(["xa", "xb"])]]
    rows += [(100, "banaz zeltow minask", None), (101, "unseen qqq keldt", None), (102, "Bana, 12 ZELT!", None)]
    docs = make(spark, rows)
    counts = {lang: Counter(w for i, t, x in rows if x == lang for w in (language_id.normal(v.encode()) for v in t.split()) if w) for lang in vocabularies}

    def logs(kind):
        every = set().union(*kind.values())
        total = {x: sum(kind[x].values()) + 0.5 * len(every) for x in kind}
        return {g: [math.log((kind[x][g] + 0.5) / total[x]) for x in sorted(kind)] for g in every}

    words = logs(counts)
    gram = {}
    for n in language_id.ORDERS:
        by = {x: Counter() for x in counts}
        for x, own in counts.items():
            for w, c in own.items():
                for g in language_id.grams(w, n):
                    by[x][g] += c
        gram[n] = logs(by)

    def row(w):
        if w in words:
            return words[w]
        for n in language_id.ORDERS:
            seen = [gram[n][g] for g in language_id.grams(w, n) if g in gram[n]]
            if seen:
                return [sum(x) / len(seen) for x in zip(*seen, strict=True)]
        return [0.0, 0.0]

    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(docs).collect()}
    for i, t, _ in rows:
        total = [sum(x) for x in zip(*(row(w) for w in map(language_id.normal, t.encode().split()) if w), strict=True)]
        best = max(range(2), key=lambda k: (total[k], -k))
        assert got[i][0] == sorted(counts)[best]
        assert abs(got[i][1] - 1 / sum(math.exp(x - total[best]) for x in total)) < 1e-5


def test_bounds_of_the_language_model(spark):
    rng = random.Random(1)
    docs = make(spark, [(i, prose(rng, 50), "xa") for i in range(50)] + [(i, prose(rng, 50), "xb") for i in range(50, 300)])
    m = language_id.fit(docs, docs_per_language=40, words_per_language=5)
    assert len(m.tables[0].keys) <= 10 and m.languages == ["xa", "xb"]
    full = language_id.fit(docs)
    assert len(full.tables[0].keys) > 10 and all(len(full.tables[n].keys) for n in language_id.ORDERS)


def test_the_store_may_be_cleared(spark, monkeypatch):
    rng = random.Random(2)
    docs = make(spark, [(i, prose(rng, 30), rng.choice(["xa", "xb"])) for i in range(40)])
    model = language_id.fit(docs)
    texts = [r.text.encode() for r in docs.collect()]
    whole = language_id.Scorer(model).predict(texts)
    monkeypatch.setattr(language_id, "STORE", 3)
    scorer = language_id.Scorer(model)
    assert [x for t in texts for x in scorer.predict([t])[0]] == whole[0]


def test_log_count_ratios_are_those_of_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(prose(rng, rng.randint(0, 20)), i % 2) for i in range(60)]
    cells = 1 << 12
    model = quality_classifier.fit(spark.createDataFrame(rows, "text string, quality int"), cells=cells)
    counts = np.ones((2, cells))
    made = quality_classifier.Features(cells)
    for t, y in rows:
        for c in set(made.of([t.encode()])[0].tolist()):
            counts[y, c] += 1
    want = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.values, want, atol=1e-5)


def test_hinge_loss_is_at_its_optimum():
    """The problem is convex: no step in any direction may lower the primal value."""
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, 80)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in labels]
    values = rng.normal(size=30)
    cost = 0.7
    w = quality_classifier.descend(rows, labels, values, cost=cost, epochs=3000)
    share = (labels > 0).mean()
    upper = np.where(labels > 0, cost / (2 * share), cost / (2 * (1 - share)))
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / np.sqrt((values[r] ** 2).sum())
    x[:, 30] = 1
    y = np.where(labels > 0, 1, -1)

    def primal(w):
        return 0.5 * w @ w + (upper * np.maximum(0, 1 - y * (x @ w))).sum()

    own = primal(w)
    for _ in range(3000):
        assert primal(w + rng.normal(size=31) * rng.choice([1e-4, 1e-3, 1e-2, 0.1])) >= own - 1e-7


def test_the_sample_is_bounded_though_rows_repeat(spark):
    rows = [(1, "the very same text", 1)] * 300 + [(i, f"another text {i}", 1) for i in range(2, 60)] + [(i, f"bad text {i}", 0) for i in range(100, 180)]
    made = spark.createDataFrame(rows, "doc_id long, text string, quality int").selectExpr("*", "xxhash64(doc_id, text) as lot")
    for k in (1, 10, 40, 100, 340):
        assert quality_classifier._least(made.where("quality = 1"), k, 358).count() == k
    r = quality_classifier.quality_scores(make(spark, [(i, t, "x") for i, t, _ in rows[:3]]), made.drop("lot"), docs_per_class=20)
    assert r.count() == 3
