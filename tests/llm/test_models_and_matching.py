import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontamination, lm_scoring, quality_classifier, url_filter
from brindle.llm.common import crc_mod
from tests.llm.conftest import make, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# decontamination


def bag(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]
    return Counter(grams)


def plain(text):
    return [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in WORDS.findall(text or "")) if w]


def brute_matches(rows, items, least=0.8):
    out = {}
    for n, (_, text) in enumerate(rows):
        words = plain(text)
        for item, body in items:
            own = plain(body)
            if own and len(words) >= len(own):
                want = bag(own)
                best = max(sum((bag(words[i : i + len(own)]) & want).values()) / sum(want.values()) for i in range(len(words) - len(own) + 1))
                if best >= least:
                    out[n, item] = best
    return out


def test_windows_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, prose(rng, rng.randint(18, 60), vocabulary)) for k in range(12)] + [(50, "three short words"), (51, ""), (52, None), (53, "same " * 12), (54, "same " * 12)]
    rows = []
    for i in range(60):
        body = prose(rng, rng.randint(0, 80), vocabulary).split()
        planted = items[i % 12][1].split()
        for _ in range(i // 12):
            planted[rng.randrange(len(planted))] = rng.choice(vocabulary)
        if i % 5:
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if i % 3 == 0 else w for w in planted]
        rows.append((i, " ".join(body)))
    rows += [(60, "a Three, short  WORDS b"), (61, "same " * 30), (62, None), (63, ""), (None, items[0][1]), (64, items[0][1]), (64, items[0][1]), (65, prose(rng, 20000, vocabulary) + " " + items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(spark, [(i, t, "x") for i, t in rows])
    got = decontamination.contaminated(docs, bench).collect()
    want = brute_matches(rows, items)
    assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got), key=repr) == sorted(((rows[n][0], k, round(s, 9)) for (n, k), s in want.items()), key=repr)
    blocks = decontamination.contaminated(docs, bench, block_bytes=200)
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, got))
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len({n for n, _ in want})


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 40).astype(np.uint64)
    size = decontamination.Size(list(range(40)), [{}] * 40, fps)
    probes = []
    for f in fps.tolist():
        for d in (0, 5, 17, 23, 24):
            x = f
            for p in rng.choice(64, d, replace=False).tolist():
                x ^= 1 << p
            probes.append(x)
    probes = np.array(probes, np.uint64)
    w, i, far = size.near(probes, 23)
    want = {(a, b) for a in range(len(probes)) for b in range(40) if int(np.bitwise_count(probes[a] ^ fps[b])) <= 23}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want
    with pytest.raises(ValueError):
        decontamination.Index([], radius=24)


def test_decontamination_without_rows(spark, no_docs, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.keep_clean(docs, none).count() == docs.count()
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contaminated(no_docs, one).count() == 0


# language model


def brute_base(rows):
    tokens = [[*WORDS.findall((t or "").translate(LOW)), None] for _, t, _ in rows]
    counts = Counter(x for (i, _, _), own in zip(rows, tokens, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for x in own)
    n, v = sum(counts.values()), len(counts)
    return [(len(own), sum(counts[x] > 0 for x in own), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own), 5)) for own in tokens]


@pytest.mark.parametrize("block, keys", [(1 << 22, 1 << 21), (3000, 100)])
def test_language_model_base_matches_brute_force(docs, rows, block, keys):
    r = lm_scoring.deleted_interpolation(docs, crc_mod("doc_id", 7) != 2, block_bytes=block, part_keys=keys).toPandas()
    got = sorted(zip(r.n_tokens, r.n_known, r.train_tokens, r.base_score.round(5), strict=True))
    assert got == sorted(brute_base(rows))


def test_language_model_is_normalised_and_better_than_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_scoring.contract(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[1] < r[0] < 0 and (r[0] - r[1]) / r[2] > 0.2


def test_language_model_scores_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 30)), "x") for i in range(150)]
    docs = make(spark, rows)
    seen = {}
    fit = lm_scoring.fit_weights
    try:
        lm_scoring.fit_weights = lambda h: seen.setdefault("w", fit(h))
        got = {r.doc_id: r.score for r in lm_scoring.contract(docs).collect()}
    finally:
        lm_scoring.fit_weights = fit
    w = seen["w"]
    tokens = {i: [*WORDS.findall(t.translate(LOW)), "</s>"] for i, t, _ in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(x for i in train for x in tokens[i])
    two = Counter(p for i in train for p in zip(["<s>", *tokens[i]], tokens[i], strict=False))
    n, v = sum(one.values()), len(one)
    for i, own in tokens.items():
        total = 0.0
        for u, x in zip(["<s>", *own], own, strict=False):
            c = len(train) if u == "<s>" else one[u]
            share = w[min(int(math.log2(c)), lm_scoring.BUCKETS - 1)] if c else 0.0
            total += math.log10(share * (two[u, x] / c if c else 0) + (1 - share) * (one[x] + 1) / (n + v + 1))
        assert abs(total - got[i]) < 1e-6


def test_expectation_maximisation_finds_the_best_weight():
    cells = [(3, lm_scoring.NEVER, 40), (3, 16, 100), (3, -8, 30)]
    w = lm_scoring.fit_weights(cells, 2000)[3]
    def gain(x):
        return sum(n * math.log(x * (0 if s == lm_scoring.NEVER else math.exp(s / lm_scoring.STEPS)) + 1 - x) for _, s, n in cells)
    assert gain(w) >= max(gain(k / 1000) for k in range(1, 1000)) - 1e-6
    assert (lm_scoring.fit_weights([]) == 0.5).all()


def test_language_model_without_rows(no_docs):
    assert lm_scoring.contract(no_docs).count() == 0


# quality classifier


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = quality_classifier.contract(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = r.score[r.quality == 1].to_numpy(), r.score[r.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (r.predicted == r.quality).mean() > 0.93


def test_classifier_edges(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, int(t is not None and "&&&" not in t), 0) for i, t, _ in rows if i is not None] + [(1, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    r = quality_classifier.contract(docs, labels).toPandas()
    assert len(r) == len(rows) and r.score.between(0, 1).all() and ((r.score >= 0.5) == (r.predicted == 1)).all()
    assert quality_classifier.contract(no_docs, labels).count() == 0
    none = labels.where("false")
    assert {x.score for x in quality_classifier.contract(docs, none).collect()} == {0.5}


def test_indicators_are_distinct():
    f = quality_classifier.Features(1 << 10)
    own = f.of([b"a b a b a b", b"", b"xyz"])
    assert all(len(set(x.tolist())) == len(x) for x in own) and len(own[1]) == 0
    assert set(f.of([b"a b a b a b"])[0].tolist()) == set(own[0].tolist())


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 200)
    cells = [np.unique(np.r_[rng.integers(0, 40, 10), 50 if y else 51]) for y in labels]
    values = np.ones(60)
    w = quality_classifier.descend(cells, labels, values, cost=1.0, epochs=40)
    assert all((w[c].sum() / math.sqrt(len(c)) + w[-1] > 0) == (y > 0) for c, y in zip(cells, labels, strict=True))


# URL filter

RULES = url_filter.RULES


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOW)
    fit = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


URLS = [
    "http://example.org/es/1", "https://a.EXAMPLE.org/en/12?x=/es/", "http://notexample.org/es/", "http://x.com/fr/1#a", "http://com/de/", "http://x.com/de", "http://x.net/", "http://org", "HTTP://a.org?q=1", "http://a.org/", "no scheme", "",
    None, "://x.com/de/3", "http://example.org/en/1://b", "ftp://u:p@h.com:80/fr/x?y", "http://É.ORG/é", "http://a.b/c\nd?e",
]


def test_fixed_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "v", "c") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None, None), (0, URLS[0], "h", "v", "c")], "page_id long, url string, host string, verdict string, block string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.contract(pages, labels).collect()), key=repr)
    want = []
    for i, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]:
        host, path, rule = brute_url(u)
        want.append((i, host, path, rule, dict(RULES).get(rule, "allow")))
    assert got == sorted(want, key=repr)
    assert url_filter.contract(pages.where("false"), labels).count() == 0


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['casino', 'news', 'shop'])}.{rng.choice(['win', 'day'])}.net/{rng.choice(['bet', 'read'])}/{rng.randint(1, 9)}" for _ in range(400)]
    bad = [("casino" in u and "bet" in u) or "win" in u and rng.random() < 0.3 for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if i < 300] + [(5000, True), (1, None)], "page_id long, block boolean")
    got = {r.page_id: (r.verdict, r.confidence) for r in url_filter.url_filter(pages, labels, min_support=0.01, min_confidence=0.7).collect()}

    def tokens(u):
        host, path, _ = brute_url(u)
        return {f"host:{x}" for x in re.split(r"[.\-:]", host) if x} | {"path:" + ("#" if x.isdigit() else x) for x in re.split(r"[/.\-_]", path.lower()) if x}

    baskets = [(tokens(u), b) for u, b in zip(urls, bad, strict=True)][:300]
    from itertools import combinations

    rules, every = {}, sorted(set().union(*(t for t, _ in baskets)))
    for n in range(1, 6):
        for c in combinations(every, n):
            own = [b for t, b in baskets if set(c) <= t]
            if own and sum(own) >= 0.01 * 300 and sum(own) / len(own) >= 0.7:
                rules[frozenset(c)] = sum(own) / len(own)
    for i, u in enumerate(urls):
        fit = [c for r, c in rules.items() if r <= tokens(u)]
        verdict, confidence = got[i]
        assert verdict == ("block" if fit else "allow")
        assert not fit or abs(confidence - max(fit)) < 1e-9


def test_long_and_repeated_urls_are_mined_whole(spark):
    """30-token URLs, alone and repeated, with every row a possible rule; verdicts as by brute force over rules of three tokens."""
    import time
    from itertools import combinations

    rng = random.Random(6)
    words = [f"t{k}" for k in range(40)]
    urls = ["http://bad.long.net/" + "/".join(words[:30])] * 12
    urls += [f"http://{rng.choice(['bad', 'ok'])}.net/" + "/".join(rng.sample(words, rng.randint(1, 6))) for _ in range(60)]
    urls += ["http://bad.net/" + "/".join(rng.sample(words, 30)) for _ in range(8)]
    bad = ["bad" in u and rng.random() < 0.9 for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(enumerate(bad)), "page_id long, block boolean")
    began = time.time()
    got = {r.page_id: (r.verdict, r.confidence) for r in url_filter.url_filter(pages, labels, min_support=0.0, min_confidence=0.8, min_rows=6).collect()}
    assert time.time() - began < 60
    tokens = [frozenset({f"host:{x}" for x in brute_url(u)[0].split(".")} | {f"path:{x}" for x in brute_url(u)[1].split("/") if x}) for u in urls]
    rules = {}
    for t in set(tokens):
        for n in (1, 2, 3):
            for c in combinations(sorted(t), n):
                if c not in rules:
                    own = [b for t2, b in zip(tokens, bad, strict=True) if t2.issuperset(c)]
                    rules[c] = sum(own) / len(own) if sum(own) >= 6 and sum(own) >= 0.8 * len(own) else 0.0
    for i, t in enumerate(tokens):
        best = max(rules[c] for n in (1, 2, 3) for c in combinations(sorted(t), n))
        assert got[i][0] == ("block" if best else "allow")
        assert not best or abs(got[i][1] - best) < 1e-9


def test_one_long_url_takes_no_time(spark):
    import time

    urls = [f"http://h{k}.net/p{k % 7}/q" for k in range(100)] + ["http://x.net/" + "/".join(f"w{k}" for k in range(30))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0 or i == 100)) for i in range(101)], "doc_id long, quality int, toxic int")
    began = time.time()
    assert url_filter.contract(pages, labels).count() == 101
    assert url_filter.url_filter(pages, labels.selectExpr("doc_id as page_id", "toxic = 1 as block")).count() == 101
    assert time.time() - began < 40


def test_fixed_rules_need_floor_of_rows(spark):
    pages = spark.createDataFrame([(i, f"http://spam.net/x{i}") for i in range(19)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(19)], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in url_filter.contract(pages, labels).collect()} == {"allow"}
    more = pages.union(spark.createDataFrame([(19, "http://spam.net/x19")], pages.schema))
    marks = labels.union(spark.createDataFrame([(19, 0, 1)], labels.schema))
    assert {r.verdict for r in url_filter.contract(more, marks).collect()} == {"block"}


def _edited(rng, words, vocabulary, lost, scattered):
    """A copy with about so many of its five-word shingles lost, by single words or by one run."""
    words = list(words)
    n = len(words)
    if scattered:
        for at in rng.sample(range(2, n - 2), max(1, int(lost * (n - 4)) // 5)):
            words[at] = rng.choice(vocabulary)
    else:
        run = max(1, int(lost * (n - 4)) - 4)
        at = rng.randrange(0, n - run + 1)
        words[at : at + run] = [rng.choice(vocabulary) for _ in range(run)]
    return words


def test_the_multi_index_selects_and_keeps_the_recall(spark):
    """Recall against brute force on edits near the threshold, and the share of random pairs that become candidates."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([30, 45, 60, 90, 120])))) for k in range(60)]
    rows = []
    for i in range(600):
        words = _edited(rng, items[i % 60][1].split(), vocabulary, rng.uniform(0.05, 0.2), i % 2 == 0)
        rows.append((i, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), *words, *(rng.choice(vocabulary) for _ in range(30))])))
    index = decontamination.Index([(i, t.encode()) for i, t in items])
    got = set()
    for r, keys, grams, hits in decontamination._hits([t.encode() for _, t in rows], index):
        got |= {(r, x[0]) for x in index.search(keys, grams, hits)}
    want = set()
    for n, (_, text) in enumerate(rows):
        words, own = plain(text), plain(items[n % 60][1])
        target = bag(own)
        if max(sum((bag(words[i : i + len(own)]) & target).values()) / sum(target.values()) for i in range(len(words) - len(own) + 1)) >= 0.8:
            want.add((n, n % 60))
    assert len(want) > 400 and got <= want | (got - want) and not got - want
    assert len(got & want) >= 0.97 * len(want)
    some = np.random.default_rng(1).integers(0, 2**63, (400, decontamination.HASHES)).astype(np.uint64) * np.uint64(2)
    size = decontamination.Size(list(range(200)), [{}] * 200, some[:200])
    assert len(size.candidates(some[200:], decontamination.RADIUS)[0]) < 0.05 * 200 * 200


def test_short_documents_and_short_items(spark):
    """A document that is an item less some words; items under five words in a long text without a loop over words."""
    import time

    rng = random.Random(2)
    body = [f"u{i}" for i in range(40)]
    items = [(1, " ".join(body)), (2, "three word item"), (3, "three word item"), (4, "one"), (5, "w1 w2 w3 w4")]
    long = " ".join(f"x{rng.randrange(9999)}" for _ in range(20_000))
    rows = [(1, " ".join(body[:36]), "x"), (2, " ".join(body[4:]), "x"), (3, " ".join(body[:20]), "x"), (4, long + " Three, word item", "x"), (5, "w1 w2 w3 w4", "x"), (6, "w1 w2 w3", "x")]
    index = decontamination.Index([(i, t.encode()) for i, t in items])
    began = time.process_time()
    for _ in range(10):
        list(decontamination._hits([rows[3][1].encode()], index))
    assert time.process_time() - began < 1.5
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontamination.contaminated(make(spark, rows), bench).collect())
    assert got == [(1, 1, round(32 / 34, 6)), (2, 1, round(32 / 34, 6)), (4, 2, 1.0), (4, 3, 1.0), (5, 5, 1.0)]


def test_many_items_of_one_length(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(25))) for k in range(4000)]
    index = decontamination.Index([(i, t.encode()) for i, t in items])
    text = " ".join(rng.choice(vocabulary) for _ in range(200)) + " " + items[77][1] + " " + " ".join(rng.choice(vocabulary) for _ in range(200))
    found = [x for r, k, g, h in decontamination._hits([text.encode()], index) for x in index.search(k, g, h)]
    assert [(x[0], x[1], x[3]) for x in found] == [(77, 200, 1.0)]
