"""The semantic prefilter against the same rules in plain loops."""

import math
import random
import re

import pytest

from brindle.operators import prefilter as pf
from brindle.operators.multivector import BINDING, STOP

SPLIT = re.compile(r"""[ \t\n\r.,!?;:"'()\[\]]+""")


def words(text, stop):
    return [w for w in SPLIT.split(text.lower()) if len(w) > 2 and w not in stop]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def brute(segs, keep, sample_size, vectors):
    if len(segs) <= keep:
        return {s[0]: "all" for s in segs}
    n, kind, head, level, text, vec = range(6)
    most = max(50, len(segs) // 7)
    heads = [s for s in segs if s[kind] == "heading"]
    real = [s for s in heads if len(s[text]) < 100 and ("chapter" in s[text].lower() or "section" in s[text].lower() or s[text].startswith("#") or re.match(r"\d+[.)]\s", s[text]) or s[level] <= 3)]
    sure = {s[n] for s in (real[:50] if len(real) >= 5 else heads[:20])}
    sentences, sections = [s for s in segs if s[kind] == "sentence"], {}
    for s in sentences:
        if s[head]:
            sections.setdefault(s[head], []).append(s)
    if len(sections) > 50:
        for i in range(0, len(sentences), max(1, len(sentences) // 30)):
            if len(sure) >= most:
                break
            sure.add(sentences[i][n])
    else:
        for own in sections.values():
            if len(sure) >= most:
                break
            sure |= {own[0][n], own[-1][n]}
    sure |= {s[n] for s in sentences if re.search(BINDING, s[text])}
    sure |= {s[n] for s in [s for s in segs if s[kind] == "quote"][:5]}
    code = [s for s in segs if s[kind] == "code"]
    sure |= {s[n] for s in [s for s in code if any(w in s[text].lower() for w in pf.CODE_WORDS)][:10]}
    seen = set()
    for s in code:
        if s[head] and s[head] not in seen:
            seen.add(s[head])
            sure.add(s[n])
    sample, groups = [s[n] for s in heads], {}
    for s in segs:
        if s[kind] != "heading":
            groups.setdefault(s[head], []).append(s[n])
    share = max(2, int((sample_size - len(sample)) / max(1, len(groups))))
    for own in groups.values():
        if len(own) <= share:
            sample += own
            continue
        sample += [own[0], own[-1]]
        step, i = len(own) // (share - 1), 1
        while i < share - 1 and i * step < len(own) - 1:
            sample.append(own[i * step])
            i += 1
    sample = set(list(dict.fromkeys(sample))[:sample_size])
    picked = [s for s in segs if s[n] in sample]
    tf, df = {}, {}
    for s in picked:
        own = words(s[text], STOP)
        for w in own:
            tf[w] = tf.get(w, 0) + 1
        for w in set(own):
            df[w] = df.get(w, 0) + 1
    top = sorted((w for w in tf if df[w] < len(picked) * 0.8), key=lambda w: (-round(tf[w] * math.log(len(picked) / (df[w] + 1)), 9), w))[:30]
    query = {w for s in segs if s[head] for w in words(s[head], pf.SHORT_STOP)} | {w for w in top if w not in pf.SHORT_STOP}
    docs = {s[n]: words(s[text], pf.SHORT_STOP) for s in segs}
    mean = sum(map(len, docs.values())) / len(docs)
    count = {w: sum(w in set(d) for d in docs.values()) for w in query}
    score = {k: round(sum(math.log((len(docs) - count[w] + 0.5) / (count[w] + 0.5) + 1) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in query if w in d), 6) for k, d in docs.items()}
    titles = {}
    for s in segs:
        titles.setdefault(s[head], []).append(s[n])
    cap = max(10, keep // len(titles))
    cands = sorted((k for own in titles.values() for k in sorted(own, key=lambda k: (-score[k], k))[:cap]), key=lambda k: (-score[k], k))[: 2 * keep]
    out = {k: "guaranteed" for k in sure} | {k: "sample" for k in sample - sure}
    for k in cands:
        if len(out) >= keep:
            break
        out.setdefault(k, "score")
    if len(out) < keep:
        vocab = {}
        for s in picked:
            for w in words(s[text], pf.SHORT_STOP):
                vocab[w] = vocab.get(w, 0) + 1
        pool = [s[vec] for s in picked if s[vec] is not None]
        anchor = pool[:1]
        while len(anchor) < min(5, len(pool)):
            anchor.append(max((v for v in pool if v not in anchor), key=lambda v: min(1 - cosine(v, a) for a in anchor)))

        def like(s):
            if vectors and s[vec] is not None and anchor:
                return round(max(cosine(s[vec], a) for a in anchor), 9)
            own = [w for w in re.split(r"""[ \t\n\r.,!?;:"'()]+""", s[text].lower()) if w]
            return round(min(1.0, sum(math.log(1 + vocab[w]) for w in own if w in vocab) / math.sqrt(len(own)) / 3), 9) if own else 0.0

        rest = sorted((s for s in segs if s[n] not in out), key=lambda s: (-like(s), s[n]))
        out |= {s[n]: "fill" for s in rest[: keep - len(out)]}
    return out


def document(rng, size, sections):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)] + ["must stay", "the", "docker run ", "50% ", "warning"]
    out, head, level = [], "", 0
    for n in range(1, size + 1):
        if rng.random() < sections / size:
            level = rng.randint(1, 5)
            head = rng.choice(["Chapter ", "", "1. "]) + " ".join(rng.choices(vocabulary[:60], k=2))
            out.append((n, "heading", head, level, head, [rng.gauss(0, 1) for _ in range(3)]))
            continue
        kind = rng.choice(["sentence"] * 8 + ["code", "quote", "list"])
        out.append((n, kind, head, level, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12))), None if rng.random() < 0.3 else [rng.gauss(0, 1) for _ in range(3)]))
    return out


@pytest.mark.parametrize("vectors", [False, True])
def test_prefilter_by_plain_loops(spark, vectors):
    rng = random.Random(11)
    docs = {1: document(rng, 130, 6), 2: document(rng, 20, 2), 3: document(rng, 260, 90), 4: document(rng, 90, 0), 5: document(rng, 150, 30), 6: document(rng, 1, 0)}
    rows = [(d, *s) for d, segs in docs.items() for s in segs]
    df = spark.createDataFrame(rows, "doc_id long, n long, type string, heading string, level int, text string, vector array<double>")
    df = df if vectors else df.drop("vector")
    for keep, sample in ((110, 20), (40, 30)):
        got = {}
        for r in pf.semantic_prefilter(df, keep, sample).collect():
            got.setdefault(r.doc_id, {})[r.n] = r.reason
        want = {d: brute(segs, keep, sample, vectors) for d, segs in docs.items()}
        assert {d: sorted(x.items()) for d, x in got.items()} == {d: sorted(x.items()) for d, x in want.items()}
    reasons = {v for x in want.values() for v in x.values()} | {v for d, s in docs.items() for v in brute(s, 110, 20, vectors).values()}
    assert reasons == {"all", "guaranteed", "sample", "score", "fill"}


def test_f24_words_are_not_shuffled(spark, monkeypatch):
    """Texts go to their document's task, where their words become rows: no plan deals out a word. Segments without a heading (null) and documents of headings alone are whole."""
    frames, kept = [], pf.materialize
    monkeypatch.setattr(pf, "materialize", lambda df: (frames.append(df), kept(df))[1])
    rng = random.Random(24)
    docs = {1: document(rng, 120, 5), 2: document(rng, 45, 0), 3: document(rng, 150, 40), 4: [(n, "heading", f"Part {n % 7} of all", 5, f"Part {n % 7} of all", None) for n in range(1, 71)], 5: document(rng, 30, 1)}
    rows = [(d, n, kind, head or None, level, text) for d, segs in docs.items() for n, kind, head, level, text, _ in segs]
    found = pf.semantic_prefilter(spark.createDataFrame(rows, "doc_id long, n long, type string, heading string, level int, text string"), 40, 12)
    plans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1] for df in [*frames, found]]
    dealt = [re.sub(r"#\d+L?", "", x) for plan in plans for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    assert dealt and not [x for x in dealt if "term" in x] and len(dealt) <= 12
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, {})[r.n] = r.reason
    assert {d: sorted(x.items()) for d, x in got.items()} == {d: sorted(brute(segs, 40, 12, False).items()) for d, segs in docs.items()}
