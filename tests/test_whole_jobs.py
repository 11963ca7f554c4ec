"""Operators on whole inputs: what lies beyond the first characters, links, copies and rounds counts."""

import random
from collections import defaultdict

from brindle.operators import dedup, folds, graph, signals
from brindle.plans import registry


def test_votes_reach_the_last_place(spark, monkeypatch):
    monkeypatch.setattr(signals, "FOLD_CHARS", 7)
    monkeypatch.setattr(signals, "HELD_VOTES", 5)
    rows = [("abcdefghijklmnopq", 1), ("abcdefghijklmnoxé", 2), ("abcdefghijklmn\U0001f600", 1), ("", 3), (None, 3), ("zz", None)]
    got = {r.pos: (r.ch, round(r.share, 6)) for r in signals.place_votes(spark.createDataFrame(rows, "text string, confidence int")).collect()}
    votes = defaultdict(lambda: defaultdict(int))
    for text, c in rows:
        for i, ch in enumerate(text or "", 1):
            votes[i][ch] += c or 0
    want = {}
    for i, v in votes.items():
        top = min(ch for ch in v if v[ch] == max(v.values()))
        want[i] = (top, round(v[top] / sum(v.values()), 6))
    assert got == want and max(got) == 17 and got[17] == ("é", 0.666667)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_bound_is_exact():
    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.choice("abcé") for _ in range(rng.randint(0, 90))]
        b = a[:]
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        b = b if rng.random() < 0.8 else [rng.choice("abcé") for _ in range(rng.randint(0, 90))]
        a, b = "".join(a), "".join(b)
        far = _distance(a, b)
        for most in (0, 3, far - 1, far, far + 1):
            assert folds.within_edits(a, b, most) == (far <= most), (a, b, most)


def test_subtitles_compare_whole_turns(spark, tmp_path):
    same = "the first eighty characters of these turns are the same, word for word and all through, "
    assert len(same) > 80
    turns = [(1, 1, same + "but one goes on about harbours and the weather at sea"), (1, 2, same + "while two is a recipe for bread with rye, salt, water"), (1, 3, same + "while two is a recipe for bread with rye, salt, waters")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.turn, r.text) for r in registry.queries()["sd11_subtitles"](spark, str(tmp_path)).orderBy("turn").collect()]
    assert got == [(1, turns[0][2]), (2, turns[2][2])]


def test_every_link_of_a_page(spark):
    html = """<p><a href="/first">a</a> <a class='x' href='/it%22s'>b</a><a href="/first">again</a> <a data-href="/no" href="https://www.github.com/o/r/issues?x">c</a>
    <A HREF="http://www.x.org:80/p">d</A> <a href="https://github.com/only">e</a> <a href="//cdn.y.net/z">f</a> <a href="#part">g</a> <a href="mailto:a@b">h</a> <a href="next.html">i</a>"""
    df = spark.createDataFrame([(1, html), (2, "none"), (3, None), (4, '<a href="https://user@z.org">only absolute</a>')], "page_id long, html string")
    got = sorted((r.page_id, r.target, r.relation) for r in graph.link_relations(df).collect())
    inside = [(1, t, "references") for t in ("/first", "/first", "/it%22s", "next.html")]
    outside = [(1, t, "links_to") for t in ("github:o/r", "site:x.org", "site:github.com", "site:cdn.y.net")]
    assert got == sorted([*inside, *outside, (4, "site:z.org", "links_to")])


def test_copies_share_their_leader(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, base[rng.randrange(6)] ^ sum(1 << p for p in rng.sample(range(4), rng.randint(0, 2)))) for i in range(90)] + [(90, None), (91, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    want = {}
    for k, v in rows:
        near = [w for w, x in rows[:k] if want[w] == w and None not in (v, x) and bin(v ^ x).count("1") <= 1]
        want[k] = min(near, default=k)
    assert {r.k: r.leader for r in dedup.hamming_leaders(df, "k", "v", 1).collect()} == want
    assert len({v for _, v in rows}) < 60
    first = {}
    for k, v in rows:
        first.setdefault(v, k)
    assert {r.k: r.representative for r in dedup.hamming_members(df, "k", "v").collect()} == {k: k if v is None else first[v] for k, v in rows}


def test_leaders_of_a_long_chain(spark):
    """A path settles about two nodes a round; all have to be settled, whatever the rounds."""
    n = 5000
    nodes = spark.createDataFrame([(i,) for i in range(n)] + [(None,)], "k long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert {r.k: r.leader for r in dedup.leaders(nodes, links).collect()} == {None: None} | {i: i - i % 2 for i in range(n)}


def test_leaders_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FOLDED_LINKS", 0)
    links = [(0, 1), (1, 2), (2, 5), (3, 5), (3, 4)]  # 3 leads a round before 2, which is still the first to lead 5
    got = {r.k: r.leader for r in dedup.leaders(spark.range(6).withColumnRenamed("id", "k"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 2}


def test_candidates_of_four_signals(spark):
    texts = ["plain words all over"] * 60 + ["# Zebra and words\nplain `Foo.Bar` and `f(x)` with [Blue Whale](/blog/whale) and [out](https://x.org)", "see `foo.bar`", "#### deeper `zebra`", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.name: (r.mentions, round(r.confidence, 2), r.kind, tuple(r.signals)) for r in graph.candidates(df, "doc_id", "text").collect()}
    assert got["zebra"] == (2, 0.9, "code", ("heading", "inline_code"))
    assert got["foo.bar"] == (2, 0.9, "code", ("inline_code",))
    assert got["blue whale"] == (1, 0.75, "concept", ("link_text",))
    assert got["words"] == (1, 0.85, "concept", ("heading",))
    assert "f(x)" not in got and got["deeper"][3] == ("high_idf",)
    kept = {r.name for r in graph.significant(graph.candidates(df, "doc_id", "text")).collect()}
    assert "zebra" in kept and "foo.bar" not in kept and "blue whale" not in kept
