import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from brindle.llm import mixing
from tests.llm.conftest import make, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def with_sources(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies int, target double")


def brute_targets(sizes):
    """Exact shares: excess is dealt again and again until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_names = [s for s in names if s not in stopped]
        left, w = total - sum(stopped.values()), sum(weight[s] for s in open_names)
        share = {s: Fraction(left * weight[s], w) for s in open_names}
        above = [s for s in open_names if share[s] > 3 * sizes[s]]
        if not above:
            return share | stopped
        stopped |= {s: 3 * sizes[s] for s in above}


def brute(rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    sums = Counter()
    for r, n in zip(rows, size, strict=True):
        sums[r[2]] += n
    aims = {s: float(t) for s, t in brute_targets(dict(sums)).items()}
    draws = []
    for r in rows:
        k = hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
        draws.append((int(k[:8], 16), int(k[8:16], 16)))
    out = [None] * len(rows)
    for s, aim in aims.items():
        rate = aim / sums[s] if sums[s] else 0.0
        own = [i for i, r in enumerate(rows) if r[2] == s]
        tries = [{i: int(rate) + ((draws[i][0] + draws[i][1] * k) % 2**32 < (rate - int(rate)) * 2**32) for i in own} for k in range(32)]
        best = min(range(32), key=lambda k: (abs(sum(tries[k][i] * size[i] for i in own) - aim), k))
        for i in own:
            out[i] = (rows[i][0], size[i], sums[s], aim, size[i] * tries[best][i], tries[best][i])
    return out


def plain(rows):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=repr)


@pytest.fixture(scope="module")
def mix_rows():
    rng = random.Random(7)
    rows = []
    for s, n in (("hot", 150), ("B", 30), ("b", 40), ("tiny", 2), ("é", 20), ("日本", 25), ("\U00010400", 15), ("ﬀ", 15), ("", 12), (None, 10), ("empty", 3)):
        rows += [(len(rows) + k, "" if s == "empty" else prose(rng, rng.randint(1, 60)), s, 5, 6, 0.5) for k in range(n)]
    rows += [(None, "null id here", "B", 1, 1, 0.1), (None, None, "hot", 1, 1, 0.1), (3, " \n\t ", "b", 1, 1, 0.1), rows[5], rows[5], (7000, "w " * 30000, "é", 1, 1, 0.1), (7001, "漢字 кот\x0bé  ", "b", 1, 1, 0.1)]
    return rows


def test_mixing_matches_brute_force(spark, mix_rows):
    docs = with_sources(spark, mix_rows)
    got = mixing.mixed(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    rows = [tuple(r) for r in got.collect()]
    assert plain(rows) == plain(brute(mix_rows))
    assert max(r[5] for r in rows) <= 3
    assert any(r[3] == 3 * r[2] > 0 for r in rows)  # some source stops
    assert plain(mixing.mixed(docs.repartition(5)).collect()) == plain(rows)


def test_many_sources_by_shuffle_joins(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 9)), f"s{rng.randint(0, 80) ** 2 % 60}", 1, 1, 1.0) for i in range(400)]
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert plain(mixing.mixed(with_sources(spark, rows)).collect()) == plain(brute(rows))


def test_emit_repeats_whole_rows(spark, mix_rows):
    docs = with_sources(spark, mix_rows)
    times = Counter()
    for r, want in zip(mix_rows, brute(mix_rows), strict=True):
        times[r] += want[5]
    assert Counter(tuple(r) for r in mixing.emit(docs).collect()) == +times
    clashing = docs.withColumnRenamed("copies", "_brindle_plan").withColumnRenamed("size", "_brindle_measures")
    assert mixing.emit(clashing).columns == clashing.columns


def test_empty_table_and_sources_without_words(spark, no_docs):
    assert mixing.mixed(no_docs).collect() == []
    assert mixing.emit(no_docs).collect() == []
    none = make(spark, [(1, None, "xa"), (2, "", "xb")])
    assert plain(mixing.mixed(none).collect()) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_sql_says_the_same(spark, mix_rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in mix_rows])
    assert plain(con.execute(mixing.SQL).fetchall()) == plain(mixing.mixed(with_sources(spark, mix_rows)).collect())


def test_no_python_in_the_plan(spark, docs):
    text = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
