"""Questions over a small graph, against a plain computation."""

import math
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brindle.operators import graph, graph_rag

TEXTS = {
    1: "the zeppelin flew over harbour and zeppelin pilots waved " * 3 + "harbour zeppelin", 2: "zeppelin harbour lights at night " * 2, 3: "zeppelin harbour again, with pilots", 4: "orchid gardens and orchid growers in glasshouse " * 2,
    5: "orchid growers love glasshouse heat", 6: "growers of orchid, a glasshouse", 7: None, 8: "", 9: "pilots met growers near harbour once",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, t) for i, t in TEXTS.items()] + [(i, "filler words of no interest") for i in range(100, 400)]
    return graph_rag.graph_index(spark.createDataFrame(rows, "doc_id long, text string"))


def brute_chunks():
    out = {}
    for i, t in TEXTS.items():
        w = (t or "").split()
        for k in range(0, len(w), 50):
            out[f"{i}:{k // 50}"] = " ".join(w[k : k + 50])
    return out


def test_index_by_a_plain_count(index, spark):
    chunks, mentions, relations, communities = index
    got = {r.chunk_id: r.text for r in chunks.where("doc_id < 100").collect()}
    assert got == brute_chunks()
    names = {r["name"] for r in graph.significant(graph.candidates(spark.createDataFrame([(i, t) for i, t in TEXTS.items()] + [(i, "filler words of no interest") for i in range(100, 400)], "doc_id long, text string"), "doc_id", "text")).collect()}
    own = {c: sorted(set(re.findall(r"\w{3,}", t.lower())) & names) for c, t in brute_chunks().items()}
    assert {(r.chunk_id, r.entity) for r in mentions.collect()} == {(c, e) for c, es in own.items() for e in es}
    pairs = Counter(p for es in own.values() for p in combinations(es, 2))
    assert {(r.source, r.target): r.weight for r in relations.collect()} == {p: n for p, n in pairs.items() if n >= 2}
    of = {r.entity: r.community for r in communities.collect()}
    assert of["zeppelin"] == of["harbour"] != of["orchid"] == of["growers"] == of["glasshouse"]


def test_local_answers_follow_the_question(index):
    r = graph_rag.ask("What is the zeppelin?", index).first()
    assert r["mode"] == "local" and r.communities_used == 0
    total, words = 300 + len(brute_chunks()), {c: re.findall(r"\w{2,}", t.lower()) for c, t in brute_chunks().items()}
    mean = (sum(map(len, words.values())) + 300 * 5) / total
    df = sum("zeppelin" in w for w in words.values())
    score = {c: math.log((total - df + 0.5) / (df + 0.5) + 1) * w.count("zeppelin") * 2.5 / (w.count("zeppelin") + 1.5 * (0.25 + 0.75 * len(w) / mean)) for c, w in words.items() if "zeppelin" in w}
    assert r.sources == [c for c, _ in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))][:5]
    assert "zeppelin" in r.entities and "orchid" not in r.entities and "zeppelin" in r.answer
    assert "orchid" in graph_rag.ask("Who are the growers of orchid?", index).first().entities


def test_global_and_drift(index):
    g = graph_rag.ask("Give an overview of orchid", index).first()
    assert g["mode"] == "global" and "orchid" in g.answer and "zeppelin" not in g.answer
    assert graph_rag.ask("Give an overview of dinosaurs", index).first().answer.startswith("No relevant information")
    d = graph_rag.ask("How do pilots relate to growers?", index).first()
    assert d["mode"] == "drift" and d.communities_used == 2 and "zeppelin" in d.answer.partition("Broader themes:")[2]


def test_questions_without_words(index):
    r = graph_rag.ask("what is the", index).first()
    assert (r["mode"], r.sources, r.entities) == ("local", [], [])
    assert graph_rag.asked_words("What is the Zeppelin, and zeppelin's AI?") == ["zeppelin"]
    assert index[0].where(F.length("text") == 0).isEmpty()
