import re
import zlib
from collections import Counter

import numpy as np

from brindle.llm import language_id, license_scan, quality_rules
from tests.llm.conftest import make, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORDS.findall(text or "")
    at = range(len(words) - 7)
    windows = Counter(tuple(words[i : i + 8]) for i in at)
    covered = {k for i in at if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_match_brute_force(docs, rows):
    got = sorted(tuple(r) for r in docs.transform(quality_rules.quality_rules).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == sorted(base(t) for _, t, _ in rows)


def test_verdict_needs_base_rules_and_bands(spark, docs):
    found = quality_rules.quality_rules(docs).toPandas()
    assert not (found.kept & found.base_failed).any()
    import random

    clean = make(spark, [(i, prose(random.Random(i), 200), "xa") for i in range(5)])
    assert all(r.kept for r in quality_rules.quality_rules(clean).collect())
    narrow = {s: (1e6, 1e7, 0.0, 0.0) for s in quality_rules.SCRIPTS}
    assert not any(r.kept for r in quality_rules.quality_rules(clean, bands=narrow).collect())


def test_word_wise_measures(docs):
    r = {x.doc_id: x for x in quality_rules.quality_rules(docs).collect()}
    assert r[206].script in ("latin", "han", "cyrillic") and r[200].n_tokens == 0 and r[200].chars_per_token == 0
    assert 0 < r[207].token_entropy < 16


def test_window_collisions_fall_back_to_equality(monkeypatch):
    monkeypatch.setattr(quality_rules, "mix64", lambda x: np.zeros(len(x), np.uint64))
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 20, 21], np.int64)
    assert quality_rules.repeated_words(ids, np.array([0]), np.array([len(ids)])).tolist() == [16]


def test_rules_on_no_rows(no_docs):
    assert quality_rules.quality_rules(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0


def test_stage_keeps_columns_and_agrees(docs):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.quality_rules(docs).where("kept").count()


def test_language_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.contract(docs).join(docs.select("doc_id", "lang"), "doc_id")
    hit = {r.held_out: r.hit for r in found.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("hit")).collect()}
    assert hit[True] > 0.97 and hit[False] > 0.97
    for r in found.select("doc_id", "held_out").limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_edges(docs, no_docs, rows):
    found = language_id.contract(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    r = found.toPandas()
    assert len(r) == len(rows) and r.score.between(0, 1).all()
    none = {i for i, t, _ in rows if i is not None and not any(map(str.isalpha, t or ""))}
    assert set(r[(r.lang_pred == "und") & r.doc_id.notna()].doc_id.astype(int)) == none
    assert language_id.contract(no_docs).count() == 0
    assert {x.lang_pred for x in language_id.language_id(docs, train=docs.doc_id < -1).collect()} == {"und"}


def test_backoff_uses_the_longest_known_grams():
    m = language_id.Model(["a", "b"], {"hello": np.array([5.0, 0.0]), "guten": np.array([0.0, 5.0])})
    assert m.word("hello") is m.words["hello"]
    assert m.word("hellos")[0] > m.word("hellos")[1] and m.word("gutens")[1] > m.word("gutens")[0]
    long = np.mean([m.grams[5][g] for g in language_id.grams("hellos", 5) if g in m.grams[5]], axis=0)
    assert np.allclose(m.word("hellos"), long)
    assert m.word("zzz") is None and m.word("") is None


def test_language_stage(docs):
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_licences(spark):
    S = license_scan.SENTENCES
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(S[k] for k in ("mit-grant", "mit-notice")) + "\n\n" + S["mit-as-is"] + " " + S["mit-liability"]
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n", mit)
    rows = [(1, mit, "x"), (2, wrapped, "x"), (3, "Text. Released under the MIT License. More.", "x"), (4, "Nothing here.", "x"), (5, None, "x"), (6, "All rights reserved.", "x"), (None, S["isc-grant"], "x")]
    rows.append((7, f"{S['bsd-grant']}\n{S['bsd-source']}\nan unknown sentence.\n{S['bsd-binary']}", "x"))
    rows.append((8, f"{S['bsd-grant']}\na.\nb.\nc.\n{S['bsd-source']}\n{S['bsd-binary']}", "x"))
    got = {}
    for r in license_scan.license_scan(make(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.licence, r.rule, r.n_sentences))
    assert got[1] == [("MIT", "mit-full-short", 5)] and got[2] == got[1]
    assert got[3] == [("MIT", "mit-released", 1)] and got[6] == [("UNMATCHED", None, 1)] and got[None] == [("ISC", "isc", 1)]
    assert got[7] == [("BSD-2-Clause", "bsd2", 3)] and [x[0] for x in got[8]] == ["UNMATCHED"] * 3
    assert 4 not in got and 5 not in got


def test_licence_spans_and_long_texts(spark, no_docs):
    text = "word " * 50000 + "\nLicensed under CC BY-NC 4.0.\n" + "word " * 50000
    r = license_scan.license_scan(make(spark, [(1, text, "x"), (1, text, "x")])).collect()
    assert len(r) == 2 and text[r[0].start_char : r[0].end_char] == "Licensed under CC BY-NC 4.0."
    assert license_scan.license_scan(no_docs).count() == 0
