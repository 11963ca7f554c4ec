"""The bands do work: noise goes, clean text stays, and the measures are what the tokenisers say."""

import base64
import math
import random
from collections import Counter

import numpy as np
import pytest

from brindle.llm import quality_rules as Q
from brindle.llm.tokens import WordPieces, vocabulary_path
from tests.llm.conftest import make

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n, low, high, letters=LETTERS):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n))


def noise(rng):
    yield from (words(rng, n, 2, 10) for n in (100, 300, 2000))
    yield from (words(rng, n, 4, 12) for n in (150, 300))
    yield words(rng, 200, 3, 10, LETTERS + LETTERS.upper() + "0123456789")
    yield " ".join(base64.b64encode(rng.randbytes(36)).decode() for _ in range(40))
    yield " ".join(rng.randbytes(8).hex() for _ in range(60))
    yield words(rng, 120, 2, 9, [chr(c) for c in range(0x10000, 0x1005E)])  # letters that neither vocabulary has
    yield words(rng, 120, 2, 9, [chr(c) for c in range(0x13000, 0x13400)])


CLEAN = [
    "The committee met on Tuesday to discuss the proposal, and after a long debate it was agreed that the members would vote again next week when everyone could attend the meeting.",
    "Der Ausschuss hat am Dienstag getagt, um über den Vorschlag zu beraten, und nach langer Aussprache wurde beschlossen, dass die Mitglieder nächste Woche erneut abstimmen werden.",
    "Le comité s'est réuni mardi pour examiner la proposition, et après un long débat il a été convenu que les membres voteraient de nouveau la semaine prochaine.",
    "El comité se reunió el martes para discutir la propuesta y, tras un largo debate, se acordó que los miembros votarían de nuevo la próxima semana cuando todos pudieran asistir.",
    "Комитет собрался во вторник, чтобы обсудить предложение, и после долгих споров было решено, что члены комитета снова проголосуют на следующей неделе, когда все смогут прийти на заседание.",
    "Η επιτροπή συνεδρίασε την Τρίτη για να συζητήσει την πρόταση και ύστερα από μακρά συζήτηση συμφωνήθηκε ότι τα μέλη θα ψηφίσουν ξανά την επόμενη εβδομάδα όταν θα μπορούν όλοι.",
    "In 2019 the town had 12 403 residents, 1 502 of them under 18; by 2023 these numbers were 13 877 and 1 711, so that about 12 % of the residents were children in both of the years.",
]


def test_noise_goes_and_clean_text_stays(spark):
    rng = random.Random(3)
    rows = [(i, t, "x") for i, t in enumerate(CLEAN)] + [(100 + i, t, "x") for i, t in enumerate(noise(rng))]
    for r in Q.quality_rules(make(spark, rows)).collect():
        assert not r.base_failed and r.kept == (r.doc_id < 100), r


def test_clean_rows_of_the_table_stay(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = Q.quality_rules(docs).where("not base_failed").join(labels.where("quality = 1"), "doc_id").groupBy("kept").count().collect()
    counts = {r.kept: r["count"] for r in found}
    assert counts.get(False, 0) <= 0.002 * counts[True]


def test_measures_are_the_tokenisers(docs, rows):
    """Fertility, byte share and entropy recomputed word by word with the libraries themselves."""
    import sentencepiece
    import tiktoken

    import public_tokenizers as P

    piece = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(Q.VOCABULARY))
    with open(P.path(Q.BYTE_VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in Q.quality_rules(docs).collect() if r.doc_id is not None}
    for i, text, _ in rows:
        if i is None or i in (101, 207):
            continue
        own = [w.decode() for w in (text or "").encode().split()]
        lettered = [w for w in own if any(c.isalpha() for c in w)] or own
        chars = sum(map(len, lettered))
        ids = [t for w in own for t in piece.encode(w)]
        a, b = (sum(len(f(w)) for w in lettered) for f in (piece.encode, lambda w: bpe.encode_ordinary(" " + w)))
        n = sum(len(bpe.encode_ordinary(" " + w)) for w in own)
        parts = sum(b"\xff" != t and _part(t) for w in own for t in bpe.decode_tokens_bytes(bpe.encode_ordinary(" " + w)))
        r = found[i]
        assert r.n_tokens == len(ids)
        assert math.isclose(r.fertility, 2 * chars / max(a + b, 1)) and math.isclose(r.chars_per_token, chars / max(a, 1)) and math.isclose(r.chars_per_token_bytes, chars / max(b, 1))
        assert math.isclose(r.byte_share, min(sum(map(piece.is_byte, ids)) / max(len(ids), 1), parts / max(n, 1)))
        p = np.array(list(Counter(ids).values())) / max(len(ids), 1)
        assert math.isclose(r.token_entropy, float(-(p * np.log2(p)).sum()) if ids else 0.0, abs_tol=1e-9)
        low, high, most, least = Q.BANDS[r.script]
        slack = Q.SLACK / math.sqrt(max((a + b) / 2, 1))
        inside = r.fertility >= low - slack and min(r.chars_per_token, r.chars_per_token_bytes) >= Q.WEAKER * low - slack and r.fertility <= high and r.byte_share <= most
        assert r.kept == (not r.base_failed and inside and r.token_entropy / math.log2(min(max(len(ids), 2), 1024)) >= least)


def _part(token):
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


@pytest.mark.parametrize("n", [20, 40])
def test_short_clean_texts_stay(spark, n):
    rows = [(i, " ".join(t.split()[:n]), "x") for i, t in enumerate(CLEAN)]
    assert all(r.kept for r in Q.quality_rules(make(spark, rows)).collect())
