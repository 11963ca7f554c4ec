import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, block long, score double, kept string, length long, role string, place string"


def prose(rng, n, words=None):
    words = words or ["ba", "keli", "tor", "mina", "sudo", "ren", "ola", "pikka", "vastu", "leem", "Tarn", "ix", "onde", "gra", "filu"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def make(spark, rows):
    """rows of (doc_id, text, lang); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, 1, 2, 0.5, "k", 7, "r", "p") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["xa", "xb"])) for i in range(60)]
    out += [(100, out[3][1], "xa"), (101, out[3][1], "xa"), (101, out[3][1], "xa"), (102, out[5][1] + " extra", "xb")]
    out += [(200, None, "xa"), (201, "", None), (202, "   \n\t ", "xa"), (203, "one", "xa"), (204, "two words", None), (205, "12 34 --- !!", "xb")]
    out += [(None, out[7][1], "xa"), (None, None, None), (206, "é ü 漢字 кот " * 30, "xc"), (207, prose(rng, 30000), "xa")]
    out += [(208, "same line here\n" * 40 + "\n\nother", "xa"), (209, "&&& ### $$$ %%% | <b>" * 20, "xb"), (210, "<|endoftext|> a  b   c\x0bd", "xa")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, []).cache()
