"""Quality rules: text counts and tokeniser fertility with rejection bands per script.

Two public vocabularies measure each text, a piece vocabulary with byte fallback and
a byte-level one for many languages:

* Fertility: characters per token of the words with a letter (of all words where no
  word has one). Low for noise and for text foreign to a vocabulary. The harmonic
  mean of both lies in the band of the text's main script, and the lower of the two
  is not below ``WEAKER`` of the band: text that only one vocabulary happens to
  cover (hexadecimal runs) is noise. Short texts are given ``SLACK`` over the root
  of their tokens, about three standard errors.
* Byte fallback: the share of tokens that are single bytes (or parts of a character),
  by the vocabulary that needs fewer.
* Entropy of the piece vocabulary's tokens, as a share of the most that so many
  tokens could have, up to 1024: low for repetition.

A text is kept if the base rules pass and every measure lies in the band. Words are
encoded by themselves, which is how the vocabularies were made. The band of Latin
script is set from data: clean invented prose in four languages has a fertility of
1.75 to 2.9, words of random letters 1.45 to 1.57, base64 and hexadecimal runs 1.2.
Languages of Latin script full of diacritics are foreign to both vocabularies: such
a text is measured once more without its diacritics if it lies outside the band. Greek,
Hebrew and Arabic texts also have a least fertility by the byte-level vocabulary, which
tells running text from random letters. A text without any letter is rejected.

Null and empty texts have no words and fail the base rules; ids may be null or
repeated, each row is judged by itself; very long texts are judged whole; other
columns are ignored; an empty table gives no rows; a measure equal to the limit of a
band is inside; of scripts with equally many words the first of ``SCRIPTS`` counts.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_slices, mix64
from .tokens import ByteBpe, WordPieces

VOCABULARY = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Texts with more tokens are held to the entropy of so many.
FULL_ENTROPY = 1024

#: First code points of script ranges and their names, fixed values of the Unicode standard's blocks.
_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000]
_NAMES = ["latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "thai", "other", "other", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han", "other", "han"]
SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "thai", "hangul", "kana", "han", "other"]
_CODES = [SCRIPTS.index(n) for n in _NAMES]

#: What the lower fertility may be of the band's least; slack of short texts, over the root of their tokens.
WEAKER, SLACK = 0.83, 0.6

#: By script: least and most characters per token, most byte-fallback share, least share of the possible entropy.
BANDS = {
    "none": (99.0, 12.0, 0.25, 0.20),
    "latin": (1.62, 8.0, 0.10, 0.42),
    "greek": (0.5, 6.0, 0.30, 0.35),
    "cyrillic": (1.3, 7.0, 0.20, 0.35),
    "hebrew": (0.3, 5.0, 0.50, 0.25),
    "arabic": (0.3, 5.0, 0.50, 0.25),
    "indic": (0.2, 5.0, 0.90, 0.20),
    "thai": (0.2, 5.0, 0.90, 0.20),
    "hangul": (0.2, 5.0, 0.90, 0.20),
    "kana": (0.3, 5.0, 0.80, 0.25),
    "han": (0.2, 4.0, 0.90, 0.25),
    "other": (0.2, 8.0, 0.95, 0.20),
}

#: Scripts that the first vocabulary hardly knows: least characters per token of the second alone. Running text of them has 1.4 to 1.7, random letters 1.05 to 1.15.
LEAST_BYTES = {"greek": 1.2, "hebrew": 1.2, "arabic": 1.2}
#: Latin texts with diacritics in this share of words, which neither vocabulary may know, are also measured without them, against the least given
#: (Vietnamese, Yoruba and Hawaiian have 1.8 to 2.05, random letters with diacritics 1.6 to 1.75).
MARKED, LEAST_BARE = 0.3, 1.74
#: Letters that do not come apart into a letter and a mark; fixed values.
_WHOLE = str.maketrans("đĐøØłŁıħŧ", "dDoOlLiht")

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, chars_per_token_bytes double, fertility double, byte_share double, token_entropy double, script string, kept boolean"


def bare(word: str) -> str:
    """A word without diacritics and modifier letters."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) not in ("Mn", "Lm")).translate(_WHOLE)


def script_code(word: str) -> int:
    """The script of a word's first letter, 0 without one."""
    for ch in word:
        if ch.isalpha():
            return _CODES[bisect_right(_STARTS, ord(ch)) - 1]
    return 0


def repeated_words(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each document (a run of word ids) the words in windows that it has twice or more."""
    n = len(ids)
    out = np.zeros(len(starts), np.int64)
    if n < window:
        return out
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
    key = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + mixed[k : n - window + 1 + k]
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key = mix64(key[at]) + doc[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(key)
    key, at = key[order], at[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if not len(same):
        return out
    a, b = at[same], at[same + 1]
    equal = doc[a] == doc[b]
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    edge = np.zeros(n + 1, np.int64)
    if equal.all():
        hit = np.unique(np.r_[a, b])
    else:  # two different windows with one key: compare the windows of these documents themselves
        found = []
        for d in np.unique(np.r_[doc[a], doc[b]]):
            seen: dict = {}
            for i in range(starts[d], ends[d] - window + 1):
                seen.setdefault(ids[i : i + window].tobytes(), []).append(i)
            found += [i for v in seen.values() if len(v) > 1 for i in v]
        hit = np.unique(np.array(found, np.int64))
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(edge[:n]) > 0)]
    return covered[ends] - covered[starts]


def _dup_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _entropy(tokens: np.ndarray, size: int) -> float:
    if not len(tokens):
        return 0.0
    counts = np.bincount(tokens, minlength=size) if len(tokens) > 3000 else np.unique(tokens, return_counts=True)[1]
    p = counts[counts > 0] / len(tokens)
    return float(max(0.0, -(p * np.log2(p)).sum()))


def judge(texts: list[bytes], pieces: WordPieces, bands: dict = BANDS, bpe: ByteBpe | None = None, marks: bool = True) -> dict[str, np.ndarray | list]:
    """All measures of a list of texts; marks=False gives texts with diacritics no second measure."""
    bpe = bpe or ByteBpe.shared(BYTE_VOCABULARY)
    words = [x.split() for x in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(n_words)
    starts = ends - n_words
    flat = list(chain.from_iterable(words))
    unique = list(dict.fromkeys(flat))
    number = dict(zip(unique, range(len(unique)), strict=True))
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    coded = pieces.of(unique)
    ascii_word = list(map(bytes.isascii, unique))
    lengths = np.fromiter(map(len, unique), np.int64, len(unique))
    wide = [i for i, a in enumerate(ascii_word) if not a]
    for i in wide:
        lengths[i] = len(unique[i].decode("utf-8", "replace"))
    plain = np.fromiter(map(bytes.isalpha, unique), bool, len(unique))  # ASCII letters alone
    symbols = np.zeros(len(unique), np.int64)
    scripts = np.ones(len(unique), np.int64)
    for i in np.flatnonzero(~plain).tolist():
        w = unique[i]
        symbols[i] = len(w) - len(w.translate(None, SYMBOLS))
        scripts[i] = 1 if w[:1].isalpha() else script_code(w.decode("utf-8", "replace"))
    size = np.array([len(x) >> 2 for x in coded], np.int64)
    byte_size, broken = bpe.counts(unique)  # broken: tokens of the byte-level vocabulary that are parts of a character
    all_tokens = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
    first = np.cumsum(size) - size
    fallback = np.r_[0, np.cumsum(pieces.is_byte[all_tokens])]
    def total(of_word: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(of_word[ids])] if len(ids) else np.zeros(1, np.int64)
        return run[ends] - run[starts]

    out = {
        "n_words": n_words,
        "word_chars": total(lengths),
        "n_symbols": total(symbols),
        "n_dup_lines": np.array([_dup_lines(x) for x in texts], np.int64),
        "n_repeat_words": repeated_words(ids, starts, ends),
    }
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    n_tokens = total(size)
    by_bytes = total(byte_size)
    share = total(fallback[first + size] - fallback[first]) / np.maximum(n_tokens, 1)
    share = np.minimum(share, total(broken) / np.maximum(by_bytes, 1))
    lettered = total((scripts > 0).astype(np.int64))
    some = (scripts > 0).astype(np.int64)
    use = lettered > 0
    chars, tokens, tokens_2 = (np.where(use, total(x * some), total(x)) for x in (lengths, size, byte_size))
    per_token, per_token_2 = chars / np.maximum(tokens, 1), chars / np.maximum(tokens_2, 1)
    fertility = 2 * chars / np.maximum(tokens + tokens_2, 1)
    slack = SLACK / np.sqrt(np.maximum((tokens + tokens_2) / 2, 1))
    entropy = np.zeros(len(texts))
    for d in np.flatnonzero(n_tokens):
        own = ids[starts[d] : ends[d]]
        lens = size[own]
        shift = np.repeat(first[own] - (np.cumsum(lens) - lens), lens)
        entropy[d] = _entropy(all_tokens[shift + np.arange(len(shift))], len(pieces.is_byte))
    latin = total((scripts == 1).astype(np.int64))
    script = np.where(lettered == 0, 0, np.where(2 * latin >= lettered, 1, -1))
    for d in np.flatnonzero(script < 0):
        counts = np.bincount(scripts[ids[starts[d] : ends[d]]], minlength=len(SCRIPTS))
        script[d] = int(np.argmax(np.r_[0, counts[1:]]))
    low, high, most_bytes, least = np.array([bands[s] for s in SCRIPTS]).T
    ratio = entropy / np.log2(np.clip(n_tokens, 2, FULL_ENTROPY))
    least_of_both = np.minimum(per_token, per_token_2)
    good = (fertility >= low[script] - slack) & (least_of_both >= WEAKER * low[script] - slack) & (fertility <= high[script]) & (share <= most_bytes[script]) & (ratio >= least[script])
    good &= per_token_2 >= np.array([LEAST_BYTES.get(s, 0.0) for s in SCRIPTS])[script] - slack
    marked = total(np.array([not a for a in ascii_word], np.int64)) >= MARKED * np.maximum(n_words, 1)
    again = np.flatnonzero(~good & ~out["base_failed"] & marked & (script == 1) & (ratio >= least[1])) if marks else []
    if len(again):  # few texts: those that a band has rejected
        plainer = judge([bare(b" ".join(words[d]).decode("utf-8", "replace")).encode() for d in again], pieces, bands | {"latin": (LEAST_BARE, *bands["latin"][1:])}, bpe, marks=False)
        good[again] = np.array(plainer["kept"], bool)
    out |= {"n_tokens": n_tokens, "chars_per_token": per_token, "chars_per_token_bytes": per_token_2, "fertility": fertility, "byte_share": share, "token_entropy": entropy, "script": [SCRIPTS[s] for s in script], "kept": good & ~out["base_failed"]}
    return out


def quality_rules(docs: DataFrame, vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY, bands: dict = BANDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and all measures with the verdict kept."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bpe = WordPieces.shared(vocabulary), ByteBpe.shared(byte_vocabulary)
        for batch in bounded_slices(batches, "text"):
            found = judge(as_bytes(batch.column("text")), pieces, bands, bpe)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[n]) for n in names)], names=["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {FIELDS}")


def keep_good(docs: DataFrame, vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY, bands: dict = BANDS, text: str = "text") -> DataFrame:
    """docs (all columns, by position) without the rows that the rules reject."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bpe = WordPieces.shared(vocabulary), ByteBpe.shared(byte_vocabulary)
        for batch in bounded_slices(batches, at):
            kept = judge(as_bytes(batch.column(at)), pieces, bands, bpe)["kept"]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
