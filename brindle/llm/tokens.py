"""Word-cached tokenisation with public vocabularies; exact, and several times faster than whole texts.

The byte-level vocabularies split a text by a pattern in which a space belongs to
the word after it, and no match reaches over a single space between two
characters that are not white space. Cutting there leaves the ids as they are,
so the ids of each cut are kept and joined. The kept words are bounded; a full
store is dropped and filled anew.
"""

from __future__ import annotations

from array import array
from functools import cache
from pathlib import Path

import numpy as np

STORE = 200_000
_LONG = 256
#: A space next to other white space, by bytes; Unicode's white space beyond ASCII by its first bytes.
_CONTROLS = [bytes([c]) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31)]
_BESIDE = [pair for c in _CONTROLS for pair in (c + b" ", b" " + c)]
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


@cache
def vocabulary_path(name: str) -> str:
    """A vocabulary file by path, or by name from the installed public vocabularies."""
    if Path(name).is_absolute():
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _whole(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class ByteBpe(dict):
    """Byte-level BPE; maps a unit (bytes after a cut, without its space) to little-endian 32-bit ids."""

    _made: dict = {}

    @classmethod
    def shared(cls, name: str) -> ByteBpe:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        super().__init__()
        path = Path(vocabulary_path(name)).with_suffix(".tiktoken")  # the same vocabulary as ranks
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
        coder = tiktoken.Encoding(path.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole, self.single = coder._core_bpe.encode_ordinary, coder._core_bpe.encode_single_piece
        self.counted: dict[bytes, int] = {}
        self.is_part = bytearray(max(ranks.values()) + 1)  # tokens that are no whole characters
        for data, i in ranks.items():
            self.is_part[i] = not data.isascii() and not _whole(data)

    def __missing__(self, unit: bytes) -> bytes:
        if len(self) >= STORE:
            self.clear()
        text = unit.decode("utf-8", "replace")
        # letters after a space are one match of the pattern
        ids = array("I", self.single(b" " + unit) if text.isalpha() else self.whole(" " + text)).tobytes()
        if len(unit) <= _LONG:
            self[unit] = ids
        return ids

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens that are parts of a character) of words after a space; only these numbers are kept."""
        if len(self.counted) > STORE:
            self.counted.clear()
        seen, part = self.counted, self.is_part
        for w in words:
            if w not in seen:
                text = w.decode("utf-8", "replace")
                ids = self.single(b" " + w) if text.isalpha() else self.whole(" " + text)
                seen[w] = len(ids) if text.isascii() else len(ids) | sum(map(part.__getitem__, ids)) << 32
        both = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        for w in words:
            if len(w) > _LONG:
                seen.pop(w, None)
        return both & 0xFFFFFFFF, both >> 32

    def ids(self, data: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not data:
            return b""
        units = data.split(b" ")
        if not all(units) or any(x in data for x in _BESIDE) or (not data.isascii() and any(x in data for x in _WIDE)):
            return self._careful(data)
        head = array("I", self.whole(units[0].decode("utf-8", "replace"))).tobytes()
        return b"".join([head, *map(self.__getitem__, units[1:])])

    def _careful(self, data: bytes) -> bytes:
        """Cuts only where both sides of a space are visible."""
        out: list[bytes] = []
        held: list[str] = []

        def flush() -> None:
            if not out:
                out.append(array("I", self.whole(" ".join(held))).tobytes())
            elif len(held) == 1:
                out.append(self[held[0].encode()])
            else:
                out.append(array("I", self.whole(" " + " ".join(held))).tobytes())

        for unit in data.decode("utf-8", "replace").split(" "):
            if held and held[-1] and unit and not held[-1][-1].isspace() and not unit[0].isspace():
                flush()
                held = []
            held.append(unit)
        flush()
        return b"".join(out)


class WordPieces(dict):
    """sentencepiece vocabulary; a word (bytes) to its token ids as little-endian 32-bit integers."""

    _made: dict = {}

    @classmethod
    def shared(cls, name: str) -> WordPieces:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __init__(self, name: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, each encoded by itself."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > STORE:
            self.clear()
            new = words
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            coded = self.model.encode([w.decode("utf-8", "replace") for w in part], num_threads=1)
            self.update(zip(part, (array("I", x).tobytes() for x in coded), strict=True))
        out = list(map(self.__getitem__, words))
        for w in new:
            if len(w) > _LONG:
                del self[w]
        return out
