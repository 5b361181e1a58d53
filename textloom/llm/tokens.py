"""Token ids of whole texts by a public tokenizer file, with a word cache in front of it.

The tokenizer drops white space and splits a text into pieces that are encoded independently, so the ids of
each run between white space can be remembered.  The cache path is taken only for texts where the normalizer
and the piece pattern are known to act character by character (Latin-1 letters, no control characters, no
special-token text); any other text goes to the tokenizer itself.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

LATIN = range(0x100)


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in LATIN if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
SAFE = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])


def _byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Remembered(dict):
    """A dict that computes what it lacks and empties itself when full, which costs time only."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class WordTokens:
    """Encoder of whole texts to little-endian uint32 id bytes; ``cache_words`` bounds a worker's memory."""

    def __init__(self, path: str, cache_words: int = 700_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.alphabet = _byte_alphabet()
        self.pieces = _Remembered(self._piece, cache_words // 2)
        self.runs = _Remembered(self._run, cache_words)

    def slow(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def _run(self, run: str) -> bytes:
        if run.isalpha():
            return self._piece(run)
        if run[:-1].isalpha() and run[-1] in ",.":
            return self.pieces[run[:-1]] + self.pieces[run[-1]]
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(run)))

    def encode(self, text: str | None) -> bytes:
        """Id bytes of a text; None counts as empty."""
        if not text:
            return b""
        try:
            odd = text.encode("latin-1").translate(None, SAFE)
        except UnicodeEncodeError:
            odd = b"?"
        if odd or "<|" in text:
            return self.slow(text)
        return b"".join(map(self.runs.__getitem__, text.lower().split()))
