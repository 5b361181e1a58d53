"""Texts cut into pieces in columns: stretches that can be encoded one by one, and the pieces of a byte-level tokenizer."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once.
AT_ONCE = 1 << 22
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points whose kind is the same in all versions of Unicode in use; of others nothing is said here.
_SETTLED = [(0, 0x370), (0x400, 0x530), (0x2010, 0x2028), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]


def _kinds() -> np.ndarray:
    kinds = np.zeros(0xD7A5, np.uint8)  # the last one stands for all above
    for lo, hi in _SETTLED:
        for c in range(lo, hi):
            kinds[c] = SPACE if c in _SPACES else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    return kinds


KIND = _kinds()
_BLANK = np.isin(np.arange(256), [*range(9, 14), 0x20])
#: What no stretch ends with: white space, and what some take for it.
_JOINS = _BLANK | np.isin(np.arange(256), range(0x1C, 0x20))
_WIDE = np.array([int.from_bytes(chr(c).encode(), "big") for c in _SPACES if c > 0x7F], np.int64)


def inside(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value begins and the last one ends) of a large binary array."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def shares(texts: pa.Array, size: int = AT_ONCE) -> Iterator[pa.Array]:
    """The texts as large binaries in order, nulls empty, in slices of at most size bytes; a longer text stands alone."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends = inside(texts)
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(ends, ends[at] + size, "right")) - 1, at + 1)
        yield texts.slice(at, to - at)
        at = to


def stretches(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(stretches of all texts, where those of each text begin and the last ones end): cut where white space follows other characters.

    No piece of a byte-level tokenizer lies across such a cut, and none beside it is another one for the rest of the text
    (only white space is matched by what follows it, and no stretch but a text's last one ends with any).
    """
    raw, ends = inside(texts)
    cut = np.zeros(len(raw) + 1, bool)
    at = np.flatnonzero(_BLANK[raw[1:]] & ~_JOINS[raw[:-1]]) + 1
    wide = raw[at - 1] > 0x7F
    if wide.any():  # is the character before a white space of more than one byte?
        b = [raw[np.maximum(at[wide] - k, 0)].astype(np.int64) for k in (1, 2, 3)]
        before = b[0] | b[1] << 8
        at = np.delete(at, np.flatnonzero(wide)[np.isin(before, _WIDE) | np.isin(before | b[2] << 16, _WIDE)])
    cut[at] = True
    cut[ends] = True
    begins = np.flatnonzero(cut[:-1])
    bounds = np.append(begins, len(raw))
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
    return words.dictionary_encode(), np.searchsorted(begins, ends)


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, the byte each begins at and the last one ends at, the word of each) of words that are not empty."""
    raw, ends = inside(words)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    first = np.searchsorted(at, ends)
    return points, at, np.repeat(np.arange(len(words)), np.diff(first))


def kinds(points: np.ndarray) -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE; 0 where versions of Unicode may not agree."""
    return KIND[np.minimum(points, len(KIND) - 1)]


def piece_starts(points: np.ndarray, kind: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character, each word being a text of its own: the pieces of ``bpefit.WORD``."""
    n = len(points)
    start = np.ones(n, bool)
    if n < 2:
        return start
    space, fresh = kind == SPACE, np.append(True, word[1:] != word[:-1])
    follows = np.append(~fresh[1:] & ~space[1:], False)  # another character than white space comes next
    here, before = slice(1, None), slice(None, -1)
    start[here] = np.where(space[here], ~space[before] | follows[here], np.where(space[before], points[before] != 0x20, kind[here] != kind[before])) | fresh[here]
    mark = np.flatnonzero(start & (points == 0x27))

    def ahead(k: int) -> np.ndarray:
        to = np.minimum(mark + k, n - 1)
        return np.where((mark + k < n) & (word[to] == word[mark]), points[to], 0)

    one, two = ahead(1), ahead(2)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where((np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))), 3, 0))
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    ends = mark + size
    start[ends[ends < n]] = True
    return start
