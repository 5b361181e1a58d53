"""Elias-Fano coding of ascending numbers in numpy, kept in memory-mapped files and searched in bulk."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_U = np.uint64


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the code of ascending uint64 values, equal ones allowed: upper bits in unary, lower bits packed."""
    n = len(values)
    if not n:
        return {"upper": np.zeros(1, _U), "zeros": np.zeros(1, _U), "ones": np.zeros(1, _U), "low": np.zeros(2, _U), "shape": np.array([0, 0, 0], _U)}
    bits = max(0, (int(values[-1]) // n).bit_length() - 1)
    high = (values >> _U(bits)).astype(np.int64)
    flags = np.zeros(((int(high[-1]) + n + 1) // 64 + 1) * 64, np.uint8)
    flags[high + np.arange(n)] = 1
    upper = np.packbits(flags, bitorder="little").view(_U)
    ones = np.cumsum(np.bitwise_count(upper), dtype=np.uint64)
    ones = np.concatenate(([_U(0)], ones[:-1]))
    zeros = np.arange(len(upper), dtype=_U) * _U(64) - ones
    low, step = np.zeros((n * bits // 64 + 2) * 8, np.uint8), 1 << 16  # so many values fill whole bytes
    places = np.arange(bits, dtype=_U)
    for a in range(0, n if bits else 0, step):
        part = np.packbits(((values[a : a + step, None] >> places) & _U(1)).astype(np.uint8).reshape(-1), bitorder="little")
        low[a * bits // 8 : a * bits // 8 + len(part)] = part
    return {"upper": upper, "zeros": zeros, "ones": ones, "low": low.view(_U), "shape": np.array([n, bits, int(high[-1])], _U)}


class Code:
    """Searches a built code; its arrays may be memory-mapped."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.upper, self.zeros, self.ones, self.low = parts["upper"], parts["zeros"], parts["ones"], parts["low"]
        self.n, self.bits, self.top = (int(x) for x in parts["shape"])

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one or zero of the upper bits."""
        before = self.ones if ones else self.zeros
        w = np.searchsorted(before, k, side="right") - 1
        rest = k - before[w]
        word, place = self.upper[w] if ones else ~self.upper[w], np.zeros(len(k), _U)
        for s in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word & _U((1 << s) - 1)).astype(_U)
            go = rest >= below
            rest -= np.where(go, below, _U(0))
            step = np.where(go, _U(s), _U(0))
            word >>= step
            place += step
        return w.astype(_U) * _U(64) + place

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values of the given ranks."""
        i = i.astype(_U)
        return ((self._select(i, True) - i) << _U(self.bits)) | self._lower(i)

    def _lower(self, i: np.ndarray) -> np.ndarray:
        at = i * _U(self.bits)
        w, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        # a shift by 64 is undefined, so the second word goes in two steps
        both = (self.low[w] >> shift) | ((self.low[w + 1] << _U(1)) << (_U(63) - shift))
        return both & _U((1 << self.bits) - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Rank of each value, -1 if it isn't there: the upper bits give its stretch, which is halved by lower bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = values >> _U(self.bits)
        row = np.flatnonzero(high <= _U(self.top))
        high, want = high[row], values[row] & _U((1 << self.bits) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high, _U(1)) - _U(1), False) - high + _U(1), _U(0)).astype(np.int64)
        end = (self._select(high, False) - high).astype(np.int64)
        hi, live = end.copy(), np.flatnonzero(lo < end)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lower(mid.astype(_U)) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < end)
        there = there[self._lower(lo[there].astype(_U)) == want[there]]
        out[row[there]] = lo[there]
        return out


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of all arrays, put in place whole, so that a task that runs twice does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    heads, at = {}, 0
    for k, a in arrays.items():
        heads[k] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 8) * 8
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        head = json.dumps(heads).encode()
        f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain view of the mapping: indexing it is faster
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = 8 + -(-size // 8) * 8
    return {k: raw[start + at : start + at + n * np.dtype(t).itemsize].view(t) for k, (at, t, n) in json.loads(raw[8 : 8 + size].tobytes()).items()}
