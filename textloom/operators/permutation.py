"""The order of an epoch as a keyed permutation: place to row and row to place by arithmetic, without a sort.

A Feistel network permutes the numbers of an even count of bits; one that falls outside the range is sent through
again until it falls inside (cycle walking), which makes it a permutation of the range itself.  The smallest
network that covers n numbers has fewer than 4 n, so four passes are usual.  Each round adds to one half a
keyed linear function of the other, modulo a prime, without its low bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, PRIME, DROPPED = 8, (1 << 31) - 1, 5


def half_bits(n: int) -> int:
    """Bits of a half of the smallest network that covers n numbers."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """A factor (not 0) and a summand for each round, from the digest of seed, epoch and round."""
    out = []
    for r in range(ROUNDS):
        d = hashlib.sha256(f"{seed}:{epoch}:{r}".encode()).digest()
        out.append((1 + int.from_bytes(d[:4], "big") % (PRIME - 1), int.from_bytes(d[4:8], "big") % PRIME))
    return out


def _pass(x: np.ndarray, bits: int, key: list[tuple[int, int]], back: bool) -> np.ndarray:
    mask = np.int64((1 << bits) - 1)
    left, right = x >> bits, x & mask
    for a, b in reversed(key) if back else key:
        if back:
            left, right = right ^ (((left * a + b) % PRIME) >> DROPPED & mask), left
        else:
            left, right = right, left ^ (((right * a + b) % PRIME) >> DROPPED & mask)
    return left << bits | right


def permuted(x: np.ndarray, n: int, seed: int, epoch: int, back: bool = False) -> np.ndarray:
    """Where each of the numbers 0 to n - 1 goes in the epoch; ``back`` tells which number goes there."""
    if n > 1 << 62:
        raise ValueError("a half has 31 bits at most")
    out, bits, key = x.astype(np.int64), half_bits(n), keys(seed, epoch)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _pass(out[todo], bits, key, back)
        todo = todo[out[todo] >= n]
    return out


def with_places(rows: DataFrame, n: int, seed: int, epoch: int, number: str = "number", back: bool = False) -> DataFrame:
    """rows with ``place``, where the epoch's order puts their number (0 to n - 1); a map over the rows, no shuffle.

    ``back``: the column holds places and ``place`` is the number that is there.  A null number has no place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(number)
            valid = given.is_valid().to_numpy(zero_copy_only=False)
            places = np.zeros(len(given), np.int64)
            places[valid] = permuted(given.drop_null().to_numpy(), n, seed, epoch, back)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, mask=~valid)], names=[*batch.schema.names, "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn(number, F.col(number).cast("long")).mapInArrow(run, f"{kinds.replace(f'`{number}` int', f'`{number}` bigint')}, place bigint")


def pass_sql(source: str, seed: int, epoch: int) -> str:
    """One pass over rows (id, n, h, x) as SQL, h being the bits of a half: a select a round."""
    mask = "((1::bigint << h) - 1)"
    out = f"select id, n, h, x >> h l, x & {mask} r from ({source})"
    for a, b in keys(seed, epoch):
        out = f"select id, n, h, r l, xor(l, (((r * {a} + {b}) % {PRIME}) >> {DROPPED}) & {mask}) r from ({out})"
    return f"select id, n, h, (l << h) + r x from ({out})"
