"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The perfect binary Golay code (23, 12) puts every 23-bit word within 3 bits of exactly one codeword.  The
codewords nearest to the words within one bit of x (one or six of them) are x's indices; two words within
two bits of each other share one at least.  A 64-bit fingerprint is three segments of 23, 23 and 18 bits.
Of two errors at most, one segment has none and any other has two at most, so a key is one segment as it is
and an index of another.  Rows with equal keys meet in sorted order, are compared exactly, and each bucket
gives only a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, shuffle_parts, table
from textloom.llm.components import buckets, components, dealt

SEED = 42
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BITS = 23


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit syndrome (11 bits) the error pattern of weight 3 at most, and for each byte-wise part of a word its syndrome."""

    def remainder(word: int) -> int:
        for bit in range(BITS - 1, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    one = np.array([remainder(1 << i) for i in range(BITS)], np.uint32)
    words = np.arange(1 << 12, dtype=np.uint32)
    low = np.zeros(1 << 12, np.uint32)
    high = np.zeros(1 << 12, np.uint32)
    for i in range(12):
        low ^= np.where(words >> np.uint32(i) & 1, one[i], 0).astype(np.uint32)
        if 12 + i < BITS:
            high ^= np.where(words >> np.uint32(i) & 1, one[12 + i], 0).astype(np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    for a in range(BITS):
        for b in range(a, BITS):
            for c in range(b, BITS):
                e = (1 << a) | (1 << b) | (1 << c)
                errors[one[a] ^ (one[b] if b > a else 0) ^ (one[c] if c > b else 0)] = e
    errors[0] = 0
    return errors, np.stack([low, high])


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    if not _TABLES:
        _TABLES.append(_golay())
    errors, (low, high) = _TABLES[0]
    words = words.astype(np.uint32)
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of each word; a word with fewer repeats its first."""
    words = words.astype(np.uint32)
    ball = np.concatenate([words[:, None], words[:, None] ^ (np.uint32(1) << np.arange(BITS, dtype=np.uint32))[None, :]], axis=1)
    found = np.sort(golay_index(ball), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(fresh, axis=1) - 1
    out = np.repeat(found[:, :1], 6, axis=1)
    rows = np.nonzero(fresh)[0]
    out[rows, place[fresh]] = found[fresh]
    return out


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at runs of space and U+0009 to U+000D."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, space-joined; fewer words give one hash of them all, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def simhash(hashes: np.ndarray, block: int = 65_536) -> int:
    """64 bits, each set if it is set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    big = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(big), block):
        votes += np.unpackbits(big[a : a + block], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the whole text's fingerprint as a signed long; null text counts as empty, fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(shingle_hashes(words_of(t.as_py()), width)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    fp = fp.view(np.uint64)
    return [(fp & np.uint64(0x7FFFFF)), (fp >> np.uint64(23)) & np.uint64(0x7FFFFF), fp >> np.uint64(46)]


def _keys(fp: np.ndarray) -> np.ndarray:
    """(n, 18) keys: the exact segment, which it is, and an index of another one; -1 in place of repeats."""
    seg = _segments(fp)
    a, b = golay_indices(seg[0]).astype(np.uint64), golay_indices(seg[1]).astype(np.uint64)
    parts = []
    for which, (exact, fuzzy) in enumerate(((seg[0], b), (seg[1], a), (seg[2], a))):
        keys = (np.uint64(which) << np.uint64(40)) | (exact[:, None] << np.uint64(12)) | fuzzy
        keys = keys.astype(np.int64)
        keys[:, 1:][keys[:, 1:] == keys[:, :1]] = -1
        parts.append(keys)
    return np.concatenate(parts, axis=1)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys = _keys(fp)
        take = keys >= 0
        row = np.nonzero(take)[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys[take]), pa.array(node[row]), pa.array(fp[row])], names=["key", "node", "fp"])


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of a bucket's links, by search: each reached item is compared with those not reached yet."""
    left = np.arange(n)
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        hit = near(at, left)
        links += [(at, int(x)) for x in left[hit]]
        queue += left[hit].tolist()
        left = left[~hit]
    return links


def _link(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cuts, node, fp in buckets(batches, (1, 2), (0, 3, 4)):
            fp = fp.view(np.uint64)
            out: list[tuple[int, int]] = []
            two = cuts[:-1][np.diff(cuts) == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
            out += zip(node[two[near]].tolist(), node[two[near] + 1].tolist())
            for k in np.flatnonzero(np.diff(cuts) > 2):
                bits, name = fp[cuts[k] : cuts[k + 1]], node[cuts[k] : cuts[k + 1]]
                out += [(int(name[x]), int(name[y])) for x, y in forest(len(bits), lambda i, left, bits=bits: np.bitwise_count(bits[left] ^ bits[i]) <= distance)]
            u, v = (np.array(c, np.int64) for c in (zip(*out) if out else ((), ())))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return link


def fuzzy_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(u, v) links between nodes whose fingerprints differ in ``distance`` (2 at most) bits or fewer; a spanning forest of each bucket.

    ``prints`` has (node, fp), one row for each distinct fingerprint.
    """
    if distance > 2:
        raise ValueError("the keys are complete up to 2 bits")
    spark = prints.sparkSession
    keyed = prints.select("node", "fp").mapInArrow(_emit_keys, "key long, node long, fp long")
    met = dealt(keyed, spark).repartition(shuffle_parts(spark), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return met.mapInArrow(_link(distance), "u long, v long").distinct()


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; fingerprints link at 2 differing bits or fewer."""
    return simhash_components(table(spark, sf_dir, "documents"), spark)


def simhash_components(docs: DataFrame, spark: SparkSession, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): the least doc_id reachable over links of fingerprints.

    Empty and null texts have fingerprint zero and link like any other; texts of any length are taken whole;
    repeated rows give repeated rows; a null id gives a row of its own but is no one's component_id unless its
    fingerprint links to no other id; an empty table gives none.  Equal fingerprints are one node, so copies are never expanded into pairs.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(fingerprints(docs, width), "prints")
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(spark, fuzzy_links(nodes, distance))
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
