"""Removal of long repeated byte strings by difference-cover suffix arrays.

Sorting every suffix of a large corpus would move many times its size, and all but a few suffixes cannot
share ``length`` bytes with another.  So the text is first reduced without loss.  Each window of ``length``
bytes is owned by the least-hash gram (the core) inside it; equal windows have equal cores at equal places.
Cores that occur once rule their windows out: equal bytes have equal hashes, so the core hash decides on
nothing else.  Copies of a block are recognised by a 128-bit BLAKE2 digest of its bytes under a key drawn for the
run, and held once.  What is left are blocks that share a core and differ around it, at the ends of repeated
passages.  A core's bytes are named, equal bytes alike, and stand as one symbol in their blocks.  The blocks'
suffixes are sorted by difference cover: the triples of the sampled places (1 and 2 modulo 3) are sorted and
named, names are recursed on until they span a window, the remaining suffixes are merged in, and prefixes of
neighbours are compared symbol by symbol.  Blocks are dealt to tasks by their core, so equal windows meet; a core
with very many blocks is dealt further by the hash of each window.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, numbered, shuffle_parts, table

LENGTH = 400
CORE = 288
#: Blocks of one core that a task may hold; more are dealt by window.
GROUP = 2_000
#: A block of more copies than this, or than this share of all, is met by broadcast rather than by a shuffle.
HOT, HOT_SHARE = 1_000, 10_000
#: Windows looked at in one piece of a text, and bytes sorted in one suffix array.
PIECE, BATCH = 1 << 22, 6_000_000
_R = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place on, by doubling."""
    power, step, span = raw.astype(np.uint64) + np.uint64(1), _R, 1
    out, done = None, 0
    while True:
        if size & span:
            n = len(raw) - size + 1
            part = power[done : done + n]
            out = part.copy() if out is None else out * step + part
            done += span
        if span * 2 > size:
            break
        power = power[:-span] * step + power[span:]
        step, span = np.uint64(int(step) ** 2 % (1 << 64)), span * 2
    out ^= out >> np.uint64(33)
    out *= _A
    out ^= out >> np.uint64(29)
    out *= _B
    return out ^ (out >> np.uint64(32))


def anchors(text: bytes, key: bytes, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """(core hash, two halves of the block's digest, core place, first window, last window) of each run of windows with one core."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(5)))
    out = []
    for a in range(0, n, PIECE):
        part = raw[a : min(n, a + PIECE) + length - 1]
        h = gram_hashes(part, core)
        width = length - core + 1
        # the place in the low bits makes the leftmost of equal hashes least
        rank = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        least, span = rank, 1
        while span * 2 <= width:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        m = len(part) - length + 1
        least = np.minimum(least[:m], least[width - span : width - span + m])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [m])) - 1
        blake = hashlib.blake2b
        digest = b"".join([blake(text[x:y], digest_size=16, key=key).digest() for x, y in zip((first + a).tolist(), (last + a + length).tolist())])
        halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
        out.append((h[at[first]], halves[:, 0], halves[:, 1], at[first] + a, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*out))


ANCHORS = "core long, hi long, lo long, place long, first long, last long, row long"


def _anchor_rows(key: bytes, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ANCHORS.split(", ")]
        for batch in batches:
            rows, held = [], 0

            def out() -> pa.RecordBatch:
                c = [np.concatenate(x) for x in zip(*rows)]
                return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in c], names=names)

            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = anchors((text.as_py() or "").encode(), key, length)
                if len(found[0]):
                    rows.append((*found, np.full(len(found[0]), row, np.int64)))
                    held += len(found[0])
                    if held > 200_000:
                        yield out()
                        rows, held = [], 0
            if rows:
                yield out()

    return run


def suffix_order(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of all suffixes by their first ``length`` symbols at least, by difference cover modulo 3.

    ``text`` holds positive numbers; symbols past its end count as 0.  Suffixes alike in ``length`` symbols
    may stand in any order.
    """
    return _order(text.astype(np.int64), length)


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Names from 1 on of tuples in their order; the first key weighs most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def _triples(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    top = int(t.max(initial=0)) + 1
    if top**3 < 1 << 62:
        return _rank((t[at] * top + t[at + 1]) * top + t[at + 2])
    return _rank(t[at], t[at + 1], t[at + 2])


def _order(text: np.ndarray, length: int) -> np.ndarray:
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate((text, np.zeros(3, np.int64)))
    one = np.arange(1, n + (n % 3 == 1), 3)  # a place past the end keeps the two runs of names apart
    two = np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    name = _triples(t, sample)
    if length > 3 and name.max() < len(name):
        order = _order(name, -(-length // 3))
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    zero = np.arange(0, n, 3)
    # merging by counts: a place 0 stands after its own kind by (symbol, rank), after places 1 by the same and after places 2 by (two symbols, rank)
    one, two = one[one < n], two
    a = _rank_pairs(t, rank, np.concatenate((zero, one)), 1)
    b = _rank_pairs(t, rank, np.concatenate((zero, two)), 2)
    own = np.concatenate((one, two))
    own = own[np.argsort(rank[own], kind="stable")]
    # how many of each kind come before each place 0
    ones, twos = np.sort(a[len(zero) :]), np.sort(b[len(zero) :])
    before = np.searchsorted(ones, a[: len(zero)]) + np.searchsorted(twos, b[: len(zero)])
    inner = np.argsort(a[: len(zero)], kind="stable")
    out = np.empty(n, np.int64)
    spots = np.maximum.accumulate(before[inner]) + np.arange(len(zero))
    out[spots] = zero[inner]
    free = np.ones(n, bool)
    free[spots] = False
    out[free] = own
    return out


def _rank_pairs(t: np.ndarray, rank: np.ndarray, at: np.ndarray, ahead: int) -> np.ndarray:
    if ahead == 1:
        return _rank(t[at], rank[at + 1])
    return _rank(t[at], t[at + 1], rank[at + 2])


def repeated_starts(blocks: list[tuple[bytes, int]], length: int = LENGTH, core: int = CORE) -> list[np.ndarray]:
    """For each block (its bytes, the place of its core), whether the ``length`` bytes from each place on also start elsewhere in the blocks.

    Only starts whose window holds the block's core are asked for.  Cores of equal bytes are one symbol.
    """
    names: dict[bytes, int] = {}
    texts = []
    for raw, at in blocks:
        x = np.frombuffer(raw, np.uint8).astype(np.int64) + 2
        name = 258 + names.setdefault(raw[at : at + core], len(names))
        texts.append(np.concatenate((x[:at], [name], x[at + core :], [1])))
    span = length - core + 1
    text = np.concatenate(texts)
    size = np.array([len(x) - 1 for x in texts])
    begin = np.cumsum(size + 1) - size - 1
    order = suffix_order(text, span)
    wide = np.uint64(max(9, int(text.max()).bit_length()))
    pack = 64 // int(wide)
    raw = np.concatenate((text, np.zeros(8, np.int64))).astype(np.uint64)
    word = np.zeros(len(text), np.uint64)
    for k in range(pack):
        word = (word << wide) | raw[k : k + len(text)]
    room = np.repeat(begin + size - span, size + 1) >= np.arange(len(text))
    order = order[room[order]]  # only places with enough symbols left in their block
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in [*range(0, max(span - pack, 1), pack), max(span - pack, 0)]:
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = word[order[live] + k] == word[order[live + 1] + k]
    hit = np.zeros(len(text), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]


BLOCKS = "core long, salt int, row long, first long, at int, raw binary"


def _cut(length: int):
    """Bytes of each block of a document; those of a large core once for each salt that its windows fall to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for row, text, items in zip(*(batch.column(i) for i in range(3))):
                raw = (text.as_py() or "").encode()
                for x in items.as_py():
                    part = raw[x["first"] : x["last"] + length]
                    salts = [0]
                    if x["n"] > GROUP:
                        salts = np.unique(gram_hashes(np.frombuffer(part, np.uint8), length) % np.uint64(-(-x["n"] // GROUP))).tolist()
                    rows += [(x["core"], s, row.as_py(), x["first"], x["place"] - x["first"], part) for s in salts]
                    held += len(part) * len(salts)
                    if held > 16_000_000:
                        yield out(rows)
                        rows, held = [], 0
            yield out(rows)

    return run


def _sort_blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            # a block of a large core can be here under several salts: once is enough, and twice would repeat itself
            rows = list({(r[2], r[3]): r for r in rows}.values())
            found = repeated_starts([(r[5], r[4]) for r in rows], length)
            out = []
            for r, hit in zip(rows, found):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                out += [(r[2], r[3] + int(a), r[3] + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]
            cols = zip(*out) if out else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size > BATCH and row[:2] != held[-1][:2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return run


def repeats(rows: DataFrame, spark: SparkSession, length: int = LENGTH) -> DataFrame:
    """(row, a, b): byte ranges of each text of rows (row, text) that lie under repeated strings of ``length`` bytes; ranges may overlap."""
    scratch = Scratch(spark, "suffixes")
    found = scratch.keep(rows.select("row", "text").mapInArrow(_anchor_rows(os.urandom(16), length), ANCHORS), "anchors")
    # read from a table, so that the join deals its rows anew and a common core's can be split
    cores = scratch.keep(found.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").select("core"), "cores")
    shared = scratch.keep(found.join(cores, "core", "left_semi"), "shared")
    scratch.drop("anchors")
    scratch.drop("cores")
    item = F.struct("row", "first", "last", "place")
    blocks = scratch.keep(shared.groupBy("core", "hi", "lo").agg(F.count("*").alias("c"), F.min(item).alias("x")), "blocks")
    key = ["core", "hi", "lo"]
    copied = scratch.keep(blocks.filter("c > 1").select(*key, "c"), "copied")
    # blocks of very many copies are HOT_SHARE at most, so they are broadcast and their rows need not meet
    bar = max(HOT, (copied.agg(F.sum("c")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(copied.filter(F.col("c") > bar).drop("c"))
    few = shared.join(hot, key, "left_anti").join(copied.filter(F.col("c") <= bar).drop("c"), key, "left_semi")
    whole = shared.join(hot, key, "left_semi").unionByName(few).select("row", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    # blocks that occur once, and one of each other block of their cores to compare them with
    mixed = blocks.groupBy("core").agg(F.count_if(F.col("c") == 1).alias("s"), F.count("*").alias("n")).filter("s > 0 and n > 1")
    mixed = scratch.keep(mixed.select("core", "n"), "mixed")
    open_ = blocks.join(mixed, "core").select("core", "n", "x.*")
    items = open_.groupBy("row").agg(F.collect_list(F.struct("core", "n", "first", "last", "place")).alias("items"))  # of one document
    cut = rows.join(items, "row").select("row", "text", "items").mapInArrow(_cut(length), BLOCKS)
    met = cut.repartition(shuffle_parts(spark), "core", "salt").sortWithinPartitions("core", "salt")
    edges = met.mapInArrow(_sort_blocks(length), "row long, a long, b long")
    ranges = scratch.keep(whole.unionByName(edges), "ranges")
    for name in ("shared", "blocks", "copied", "mixed"):
        scratch.drop(name)
    return ranges


KEPT = "doc_id long, kept binary, spans array<struct<a: long, b: long>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text and the runs taken out of it; ranges that overlap or touch are one run."""
    names = [x.split()[0] for x in KEPT.split(", ", 2)]
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds)], names=names)

    for batch in batches:
        rows, held = [], 0
        for doc, text, ranges in zip(*(batch.column(i) for i in range(3))):
            raw = (text.as_py() or "").encode()
            runs: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in ranges.as_py() or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])) if runs else raw
            rows.append((doc.as_py(), kept, [{"a": a, "b": b} for a, b in runs]))
            held += len(kept)
            if held > 16_000_000:
                yield out(rows)
                rows, held = [], 0
        yield out(rows)


def without_repeats(docs: DataFrame, spark: SparkSession, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, spans): the bytes left of every text and its removed runs, as byte places a to b of the input, b excluded.

    Null counts as empty; texts shorter than ``length`` keep all.  Each row is a text of its own, so ids may be null
    or repeat and a repeated row is a copy.  Other columns are not read; an empty table gives no rows.  A run may begin
    or end inside a character, so what is kept need not be UTF-8.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scratch(spark, "texts"))
    ranges = repeats(rows, spark, length).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # of one document
    return rows.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(_remove, KEPT)


def digests() -> list[Column]:
    """Bytes, removed bytes, removed runs and the digest of what is kept, from the columns of ``without_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return [
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    ]


def remove_repeats(docs: DataFrame, spark: SparkSession, length: int = LENGTH) -> DataFrame:
    """The digests of ``without_repeats``, of every text."""
    return without_repeats(docs, spark, length).select("doc_id", *digests())


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings removed from every document: digests, removed runs (start:end in bytes) and what is kept as text.

    A character that was cut into stands as U+FFFD in ``kept_text``; ``kept_sha256`` is of the bytes.
    """
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",")
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return without_repeats(table(spark, sf_dir, "documents"), spark).select("doc_id", *digests(), spans.alias("spans"), text.alias("kept_text"))
