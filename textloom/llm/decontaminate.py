"""Benchmark decontamination by spaced-seed hashing.

A mask says which words of a window count; the others are ignored, so a few substituted words don't hide a
copied passage.  Hashes of all masks at all places of the benchmark meet those of the documents, and around
each hit the benchmark item and the document are compared word by word along the hit's diagonal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, numbered, table



def _masks(weight: int, span: int) -> tuple[str, ...]:
    """All masks of ``weight`` words in a window of ``span`` that begin and end with one."""
    inner = ((n, c) for n in range(weight, span + 1) for c in combinations(range(1, n - 1), weight - 2))
    return tuple("1" + "".join("1" if i in c else "0" for i in range(1, n - 1)) + "1" for n, c in inner)


#: Any 6 of 8 words.  A best segment that counts has such a window: of 16 words on, as 6 of 8 are three quarters; the
#: shorter ones have up to 3 unequal words, which can't be in every window without splitting the segment.
MASKS = _masks(6, 8)
#: An item of 6 words needs any 5.
SHORT = _masks(5, 6)
MIN_MATCHED, MIN_IDENTITY, MISMATCH = 10, 0.75, 2

_LOWER = np.zeros(256, np.uint8)  # 0: between words
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _LOWER[_c] = _c
_LOWER[65:91] = np.arange(97, 123)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _R), ("down", _R_INV)):
                p = np.full(n, base)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of each word: runs of letters, digits and non-ASCII bytes, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.concatenate(([False], b != 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _Powers.to(len(b) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(b.astype(np.uint64) * up[: len(b)], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29)), starts


#: Odd multipliers of the words of a window, by place; a seed is a sum of products, so masks share them.
_PLACES = np.random.default_rng(2718).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def seed_hashes(words: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray]]:
    """For each mask the hashes of the words that it keeps, at every place that its span fits.

    Seeds only propose: what they find is compared word by word.
    """
    wide = max((len(m) for m in masks), default=0)
    parts = [words * _PLACES[i] for i in range(min(wide, len(words)))]
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = parts[0][:n] + np.uint64(sum(2 << i for i, c in enumerate(mask) if c == "1"))
        for i, c in enumerate(mask[1:], 1):
            if c == "1":
                h += parts[i][i : i + n]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        yield mask, h


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n words, of which each overlap that counts has one; an item of under 6 words is taken whole."""
    return MASKS if n > 6 else SHORT if n == 6 else ("1" * n,)


def best_overlap(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matched) of the segment of largest matched - MISMATCH * mismatched words."""
    gain = np.where(same, 1, -MISMATCH)
    total = np.concatenate(([0], np.cumsum(gain)))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.argmin(total[:end]))
    return start, end, int(same[start:end].sum())


def contaminated(matched: int, length: int, item_words: int) -> bool:
    return matched >= min(MIN_MATCHED, -(-item_words * 3 // 4) if item_words >= 6 else item_words) and matched >= MIN_IDENTITY * length


ITEMS = "item_id long, words binary, n int"
SEEDS = "hash long, item long, place int, n int"


def benchmark_items(benchmark: DataFrame, scratch: Scratch, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, item_id, n_items, words, n): one row for each distinct sequence of words, with the least id of those that have it.

    Null texts and texts without a word have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes((t.as_py() or "").encode())[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int32())], names=["item_id", "words", "n"])

    read = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).alias("text")).mapInArrow(run, ITEMS).filter("n > 0")
    return numbered(read.groupBy("words", "n").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items")), scratch, "items", "item")


def membership(benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """(item_id, reported_id) of every item with words: items of equal words are reported under the least of their ids."""
    scratch = Scratch(spark, "members")
    items = benchmark_items(benchmark, scratch).select("words", F.col("item_id").alias("reported_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_hashes((t.as_py() or "").encode())[0].tobytes() for t in batch.column(1)], pa.binary())], names=["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, words binary").join(items, "words").select("item_id", "reported_id")


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, raw, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for _, h in seed_hashes(np.frombuffer(raw, np.uint64), masks_for(n)):
                m = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(m, item, np.int64)), pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, n, np.int32))], names=["hash", "item", "place", "n"])


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), (h * _R) >> np.uint64(64 - bits)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of two probes: each task's bits are sent as one array of 2^bits bits, whatever the benchmark's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["bits"])

    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in seeds.select("hash").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return whole


#: Bits of the filter: enough for the benchmark's seeds up to the larger number, beyond which it lets more through.
FILTER_BITS = (20, 27)
HITS = "doc_id long, words binary, hits array<struct<hash:bigint,place:int>>"
OVERLAPS = "row long, doc_id long, item long, n_matched long, doc_word long, item_word long, n_words long"


def overlaps(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, batch_bytes: int = 1_000_000) -> DataFrame:
    """One row for each document and benchmark item that it holds a passage of: the overlap with most equal words.

    ``doc_word`` and ``item_word`` are the places (in words) where it begins, ``n_words`` its length, ``n_matched``
    the equal words in it and ``n_items`` how many items have these words (``membership`` tells which).  A passage
    counts from 10 equal words and 75 % of its length on; an item of 6 to 12 words needs three quarters of its
    words, a shorter one all.  Null texts hold none; a document given twice is reported twice, also without an id;
    empty tables give no rows.

    Seeds of the documents that pass a filter of the benchmark's, of bounded size, are joined with those on their
    hash; then only the words along each hit's diagonal are joined with the item's words and compared.
    """
    scratch = Scratch(spark, "overlaps")
    items = benchmark_items(benchmark, scratch)
    seeds = scratch.keep(items.select("item", "words", "n").mapInArrow(_seed_rows, SEEDS), "seeds")
    about = items.agg(F.sum("n").alias("w"), F.array_sort(F.collect_set(F.when(F.col("n") <= 6, F.col("n")))).alias("short"), F.max("n").alias("most")).first()
    sizes = [*about["short"], *([7] if (about["most"] or 0) > 6 else [])]
    masks = tuple(dict.fromkeys(m for n in sizes for m in masks_for(n)))
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (len(masks) * (about["w"] or 1) * 64).bit_length()))
    held = spark.sparkContext.broadcast(_bitmap(seeds, bits))  # 2^27 bits at most

    def found(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        words, starts = word_hashes(b" ".join(texts))
        cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        filter_, hashes, places, spans = held.value, [], [], []
        for mask, h in seed_hashes(words, masks):
            first, second = _probes(h, bits)
            at = np.flatnonzero(filter_[(first >> np.uint64(3)).astype(np.int64)] >> (first & np.uint64(7)).astype(np.uint8) & 1)
            p = second[at]
            at = at[(filter_[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1) > 0]
            hashes.append(h[at])
            places.append(at)
            spans.append(np.full(len(at), len(mask)))
        if not hashes:
            return pa.RecordBatch.from_pylist([], schema=HIT_SCHEMA)
        h, p, n = (np.concatenate(x) for x in (hashes, places, spans))
        doc = np.searchsorted(cuts, p, "right") - 1
        inside = p + n <= cuts[doc + 1]
        h, p, doc = h[inside], p[inside], doc[inside]
        order = np.argsort(doc, kind="stable")
        h, p, doc = h[order], p[order], doc[order]
        rows = []
        for d in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, (d, d + 1))
            hits = [{"hash": x, "place": y} for x, y in zip(h[a:b].view(np.int64).tolist(), (p[a:b] - cuts[d]).tolist())]
            rows.append({"doc_id": ids[d], "words": words[cuts[d] : cuts[d + 1]].tobytes(), "hits": hits})
        return pa.RecordBatch.from_pylist(rows, schema=HIT_SCHEMA)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                if size and size + len(raw) > batch_bytes:
                    yield found(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(raw)
                size += len(raw)
            if ids:
                yield found(ids, texts)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit = numbered(narrow.mapInArrow(scan, HITS), scratch, "hits")
    met = hit.select("row", F.explode("hits").alias("h")).select("row", "h.hash", F.col("h.place").alias("at")).join(seeds, "hash")
    lines = met.groupBy("row", "item", "n", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.min("at").alias("at"))
    of = lines.groupBy("row").agg(F.collect_list(F.struct("item", "n", "diagonal", "at")).alias("lines"))  # of one document
    cut = hit.select("row", "doc_id", "words").join(of, "row").mapInArrow(_cut, "row long, doc_id long, item long, diagonal int, low int, at int, part binary")
    compared = cut.join(items.select("item", "words", "n"), "item").select("row", "doc_id", "item", "diagonal", "low", "at", "part", "words", "n").mapInArrow(_compare, OVERLAPS)
    best = compared.groupBy("row", "doc_id", "item").agg(F.max(F.struct("n_matched", (-F.col("doc_word")).alias("early"), "item_word", "n_words")).alias("b"))
    named = best.join(items.select("item", "item_id", "n_items"), "item")
    return named.select("doc_id", "item_id", (-F.col("b.early")).alias("doc_word"), "b.item_word", "b.n_words", "b.n_matched", "n_items")


HIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32())])))])
CUT_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item", pa.int64()), ("diagonal", pa.int32()), ("low", pa.int32()), ("at", pa.int32()), ("part", pa.binary())])
OVERLAP_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in OVERLAPS.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document's words that lie along each diagonal."""
    for batch in batches:
        for row, doc, raw, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            words = raw.as_py()
            out = []
            for x in lines.as_py():
                low, high = max(x["diagonal"], 0), min(x["diagonal"] + x["n"], len(words) // 8)
                out.append({"row": row, "doc_id": doc, "item": x["item"], "diagonal": x["diagonal"], "low": low, "at": x["at"], "part": words[8 * low : 8 * high]})
                if len(out) == 2_000:
                    yield pa.RecordBatch.from_pylist(out, schema=CUT_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=CUT_SCHEMA)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps that count, of the pieces of one diagonal each."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            part, item = np.frombuffer(r["part"], np.uint64), np.frombuffer(r["words"], np.uint64)
            begin = r["low"] - r["diagonal"]
            start, end, matched = best_overlap(part == item[begin : begin + len(part)])
            if contaminated(matched, end - start, r["n"]):
                out.append({"row": r["row"], "doc_id": r["doc_id"], "item": r["item"], "n_matched": matched, "doc_word": r["low"] + start, "item_word": begin + start, "n_words": end - start})
        yield pa.RecordBatch.from_pylist(out, schema=OVERLAP_SCHEMA)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every whole document with the benchmark."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage, with their columns as they are.

    Documents that share an id, null included, share its fate; null texts stay.
    """
    found = overlaps(docs, table(spark, sf_dir, "benchmark"), spark).select(F.col("doc_id").alias("_gone")).distinct()
    found = Scratch(spark, "contaminated").keep(found, "ids")  # its size is known then: no text moves for a few
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")), "left_anti").select(*docs.columns)
