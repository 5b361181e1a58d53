"""Best-fit packing by hierarchical residual packing.

Every partition best-fits its own pieces and emits the bins that are full enough; bins that are not become
items of the next round, where several partitions' leftovers meet, and so on up a tree.  A bin carries the
list of its pieces and their offsets (at most ``capacity`` of them, since a piece is never empty), so no
round needs a join, and a group holds at most ``group_items`` items in the mean, whatever the input's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, table
from textloom.llm.tokens import WordTokens

CAPACITY = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin long, fill long, done boolean, doc_ids array<long>, pieces array<int>, offsets array<long>, starts array<long>, lengths array<long>, crcs array<long>"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` tokens.

    A document is its ids and then END_ID; null text counts as empty (a single END_ID).  Only documents
    longer than ``capacity`` are cut, at its multiples.  ``ids_crc32`` is over little-endian uint32 ids.
    Repeated rows each give their own pieces; other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(tokenizer)
        last = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py()) + last
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the open bin that it leaves least room in."""
    order = np.argsort(-sizes, kind="stable")
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin with r places left exists
    for i in order.tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _merge(capacity: int, enough: int, level: int):
    def merge(part: pa.Table) -> pa.Table:
        fill = part.column("fill").to_numpy()
        names = ("doc_ids", "pieces", "offsets", "starts", "lengths", "crcs")
        flat, ends = {}, None
        for n in names:
            col = part.column(n).combine_chunks()
            flat[n] = col.flatten().to_numpy(zero_copy_only=False)
            ends = col.offsets.to_numpy() - col.offsets[0].as_py() if ends is None else ends
        bins = best_fit(fill, capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        heads = np.cumsum([0, *map(len, bins)])[:-1]
        placed = np.cumsum(fill[order]) - fill[order]
        fills = np.add.reduceat(fill[order], heads)
        base = placed - np.repeat(placed[heads], np.diff([*heads, len(order)]))
        counts = (ends[1:] - ends[:-1])[order]
        take = np.repeat(ends[:-1][order] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        flat = {n: v[take] for n, v in flat.items()}
        flat["offsets"] = flat["offsets"] + np.repeat(base, counts)
        cuts = pa.array(np.concatenate(([0], np.cumsum(np.add.reduceat(counts, heads)))), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(flat[n], pa.int32() if n == "pieces" else pa.int64())) for n in names]
        group = (level << 58) | (part.column("at")[0].as_py() << 30)  # one number for each bin of a run
        return pa.Table.from_arrays([pa.array(group + np.arange(len(bins)), pa.int64()), pa.array(fills, pa.int64()), pa.array(fills >= enough), *lists], names=["bin", "fill", "done", *names])

    return merge


def pack(pieces: DataFrame, spark: SparkSession, capacity: int = CAPACITY, group_items: int = 20_000, slack: tuple[float, ...] = (0.005, 0.02, 0.05)) -> DataFrame:
    """Packs pieces into sequences; adds ``sequence_id`` and the gapless ``offset`` to the columns of PIECES.

    Round r closes bins with at most ``slack[r]`` of the capacity left; the last round closes all.  The
    number of groups follows the number of items left, so that leftovers of several groups meet in one and a
    group stays bounded; what a group can't fill costs one underfull sequence each in the last round.
    An empty input gives no rows.  Lengths over ``capacity`` are refused.
    """
    scratch = Scratch(spark, "pack")
    held = scratch.keep(pieces, "pieces")
    n, longest = held.agg(F.count("*"), F.max("length")).first()
    if (longest or 0) > capacity:
        raise ValueError(f"a piece of {longest} tokens does not fit {capacity}")
    one = lambda c: F.array(F.col(c))
    items = held.select(F.col("length").alias("fill"), F.lit(False).alias("done"), one("doc_id").alias("doc_ids"), one("piece").alias("pieces"), F.array(F.lit(0).cast("long")).alias("offsets"), one("start").alias("starts"), one("length").alias("lengths"), one("ids_crc32").alias("crcs"))
    full: list[DataFrame] = []
    for r, room in enumerate((*slack, None)):
        groups = max(1, -(-n // group_items))
        enough = 0 if room is None else int(capacity * (1 - room))
        # a group is drawn by the item's own identity, so that a rerun of a lost task deals alike
        dealt = items.withColumn("at", F.pmod(F.xxhash64(F.col("doc_ids")[0], F.col("pieces")[0], F.lit(r)), F.lit(groups)))
        work = _merge(capacity, enough, r)
        packed = scratch.keep(dealt.groupBy("at").applyInArrow(work, BINS), f"round{r}")
        scratch.drop("pieces" if r == 0 else f"open{r - 1}")
        full.append(packed.filter("done"))
        if room is None:
            break
        items = scratch.keep(packed.filter("not done"), f"open{r}")
        n = items.count()
    bins = full[0]
    for more in full[1:]:
        bins = bins.unionByName(more)
    cells = bins.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("doc_ids", "pieces", "starts", "lengths", "crcs", "offsets")).alias("x"))
    return cells.select("x.doc_ids", "x.pieces", "x.starts", "x.lengths", "x.crcs", "sequence_id", "x.offsets").toDF("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()), spark)
