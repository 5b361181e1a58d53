"""Character vocabularies, histograms and smoothed n-gram baselines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.bpe import portions
from textloom.operators.splits import hash_split
from textloom.sources.scratch import Scratch

#: Characters whose grams are counted at once in a task.
AT_ONCE = 1 << 21


def characters(df: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n): how often each character occurs."""
    return counted(df, (1,), text).groupBy("gram").agg(F.sum("n").alias("n")).withColumnRenamed("gram", "ch")


def counted(df: DataFrame, orders: tuple[int, ...], text: str = "text", held: str | None = None) -> DataFrame:
    """(gram, n, m): grams of several orders with how often they occur in rows that are not held and in those that are.

    A gram has a row for each run of texts that is counted at once, so the rows are yet to be summed.  Only a
    run's distinct grams leave its task, not a row for each place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sides = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for side in (False, True):
                for some in portions([t for t, h in zip(texts, sides) if t and h is side], AT_ONCE):
                    for order in orders:
                        grams, n = gram_counts(some, order)
                        none = np.zeros(len(n), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(none if side else n), pa.array(n if side else none)], names=["gram", "n", "m"])

    return df.select(F.col(text).alias("t"), (F.col(held) if held else F.lit(False)).alias("h")).mapInArrow(run, "gram string, n long, m long")


def gram_counts(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """Distinct grams of texts and their counts; no gram goes over two texts.  A gram is a number to the base of the alphabet."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    alphabet = np.flatnonzero(np.bincount(codes))
    place = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids, base = place[codes], len(alphabet)
    length = np.array([len(t) for t in texts], np.int64)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters up to the text's end
    at = np.flatnonzero(left >= order)
    key, size = ids[at], base
    for j in range(1, order):
        if size * base >= 1 << 62:
            names, key = np.unique(key, return_inverse=True)
            size = len(names)
        key, size = key * base + ids[at + j], size * base
    if size <= 1 << 22:
        n = np.bincount(key)
        found = np.flatnonzero(n)
        first = np.zeros(len(n), np.int64)
        first[key] = at  # any of a gram's places
        n, first = n[found], first[found]
    else:
        _, which, n = np.unique(key, return_index=True, return_counts=True)
        first = at[which]
    flat = codes[first[:, None] + np.arange(order)].tobytes().decode("utf-32-le")
    return [flat[i : i + order] for i in range(0, len(flat), order)], n.astype(np.int64)


def grams(df: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(gram, n) over each text's own characters."""
    return counted(df, (order,), text).groupBy("gram").agg(F.sum("n").alias("n"))


def contexts(counts: DataFrame, order: int) -> DataFrame:
    """(ctx, d): folded from the gram counts, so that each context's distribution sums to one."""
    return counts.groupBy(F.substring("gram", 1, order - 1).alias("ctx")).agg(F.sum("n").alias("d"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(ch, id): distinct characters in code point order.  An alphabet is bounded by Unicode, so one task numbers it."""
    chars = characters(df, text)
    ordered = chars.agg(F.array_sort(F.collect_set("ch")).alias("all"))
    return ordered.select(F.posexplode("all").alias("id", "ch")).select("ch", F.col("id").cast("long").alias("id"))


def unknown_characters(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ch, n, first_pos) of characters without an id, by first appearance."""
    chars = df.select("doc_id", F.posexplode(F.split(text, "")).alias("pos", "ch")).filter("ch <> ''")
    seen = chars.groupBy("doc_id", "ch").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))
    return seen.join(F.broadcast(vocab), "ch", "left_anti")  # an alphabet


def baselines(df: DataFrame, seed: int, fraction: float, order: int = 3) -> DataFrame:
    """Uniform, frequency and n-gram cross-entropy of the validation side, in nats, bits and choices.

    Characters and grams of both sides are counted in one pass over the texts and kept.  A context's grams are summed apart from
    its size, ln((n + 1) / (d + v)) being a difference, so that no gram meets its context in a join.
    """
    sided = hash_split(df, seed, fraction).select("text", (F.col("split") == "val").alias("held"))
    every = counted(sided, tuple({1, order}), held="held").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    every = Scratch(df.sparkSession, "grams").keep(every, "counts")
    chars = every.filter(F.length("gram") == 1).withColumnRenamed("gram", "ch")
    whole = chars.agg(F.count("*").alias("v"), F.sum("n").alias("t"))  # one row
    v = whole.select("v")
    freq = chars.crossJoin(whole).agg((-F.sum(F.col("m") * F.ln((F.col("n") + 1) / (F.col("t") + F.col("v")))) / F.sum("m")).alias("nats"))
    counts = every.filter(F.length("gram") == order)
    ctx = counts.groupBy(F.substring("gram", 1, order - 1).alias("ctx")).agg(F.sum("n").alias("d"), F.sum("m").alias("m"), F.sum(F.col("m") * F.ln(F.col("n") + 1)).alias("s"))
    tri = ctx.crossJoin(v).agg(((F.sum(F.col("m") * F.ln(F.col("d") + F.col("v"))) - F.sum("s")) / F.sum("m")).alias("nats"))
    named = v.select(F.lit("uniform").alias("model"), F.ln("v").alias("nats")).unionByName(freq.select(F.lit("frequency").alias("model"), "nats")).unionByName(tri.select(F.lit(f"{order}-gram").alias("model"), "nats"))
    return named.select("model", F.round("nats", 9).alias("nats"), F.round(F.col("nats") / F.ln(F.lit(2.0)), 9).alias("bits"), F.round(F.exp("nats"), 7).alias("choices"))


def closed_fraction(df: DataFrame) -> DataFrame:
    """How much of the way from a baseline to a floor a model goes: null and a reason where there is no way to go."""
    way = F.col("baseline") - F.col("floor")
    return df.withColumn("closed", F.when(way > 0, F.round((F.col("baseline") - F.col("nats")) / way, 9))).withColumn("reason", F.when(way <= 0, "no distance to close"))
