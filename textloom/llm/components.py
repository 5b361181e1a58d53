"""Connected components of a link table by alternating large-star and small-star rounds, and the dealing of large buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch


#: A node of more links than this, or than this share of all links, is met by broadcast rather than by a shuffle.
HOT, HOT_SHARE = 1_000, 10_000


def _star(edges: DataFrame, large: bool, n: int, scratch: Scratch, name: str) -> DataFrame:
    """Links each node's neighbours to the least one: the larger neighbours, or the smaller ones and itself.

    The least neighbour of a node is an aggregate, combined before the shuffle.  Nodes with very many links are
    2 * HOT_SHARE at most, whatever the input, so their least neighbours are broadcast and their links never
    meet in one task.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("m", "u").alias("m"), "d"), f"{name}-least")
    bar = max(HOT, n // HOT_SHARE)
    hot = F.broadcast(least.filter(F.col("d") > bar).select("u", F.col("m").alias("h")))  # 2 * HOT_SHARE rows at most
    marked = both.join(hot, "u", "left")
    many = marked.filter("h is not null").select("u", "v", F.col("h").alias("m"))
    few = marked.filter("h is null").select("u", "v").join(least.filter(F.col("d") <= bar).select("u", "m"), "u")
    joined = many.unionByName(few)
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable; nodes without a link are not listed.

    ``edges`` has long columns u and v.  Rounds end when the stars no longer change; each round's links are
    a table in the shared folder, and their number never exceeds that of the input.
    """
    scratch = Scratch(spark, "components")
    now = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links0")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(now)
    for r in range(1, rounds + 1):
        if not before[0]:
            break
        wide = scratch.keep(_star(now, True, before[0], scratch, f"large{r}"), f"wide{r}")
        now = scratch.keep(_star(wide, False, before[0], scratch, f"small{r}"), f"links{r}")
        after = print_of(now)
        for name in (f"links{r - 1}", f"wide{r}", f"large{r}-least", f"small{r}-least"):
            scratch.drop(name)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Rows of a bucket that a task holds at most; a larger one is dealt to pairs of its parts.
PART = 50_000


def dealt(keyed: DataFrame, spark: SparkSession, part: int | None = None) -> DataFrame:
    """keyed (key, node, ..) with (a, b): which pair of a bucket's parts a row is to be compared in.

    A bucket of ``part`` rows or fewer is one pair.  A larger one is cut into parts of about that size by hash, and
    each row goes to the pair of its part with every part, so every two rows of the bucket meet in some task and
    no task holds more than about twice ``part`` rows of it.  Large buckets are at most rows / part.
    """
    part = part or PART
    large = keyed.groupBy("key").count().filter(F.col("count") > part).select("key", F.ceil(F.col("count") / part).alias("parts"))
    found = keyed.join(F.broadcast(large), "key", "left")  # at most rows / part of them
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct(F.least(own, q).alias("a"), F.greatest(own, q).alias("b")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return found.withColumn("_p", F.explode(F.when(F.col("parts").isNull(), one).otherwise(pairs))).select(*keyed.columns, F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))


def buckets(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...], keys: tuple[int, ...]) -> Iterator[list]:
    """The given columns of whole runs of buckets, from rows sorted by ``keys``: first an array of bucket bounds.

    A bucket that goes over several batches is joined once, when it ends.
    """
    held: list[list] = []

    def joined() -> list:
        cols = [np.concatenate([h[i] for h in held]) for i in range(len(columns) + len(keys))]
        new = np.zeros(len(cols[0]), bool)
        new[0] = True
        for k in cols[len(columns) :]:
            new[1:] |= k[1:] != k[:-1]
        return [np.append(np.flatnonzero(new), len(new)), *cols[: len(columns)]]

    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(i).to_numpy() for i in keys]
        cols = [c.to_numpy() if not pa.types.is_binary(c.type) else np.array(c.to_pylist(), object) for c in (batch.column(i) for i in columns)]
        differ = np.zeros(batch.num_rows, bool)
        for k in ks:
            differ |= k != k[-1]
        last = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0  # where the batch's last bucket begins
        whole = [*cols, *ks]
        if last or (held and any(h[0] != held[-1][len(columns) + i][-1] for i, h in enumerate(ks))):
            if last:
                held.append([c[:last] for c in whole])
            yield joined()
            held = []
        held.append([c[last:] for c in whole])
    if held:
        yield joined()
