"""A stream of ids in which each epoch fills other middles, and random windows over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.rows import char_ids, fim
from textloom.operators.splits import running

#: Ids after every character: no text holds them.
PRE, SUF, MID, EOT = range(0x110000, 0x110004)
JOINER = (10, 10)
BUCKET = 65_536


def fim_ids(prefix: Column, middle: Column, suffix: Column, arrangement: Column) -> Column:
    """Ids of a text in parts: as it is, prefix-suffix-middle, or suffix-prefix-middle, the latter two ended by a mark."""
    p, m, s = (char_ids(c) for c in (prefix, middle, suffix))
    mark = lambda *ids: F.array(*(F.lit(i) for i in ids))
    psm = F.concat(mark(PRE), p, mark(SUF), s, mark(MID), m, mark(EOT))
    spm = F.concat(mark(PRE, SUF), s, mark(MID), p, m, mark(EOT))
    return F.when(arrangement == "psm", psm).when(arrangement == "spm", spm).otherwise(p)


def stream(docs: DataFrame, seed: int, epoch: int, rate: float, spm_rate: float = 0.5) -> DataFrame:
    """(doc_id, ids, before, total): the epoch's documents in order, with where each begins and the stream's length.

    Blank documents are left out; a joiner stands between two documents.  A document's cuts hang on its id, the seed
    and the epoch alone, so an epoch can be made anywhere without those before it.
    """
    if not 0 < rate <= 1 or not 0 <= spm_rate <= 1:
        raise ValueError("0 < rate <= 1 and 0 <= spm_rate <= 1")
    parts = fim(docs.filter(T.strip(F.col("text")) != ""), rate, spm_rate, seed, epoch)
    ids = F.concat(fim_ids(*(F.col(c) for c in ("prefix", "middle", "suffix", "arrangement"))), F.array(*(F.lit(i) for i in JOINER)))
    n = sum((F.length(c) for c in ("prefix", "middle", "suffix")), F.when(F.col("arrangement") == "plain", 0).otherwise(4) + len(JOINER))
    placed = running(parts, n)  # dealt as text: ids take four bytes a character
    return placed.select("doc_id", ids.alias("ids"), "before", (F.col("total") - len(JOINER)).cast("long").alias("total"))


def windows(ids: DataFrame, block: int, seed: int, epoch: int) -> DataFrame:
    """(draw, start, inputs, targets): as many windows as give the stream's length in targets, drawn by hash, over documents' ends.

    Documents are cut at multiples of BUCKET and windows meet the pieces of the buckets that they touch, so neither
    a long document nor a long stream is ever one row's.
    """
    spark = ids.sparkSession
    total = ids.agg(F.max("total")).first()[0] or 0
    if total - block < 1:
        raise ValueError(f"the stream holds {total} tokens but a window takes {block} and one more")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"window:{seed}:{epoch}:"), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long")
    draws = spark.range(-(-total // block)).withColumnRenamed("id", "draw").withColumn("start", number % (total - block))
    bucket = lambda at: F.floor(at / BUCKET)
    n = F.size("ids")
    low = lambda b: F.greatest(F.col("before"), b * BUCKET)
    piece = lambda b: F.struct(b.alias("bucket"), low(b).alias("at"), F.slice("ids", (low(b) - F.col("before") + 1).cast("int"), (F.least(F.col("before") + n, (b + 1) * BUCKET) - low(b)).cast("int")).alias("ids"))
    cut = ids.select(F.explode(F.transform(F.sequence(bucket(F.col("before")), bucket(F.col("before") + n - 1)), piece)).alias("p")).select("p.*")
    touched = draws.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("start") + block))))
    met = cut.join(touched, "bucket").filter((F.col("at") <= F.col("start") + block) & (F.col("at") + n > F.col("start")))
    skip = F.greatest(F.col("start") - F.col("at"), F.lit(0))
    part = F.slice("ids", (skip + 1).cast("int"), F.least(n - skip, F.col("start") + block + 1 - F.greatest("at", "start")).cast("int"))
    parts = met.select("draw", "start", "at", part.alias("ids")).repartition("draw", "start")  # cut before they are grouped, or each window would carry whole pieces
    whole = parts.groupBy("draw", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("w"))  # block + 1 ids a window
    return whole.select("draw", "start", F.slice("w", 1, block).alias("inputs"), F.slice("w", 2, block).alias("targets"))
