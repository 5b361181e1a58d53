"""Training rows: character ids, windows, document rows, masked examples, preference pairs, batches, mask audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from textloom.operators.bpe import portions
from textloom.operators.splits import drawn

IGNORE = -1
#: Characters whose ids are found at once in a task.
AT_ONCE = 1 << 21


def char_ids(text: Column) -> Column:
    """Code points of a text's characters: the ids of a vocabulary that is all of Unicode."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def encoded(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """Adds ids: positions in the vocabulary (an alphabet, so Unicode bounds it); characters without one are dropped.

    A character finds its id in a table of code points; a map is searched from its start for each.
    """
    rows = vocab.select(F.ascii("ch").alias("at"), "id").collect()  # an alphabet
    ids = np.full(max([r["at"] for r in rows], default=0) + 2, -1, np.int64)
    for r in rows:
        ids[r["at"]] = r["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in portions(batch.column(text).to_pylist(), AT_ONCE):
                codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
                found = ids[np.minimum(codes, len(ids) - 1)]  # the last entry is no character's
                ends = np.append(0, np.cumsum(found >= 0))[np.append(0, np.cumsum([len(t or "") for t in texts]))].astype(np.int32)
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[found >= 0]), mask=null)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, lists], names=[*batch.schema.names, "ids"])
                at += len(texts)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("ids", ArrayType(LongType()))]))


def windows(df: DataFrame, ids: str, block: int) -> DataFrame:
    """(.., start, x, y): next-token windows that don't overlap; a tail shorter than a window is left out."""
    n = F.size(ids)
    starts = F.when(n > block, F.sequence(F.lit(0), n - block - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    w = df.withColumn("start", F.explode(starts))
    return w.withColumn("x", F.slice(ids, F.col("start") + 1, F.lit(block))).withColumn("y", F.slice(ids, F.col("start") + 2, F.lit(block)))


def document_rows(df: DataFrame, block: int, text: str = "text", pad: int = 0, end: str = "\n\n") -> DataFrame:
    """(.., x, y, n_targets, n_cut): one row a document, its surrounding line ends dropped and ``end`` added, cut and padded to ``block``."""
    body = F.regexp_replace(F.col(text), "\\A[\\r\\n]+|[\\r\\n]+\\z", "")
    kept = F.slice("ids", 1, block + 1)
    fill = F.lit(block) - (F.size("kept") - 1)
    out = df.withColumn("ids", char_ids(F.concat(body, F.lit(end)))).filter(F.size("ids") >= 2).withColumn("kept", kept)
    x = F.concat(F.slice("kept", F.lit(1), F.size("kept") - 1), F.array_repeat(F.lit(pad), fill))
    y = F.concat(F.slice("kept", F.lit(2), F.size("kept") - 1), F.array_repeat(F.lit(IGNORE), fill))
    return out.withColumn("x", x).withColumn("y", y).withColumn("n_targets", F.size("kept") - 1).withColumn("n_cut", F.size("ids") - F.size("kept")).drop("ids", "kept")


def masked(prompt: Column, answer: Column) -> tuple[Column, Column]:
    """(inputs, targets) of a prompt and its completion: the prompt's own tokens are no targets."""
    whole = F.concat(prompt, answer)
    inputs = F.slice(whole, F.lit(1), F.size(whole) - 1)
    targets = F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt) - 1), answer)
    return inputs, targets


def segments(prompt: Column, parts: Column, supervise_execution: bool) -> tuple[Column, Column]:
    """(inputs, targets) of a prompt and (ids, role) parts; answers are targets, execution only if asked for."""
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    labels = F.flatten(F.transform(parts, lambda p: F.when((p["role"] == "answer") | F.lit(supervise_execution), p["ids"]).otherwise(F.transform(p["ids"], lambda _: F.lit(IGNORE)))))
    whole = F.concat(prompt, ids)
    return F.slice(whole, F.lit(1), F.size(whole) - 1), F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt) - 1), labels)


def dataset(df: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(examples, dropped): every arm's examples with two masks, and how many of each kind are too long for the block.

    ``df`` has kind, prompt (ids) and parts (ids, role).  ``targets`` supervises answers in every arm; ``execution``
    holds what only some arms supervise, disjoint from it: the target with execution supervised where the answers'
    has none.  A synthesis example has none of it.
    """
    plain = segments(F.col("prompt"), F.col("parts"), False)
    treated = segments(F.col("prompt"), F.col("parts"), True)[1]
    fits = F.size(F.flatten(F.transform("parts", lambda p: p["ids"]))) + F.size("prompt") - 1 <= block
    more = F.zip_with(treated, "targets", lambda t, a: F.when((a == IGNORE) & (F.col("kind") != "synthesis"), t).otherwise(F.lit(IGNORE)))
    examples = df.filter(fits).withColumn("inputs", plain[0]).withColumn("targets", plain[1]).withColumn("execution", more).drop("prompt", "parts")
    dropped = df.groupBy("kind").agg(F.count_if(~F.coalesce(fits, F.lit(False))).alias("dropped"), F.count("*").alias("n"))
    return examples, dropped


def pairs(df: DataFrame, prompt: str, chosen: str, rejected: str, block: int) -> DataFrame:
    """df with refusal, and of a usable pair both sides' inputs and targets: the shared prompt is masked in each."""
    out = df.withColumn("refusal", pair_refusal(F.col(prompt), F.col(chosen), F.col(rejected), block))
    for side, text in (("chosen", chosen), ("rejected", rejected)):
        x, y = masked(char_ids(F.col(prompt)), char_ids(F.col(text)))
        out = out.withColumn(f"{side}_inputs", F.when(F.col("refusal").isNull(), x)).withColumn(f"{side}_targets", F.when(F.col("refusal").isNull(), y))
    return out


def collated(df: DataFrame, batch: str = "batch") -> DataFrame:
    """Pads x and y of each batch to its longest row; a batch's length is an aggregate joined back."""
    longest = df.groupBy(batch).agg(F.max(F.size("x")).alias("_n"))
    fill = F.col("_n") - F.size("x")
    padded = df.join(longest, batch).withColumn("pad", fill)
    return padded.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), F.col("pad")))).withColumn("y", F.concat("y", F.array_repeat(F.lit(IGNORE), F.col("pad")))).drop("_n")


def pair_refusal(prompt: Column, chosen: Column, rejected: Column, block: int) -> Column:
    """Why a preference pair can't be used, or null."""
    long = F.greatest(F.length(chosen), F.length(rejected)) + F.length(prompt) - 1 > block
    return F.when(F.coalesce(prompt, F.lit("")) == "", "empty prompt").when((F.coalesce(chosen, F.lit("")) == "") | (F.coalesce(rejected, F.lit("")) == ""), "empty side").when(chosen == rejected, "identical sides").when(long, "too long")


def fim(df: DataFrame, rate: float, spm_rate: float, seed: int, epoch: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, prefix, middle, suffix, arrangement): fill-in-the-middle parts of each text, drawn by hash from its own id; untouched rows have only a prefix.

    The two cuts are different places, every pair of them as likely; null counts as empty, and a text under two characters is left alone.
    """
    draw = lambda what: drawn(F.concat(F.lit(f"fim:{seed}:{epoch}:{what}:"), F.col(id_column).cast("string")))
    chance = lambda what, p: draw(what) < int(p * 2**32)
    x = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), chance("rate", rate).alias("hit"), chance("spm", spm_rate).alias("spm"), draw("a").alias("a"), draw("b").alias("b"))
    x = x.withColumn("n", F.length("t").cast("long")).withColumn("hit", F.col("hit") & (F.col("n") >= 2))
    x = x.withColumn("a", F.col("a") % (F.col("n") + 1)).withColumn("b", F.col("b") % F.greatest(F.col("n"), F.lit(1)))
    x = x.withColumn("b", F.col("b") + F.when(F.col("b") >= F.col("a"), 1).otherwise(0))
    lo, hi = (f("a", "b").cast("int") for f in (F.least, F.greatest))
    part = lambda start, size: F.when(F.col("hit"), F.substring(F.col("t"), start, size)).otherwise("")
    prefix = F.when(F.col("hit"), F.substring(F.col("t"), F.lit(1), lo)).otherwise(F.col("t"))
    order = F.when(~F.col("hit"), "plain").when(F.col("spm"), "spm").otherwise("psm")
    return x.select("doc_id", prefix.alias("prefix"), part(lo + 1, hi - lo).alias("middle"), part(hi + 1, F.col("n").cast("int")).alias("suffix"), order.alias("arrangement"))
