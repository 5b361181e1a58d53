"""Exact and normalized deduplication that keeps the first row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import normalized_hash
from textloom.sources.scratch import Scratch


def keep_first(df: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """(key, least order, copies): one row for each key.

    An aggregate rather than a window: it combines before the shuffle, so a key that holds a third of the
    rows moves one row a task.
    """
    return df.groupBy(key.alias("dedup_key")).agg(F.min(order).alias(order), F.count("*").alias("n_copies"))


def two_level(df: DataFrame, text: Column, order: str = "doc_id") -> DataFrame:
    """Each row with included, reason and duplicate_of: an equal text is exact-duplicate, an equal normalized one normalized-duplicate.

    The survivor of a normalized key is its first row; it is joined back on the narrow keys, which are made once
    and kept: digests and line patterns cost more than their writing.
    """
    keyed = Scratch(df.sparkSession, "dedup").keep(df.select(order, F.sha2(text, 256).alias("sha"), normalized_hash(text).alias("norm")), "keys")
    first = keyed.groupBy("norm").agg(F.min(F.struct(order, "sha")).alias("f")).select("norm", F.col(f"f.{order}").alias("first"), F.col("f.sha").alias("first_sha"))
    joined = keyed.join(first, "norm")
    own = F.col(order) == F.col("first")
    reason = F.when(own, F.lit(None)).when(F.col("sha") == F.col("first_sha"), "exact-duplicate").otherwise("normalized-duplicate")
    return joined.select(order, own.alias("included"), reason.alias("reason"), F.when(~own, F.col("first")).alias("duplicate_of"))
