"""Small operators on records: digests, rates, traces, validators, preference pairs, conversations, inspections."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_digest(df: DataFrame, order: str, text: str, block: int = 1000) -> DataFrame:
    """(chars, digest) of the texts in the order of their ids: digests of id blocks, then a digest of those.

    A block holds ``block`` ids, so no row gathers all documents; the blocks' digests are one short string each.
    """
    x = df.select(F.floor(F.col(order) / block).alias("b"), order, F.sha1(text).alias("h"), F.length(text).alias("n"))
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), "")
    blocks = x.groupBy("b").agg(F.sha1(joined(order, "h")).alias("h"), F.sum("n").alias("n"), F.count("*").alias("c"))
    return blocks.agg((F.coalesce(F.sum("n"), F.lit(0)) + 2 * F.greatest(F.coalesce(F.sum("c"), F.lit(0)) - 1, F.lit(0))).cast("long").alias("chars"), F.substring(F.sha1(joined("b", "h")), 1, 12).alias("digest"))


def rate(correct: Column, tried: Column) -> Column:
    """Sum of correct over the number tried; NaN where nothing was tried."""
    return F.when(F.count_if(tried) == 0, F.lit(float("nan"))).otherwise(F.round(F.sum(correct) / F.greatest(F.count_if(tried), F.lit(1)), 9))


def trace(text: Column, mark: str = "output r = ") -> tuple[Column, Column]:
    """(steps, answer): the non-empty lines before the first output line, and what that line says; all lines and null without one."""
    lines = F.split(text, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: x.startswith(mark)), True)
    steps = F.filter(F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines), lambda x: x != "")
    answer = F.when(at > 0, F.substring(F.get(lines, at.cast("int") - 1), F.lit(len(mark) + 1), F.lit(1 << 30)))
    return steps, answer


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def hex_digest(value: Column) -> Column:
    return value.rlike("\\A[0-9a-f]{64}\\z")


def pair_reason(key: str, prompt: str, chosen: str, rejected: str, gated: Column) -> Column:
    """The first reason against a preference pair, or null."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(F.col(key).isNull(), "no id").when(none(prompt), "empty prompt").when(none(chosen) | none(rejected), "empty side")
        .when(F.col(chosen) == F.col(rejected), "identical sides").when(F.coalesce(gated, F.lit(False)), "held-out id")
    )


def conversation(docs: DataFrame, tool: Column | None = None) -> DataFrame:
    """(doc_id, turns, why): a document as user and assistant turns, with a tool turn between where ``tool`` has text.

    The first sentence asks, the rest answers; a document that makes no conversation has null turns and the reason.
    """
    at = F.instr("text", ". ")
    why = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "empty").when(at == 0, "no answer")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    ask, answer = turn("user", F.substring(F.col("text"), F.lit(1), at)), turn("assistant", F.expr("substring(text, instr(text, '. ') + 2)"))
    turns = F.array(ask, answer) if tool is None else F.when(tool.isNull(), F.array(ask, answer)).otherwise(F.array(ask, turn("tool", tool), answer))
    return docs.withColumn("why", why).withColumn("turns", F.when(why.isNull(), turns)).select("doc_id", "turns", "why")


def inspection(docs: DataFrame, by: str) -> DataFrame:
    words = F.size(F.split("text", " ", -1))
    g = docs.select(by, "text", words.alias("w")).groupBy(by)
    out = g.agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"), F.sum("w").alias("words"))
    return out.withColumn("words_per_byte", F.round(F.try_divide(F.col("words"), F.col("bytes")), 9))


def decoded(ids: Column, vocab: Column) -> Column:
    """Characters of an id array by a map from id to character; unknown ids vanish."""
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.element_at(vocab, i), F.lit(""))), "")


def tokenizer_fingerprint(path: str) -> str:
    """sha256 of a tokenizer file's canonical JSON without the fields that tell how it was made."""
    with open(path, encoding="utf-8") as f:
        payload = json.load(f)
    for field in ("training", "trained_at", "created", "metadata"):
        payload.pop(field, None)
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
