"""Checks and arithmetic around training studies: identities, issues, schedules, mixes, agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds issues: the names of the rules that a row breaks, sorted; a rule that is null counts as broken."""
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return df.withColumn("issues", F.array_join(F.array_sort(F.filter(broken, lambda x: x.isNotNull())), ","))


def differs_from_first(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) wherever a row's field differs from the row of least key."""
    first = df.agg(*(F.min_by(f, key).alias(f"_{f}") for f in fields))
    pairs = F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields))
    return df.crossJoin(F.broadcast(first)).select(key, F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("field"))  # one row


def cosine_rate(step: Column, top: float, low: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to ``low``."""
    part = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, top * (step + 1) / warmup).when(step >= total, F.lit(low)).otherwise(low + 0.5 * (top - low) * (1 + F.cos(F.lit(math.pi) * part)))


def agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """(places where two sequences agree, first place where they don't, or their common length)."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    return F.size(F.filter(same, lambda x: x)).cast("long"), F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(n.cast("long"))


def mixed(target: DataFrame, replay: DataFrame, order: str, batch: int, fraction: float) -> DataFrame:
    """Rows of both sources with the batch each falls to: a fixed number of each in every batch, one at least."""
    from textloom.operators.splits import running

    share = min(batch - 1, max(1, round(fraction * batch)))
    placed = lambda df, n, name: running(df, F.lit(1), order).select(order, F.lit(name).alias("origin"), F.floor(F.col("before") / n).alias("batch"))
    return placed(target, batch - share, "target").unionByName(placed(replay, share, "replay"))
