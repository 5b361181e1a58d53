"""Analytics over append-only experiment ledgers: arms, seeds, pairs, verdicts, holdouts, claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group; a window over the group's rows, cut as they are ranked."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def latest(df: DataFrame, step: Column, value: Column) -> Column:
    return F.max_by(value, step)


def least_by(what: str, value: str) -> Column:
    """What stands beside the least value, of equal values the least; a row without either counts for nothing."""
    both = F.col(what).isNotNull() & F.col(value).isNotNull()
    return F.min_by(what, F.when(both, F.struct(value, what)))


def arm_summary(df: DataFrame, arm: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(arm).agg(F.count("*").alias("n"), F.round(F.avg(v), 9).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.max(v) - F.min(v), 9).alias("spread"))


def seed_verdict(df: DataFrame, by: str, wanted: int) -> DataFrame:
    """falsified if any seed violates, else pending if seeds are missing, else held."""
    g = df.groupBy(by).agg(F.bool_or("violates").alias("bad"), F.count("*").alias("seeds"))
    return g.select(by, "seeds", F.when(F.col("bad"), "falsified").when(F.col("seeds") < wanted, "pending").otherwise("held").alias("verdict"))


def paired(df: DataFrame, key: str, arm: str, value: str, treatment: str, baseline: str) -> DataFrame:
    """Difference of two arms for each key; null, not zero, where an arm is missing."""
    g = df.groupBy(key).pivot(arm, [treatment, baseline]).agg(F.first(value))
    return g.select(key, F.col(treatment).alias("treatment"), F.col(baseline).alias("baseline"), F.round(F.col(treatment) - F.col(baseline), 9).alias("gain"))


def integrity(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys whose digests differ from, or are missing on, either side."""
    j = df.select(key, F.col("digest").alias("actual")).join(expected.select(key, F.col("digest").alias("recorded")), key, "full")
    return j.filter(~F.col("actual").eqNullSafe(F.col("recorded")))


def increasing(df: DataFrame, run: str, step: str) -> DataFrame:
    """Rows whose step does not exceed the one before it in the run."""
    w = Window.partitionBy(run).orderBy("line_no")
    return df.withColumn("before", F.lag(step).over(w)).filter(F.col(step) <= F.col("before"))


def declared(path: Column, patterns: list[str]) -> Column:
    """Whether a dotted path is one of the patterns; * stands for exactly one segment."""
    tests = [path.rlike("^" + "\\.".join("[^.]+" if s == "*" else s for s in p.split(".")) + "$") for p in patterns]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def withheld(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Values that may be shown: all of an eligible payload, else only those declared to be measurements."""
    return df.withColumn("value", F.when(F.col("eligible") | declared(F.col("path"), patterns), F.col("value")))


def patience(df: DataFrame, run: str, step: str, value: str, limit: int, min_delta: float) -> DataFrame:
    """(run, best, best_step, stop_step, reason): checks without an improvement over min_delta are counted up to the limit.

    The value to beat moves only on an improvement, so each check depends on all before it: one group a run.
    """

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        best, best_step, bad, stop, reason = float("inf"), None, 0, None, None
        for s, v in rows.sort_values(step)[[step, value]].itertuples(index=False):
            if not (v == v and abs(v) != float("inf")):
                stop, reason = s, "not finite"
                break
            if v < best - min_delta:
                best, best_step, bad = v, s, 0
                continue
            bad += 1
            if bad >= limit:
                stop, reason = s, "no improvement"
                break
        return pd.DataFrame({run: [rows[run].iloc[0]], "best": [best if best_step is not None else None], "best_step": pd.array([best_step], "Int64"), "stop_step": pd.array([stop], "Int64"), "reason": pd.array([reason], "string")})

    kind = df.schema[run].dataType.simpleString()
    return df.groupBy(run).applyInPandas(follow, f"{run} {kind}, best double, best_step long, stop_step long, reason string")


def elementwise_mean(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector of each group as rows (by, pos, mean): positions are summed apart, no group is collected."""
    x = df.select(by, F.posexplode(vector).alias("pos", "v"))
    return x.groupBy(by, "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def prefix_match(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    both = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both), lambda x, y: x.eqNullSafe(y))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same).cast("long"))
