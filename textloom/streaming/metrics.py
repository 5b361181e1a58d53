"""Append-only metric logs as streams: torn lines, committed steps, patience."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

METRIC = "run string, step long, value double"


def read_log(spark: SparkSession, path: str, schema: str = METRIC, stream: bool = False) -> DataFrame:
    """JSON lines of a growing log; torn or foreign lines are skipped."""
    reader = (spark.readStream if stream else spark.read).schema(schema + ", _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn")
    return reader.json(path).filter("_torn is null and step is not null").drop("_torn")


def committed(df: DataFrame, upto: int) -> DataFrame:
    """Each (run, step) once, and only steps that are committed: a resumed writer may repeat lines."""
    return df.filter((F.col("step") > 0) & (F.col("step") <= upto)).dropDuplicates(["run", "step"])


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events by day and type, with a watermark for late rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


STOP = "run string, best double, best_step long, checks long, stopped boolean"


def patience_stream(df: DataFrame, limit: int, min_delta: float) -> DataFrame:
    """Patience of each run over a stream of checks: state is (best, its step, checks since, stopped)."""

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, at, bad, stopped = state.get if state.exists else (float("inf"), -1, 0, False)
        rows = pd.concat(list(parts)).sort_values("step")
        for step, value in rows[["step", "value"]].itertuples(index=False):
            if stopped:
                break
            if not (value == value and abs(value) != float("inf")):
                stopped = True
            elif value < best - min_delta:
                best, at, bad = float(value), int(step), 0
            else:
                bad += 1
                stopped = bad >= limit
        state.update((best, at, bad, stopped))
        yield pd.DataFrame({"run": [key[0]], "best": [best], "best_step": [at], "checks": [bad], "stopped": [stopped]})

    return df.groupBy("run").applyInPandasWithState(follow, STOP, "best double, at long, bad long, stopped boolean", "update", GroupStateTimeout.NoTimeout)
