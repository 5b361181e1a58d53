"""A live probe of studies: each run's lines as they arrive, with a stall timer that needs no line to fire."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: kind is start (step: the planned steps), metric, or end (note: complete, failed or interrupted).
LINE = "run string, kind string, step long, value double, note string"
PROBED = "run string, status string, reason string, step long, planned long, best double, best_step long, checks long, stop_step long"
ENDS = ("complete", "failed", "interrupted")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: tuple, rows: list[tuple[int, float]], limit: int, min_delta: float) -> tuple:
    """Patience over (step, value) in step order: (best, its step, checks since, step it stopped at, why)."""
    best, at, checks, stop, why = state
    for step, value in rows:
        if stop is not None:
            break
        if value is None or not math.isfinite(value):
            stop, why = step, "not finite"
        elif best is None or value < best - min_delta:
            best, at, checks = value, step, 0
        else:
            checks += 1
            if checks >= limit:
                stop, why = step, "no improvement"
    return best, at, checks, stop, why


class Probe(StatefulProcessor):
    """State of a run: its steps by number, patience up to the last one, and what was last told.

    Steps may come in any order over the batches: one that is later than all before goes on from the patience held,
    an earlier one makes it anew from the steps held, so the answer is always the batch answer.  A step told twice
    with one value is one step, with two values it fails the run.  Every line sets the timer anew; a run whose timer
    fires is stalled until its next line.  An ended run has no timer.
    """

    def __init__(self, stall_ms: int, start_ms: int, limit: int, min_delta: float):
        self.stall_ms, self.start_ms, self.limit, self.min_delta = stall_ms, start_ms, limit, min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step long", "value double")
        self.patience = handle.getValueState("patience", "last long, best double, at long, checks long, stop long, why string")
        self.told = handle.getValueState("told", "planned long, ended string, broken string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        planned, ended, broken = self.told.get() if self.told.exists() else (None, None, None)
        last, *held = self.patience.get() if self.patience.exists() else (None, None, None, 0, None, None)
        fresh: dict[int, float | None] = {}
        for frame in rows:
            for kind, step, value, note in frame[["kind", "step", "value", "note"]].itertuples(index=False):
                if kind == "start" and not pd.isna(step):
                    planned = int(step)
                elif kind == "end":
                    ended = note if note in ENDS else "failed"
                elif kind == "metric" and not pd.isna(step):
                    number = None if pd.isna(value) else float(value)
                    before = fresh[int(step)] if int(step) in fresh else self.steps.getValue((int(step),))[0] if self.steps.containsKey((int(step),)) else number
                    if before != number:
                        broken = "a step has two values"
                    elif int(step) not in fresh and not self.steps.containsKey((int(step),)):
                        fresh[int(step)] = number
        for step, number in fresh.items():
            self.steps.updateValue((step,), (number,))
        if fresh:
            if last is None or min(fresh) > last:
                held = list(advance(tuple(held), sorted(fresh.items()), self.limit, self.min_delta))
            else:
                every = sorted((k[0], v[0]) for k, v in self.steps.iterator())
                held = list(advance((None, None, 0, None, None), every, self.limit, self.min_delta))
            last = max([*fresh, *([] if last is None else [last])])
        self.patience.update((last, *held))
        self.told.update((planned, ended, broken))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not ended and not broken:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + (self.start_ms if last is None else self.stall_ms))
        yield self._row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)

    def _row(self, key: tuple, stalled: bool) -> pd.DataFrame:
        planned, ended, broken = self.told.get()
        last, best, at, checks, stop, why = self.patience.get()
        if broken:
            status, reason = "failed", broken
        elif why == "not finite":
            status, reason = "failed", why
        elif ended:
            status, reason = ended, f"study {ended}"
        elif stalled:
            status, reason = "stalled", "nothing after the start" if last is None else "no progress"
        elif why:
            status, reason = "stopped", why
        else:
            status, reason = "running", "awaiting steps" if last is None else "active"
        row = (key[0], status, reason, last, planned, best, at, checks, stop)
        columns = [c.split()[0] for c in PROBED.split(", ")]
        frame = pd.DataFrame([row], columns=columns)
        return frame.astype({c: "Int64" for c in ("step", "planned", "best_step", "checks", "stop_step")} | {"best": "Float64"})

    def close(self) -> None:
        pass


def probe(lines: DataFrame, stall_seconds: float = 600, start_seconds: float = 120, limit: int = 5, min_delta: float = 0.0, clock: bool = True) -> DataFrame:
    """What changes of each run of a stream of LINE rows: a row a batch that has lines of it, and one when it stalls.

    Timers and state are in the checkpoint: a run that falls silent while nothing listens is told on the next start.
    A stream that has just started runs no batch before its source has rows, so a clock stands beside the lines that
    adds none to any run; without it, timers wait for the next line of any run after a start.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # timers and maps need it
    if clock:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().filter("value < 0")
        lines = lines.unionByName(ticks.selectExpr(*[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in LINE.split(", ")]))
    held = Probe(int(stall_seconds * 1000), int(start_seconds * 1000), limit, min_delta)
    return lines.filter("run is not null").groupBy("run").transformWithStateInPandas(held, PROBED, "Update", "ProcessingTime")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """LINE rows of a growing folder of JSON lines; a torn last line or a foreign one is skipped."""
    rows = spark.readStream.schema(LINE + ", _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.filter("_torn is null and run is not null").drop("_torn")


def event_fingerprint() -> Column:
    """A digest of what a probe's row says, the same for the same state: for an alarm that goes off once."""
    return F.sha2(F.to_json(F.struct("run", "status", "reason", "step"), {"ignoreNullFields": "false"}), 256)


def study_states(lines: DataFrame, now: Column, stall_seconds: float = 600, start_seconds: float = 120) -> DataFrame:
    """(run, status, reason, step, planned, progress_age_seconds) at a time, from all lines of (run, kind, step, value, note, ts): the batch form.

    The reason is the first that holds: an end that was told, a loss that is not finite, a step with two values, silence.
    """
    step, of = F.when(F.col("kind") == "metric", F.col("step")), lambda k: F.col("kind") == k
    odd = of("metric") & (F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
    twice = lines.filter(of("metric")).groupBy("run", "step").agg((F.count_distinct(F.coalesce("value", F.lit(float("nan")))) > 1).alias("two")).groupBy("run").agg(F.bool_or("two").alias("two"))
    runs = lines.groupBy("run").agg(
        F.max(step).alias("step"), F.max(F.when(of("start"), F.col("step"))).alias("planned"), F.max("ts").alias("seen"), F.max(F.when(of("metric"), F.col("ts"))).alias("progress"),
        F.bool_or(odd).alias("odd"), F.max_by(F.when(of("end"), F.when(F.col("note").isin(*ENDS), F.col("note")).otherwise("failed")), F.when(of("end"), F.col("ts"))).alias("ended"),
    )
    age = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.coalesce("progress", "seen").cast("timestamp")) / 1e6
    late = age > F.when(F.col("progress").isNull(), F.lit(float(start_seconds))).otherwise(float(stall_seconds))
    told = runs.join(twice, "run", "left").withColumn("age", F.round(F.greatest(age, F.lit(0.0)), 1))
    cases = [(F.col("two"), "failed", "a step has two values"), (F.col("odd"), "failed", "not finite"), (F.col("ended").isNotNull(), None, None), (late, "stalled", None)]
    status, reason = F.lit("running"), F.when(F.col("progress").isNull(), "awaiting steps").otherwise("active")
    for test, word, why in reversed(cases):
        silent = F.when(F.col("progress").isNull(), "nothing after the start").otherwise("no progress")
        status = F.when(test, F.lit(word) if word else F.col("ended")).otherwise(status)
        reason = F.when(test, F.lit(why) if why else F.concat(F.lit("study "), "ended") if word is None else silent).otherwise(reason)
    return told.select("run", status.alias("status"), reason.alias("reason"), "step", "planned", F.col("age").alias("progress_age_seconds"))
