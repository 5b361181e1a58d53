"""The live probe: stall timers, restarts from the checkpoint, steps in any order over the batches."""

import json
import time

import numpy as np

from textloom.operators import ledger
from textloom.streaming import probe


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    own = folder / f".{name}"
    own.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    own.rename(folder / f"{name}.json")


def metric(run, step, value):
    return {"run": run, "kind": "metric", "step": step, "value": value}


class Listener:
    """Keeps each run's rows over restarts."""

    def __init__(self, spark, folder, checkpoint, **limits):
        self.spark, self.folder, self.checkpoint, self.limits, self.rows = spark, folder, checkpoint, limits, {}

    def take(self, df, _):
        for r in df.collect():
            self.rows.setdefault(r.run, []).append(r)

    def start(self):
        found = probe.probe(probe.read_lines(self.spark, str(self.folder)), **self.limits)
        return found.writeStream.outputMode("update").option("checkpointLocation", str(self.checkpoint)).trigger(processingTime="200 milliseconds").foreachBatch(self.take).start()

    def wait(self, query, test, seconds=90):
        end = time.time() + seconds
        while time.time() < end and not test(self.rows):
            assert query.exception() is None, query.exception()
            time.sleep(0.2)
        assert test(self.rows), self.rows


def status(rows, run):
    return rows[run][-1].status if run in rows else None


def test_stall_timer_and_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        folder = tmp_path / "log"
        put(folder, "a", [{"run": "a", "kind": "start", "step": 100}, metric("a", 1, 3.0), metric("b", 1, 2.0), {"run": "c", "kind": "start", "step": 5}, metric("d", 1, 1.0), {"run": "d", "kind": "end", "note": "complete"}, '{"run": "a", "kind": "met'])
        told = Listener(spark, folder, tmp_path / "state", stall_seconds=4, start_seconds=2)
        query = told.start()
        told.wait(query, lambda r: all(status(r, x) == "stalled" for x in "abc"))  # no further line came
        assert told.rows["a"][-1].reason == "no progress" and told.rows["c"][-1].reason == "nothing after the start"
        assert [r.status for r in told.rows["d"]] == ["complete"] and told.rows["a"][0].planned == 100
        put(folder, "b", [metric("a", 2, 2.0)])
        told.wait(query, lambda r: status(r, "a") == "running")
        query.stop()
        n = len(told.rows["a"])
        time.sleep(4)  # a's timer runs out while nothing listens
        query = told.start()
        told.wait(query, lambda r: len(r["a"]) > n and status(r, "a") == "stalled")
        put(folder, "c", [metric("a", 2, 7.0), metric("b", 2, float("nan"))])
        told.wait(query, lambda r: status(r, "a") == "failed" and status(r, "b") == "failed")
        assert told.rows["a"][-1].reason == "a step has two values" and told.rows["b"][-1].reason == "not finite"
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_late_steps_give_the_batch_answer(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        r = np.random.default_rng(4)
        values = {(run, step): float(np.round(5 - 0.05 * step + r.normal(0, 0.4), 3)) for run in "xyz" for step in range(30)}
        order = list(values)
        r.shuffle(order)
        folder = tmp_path / "log"
        for k in range(5):
            put(folder, f"p{k}", [metric(run, step, values[run, step]) for run, step in order[k * 18 : (k + 1) * 18] + order[:3]])
        told = Listener(spark, folder, tmp_path / "state", limit=4, min_delta=0.1, clock=False)
        lines = spark.readStream.schema(probe.LINE).option("maxFilesPerTrigger", 1).json(str(folder))
        query = probe.probe(lines, **told.limits).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="100 milliseconds").foreachBatch(told.take).start()
        told.wait(query, lambda _: sum(p["numInputRows"] for p in query.recentProgress) >= 5 * 18 + 5 * 3)
        query.stop()
        table = spark.createDataFrame([(run, step, v) for (run, step), v in values.items()], "run string, step long, value double")
        for want in ledger.patience(table, "run", "step", "value", 4, 0.1).collect():
            got = told.rows[want.run][-1]
            assert (got.best, got.best_step, got.stop_step) == (want.best, want.best_step, want.stop_step)
        assert min(len(v) for v in told.rows.values()) > 2  # over several batches
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
