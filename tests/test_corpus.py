"""The corpus sink's commit protocol, and the audit of what it published."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import bpefit
from textloom.sources import audit, corpus

COLUMNS = "path string, text string, split string, group string, included boolean, reason string, sha256 string, normalized_sha256 string, source string"


def records(spark, extra=()):
    rows = [(f"p{i:03d}", f"text {i} " * (1 + i % 7), "validation" if i % 5 == 0 else "train", f"g{i}", True, None, f"h{i}", f"n{i}", "s") for i in range(60)]
    rows += [("x1", "", "train", "gx", False, "empty", "hx", "nx", "s"), ("x2", None, None, None, False, "binary-nul", None, None, None), ("x3", "text 1", "train", "g1", False, "exact-duplicate", "h1", "n1", "s")]
    return spark.createDataFrame([*rows, *extra], COLUMNS).repartition(4)


def left(tmp_path):
    """What a reader can find; a task that outlives its job's end may leave a hidden staging folder."""
    return sorted(n for n in os.listdir(tmp_path) if not n.startswith("."))


def test_publish(spark, tmp_path):
    out = str(tmp_path / "o")
    report = corpus.write_corpus(records(spark), out)
    assert report["records"] == 63 and report["excluded"] == {"binary-nul": 1, "empty": 1, "exact-duplicate": 1}
    assert {k: v["files"] for k, v in report["splits"].items()} == {"train": 48, "validation": 12}
    back = spark.read.parquet(out + "/corpus")
    assert back.count() == 60 and back.agg(F.sum(F.length("text"))).first()[0] == sum(v["chars"] for v in report["splits"].values())
    assert spark.read.parquet(out + "/provenance").count() == 63 and "text" not in spark.read.parquet(out + "/provenance").columns
    assert "| train | 48 |" in open(out + "/card.md").read() and left(tmp_path) == ["o"]
    with pytest.raises(Exception, match="already exists"):
        corpus.write_corpus(records(spark), out)
    assert spark.read.parquet(out + "/corpus").count() == 60


@pytest.mark.parametrize("row,what", [
    (("y", "t", "validation", "gy", True, None, "h1", "ny", "s"), "sha256"),
    (("y", "t", "validation", "gy", True, None, "hy", "n1", "s"), "normalized_sha256"),
    (("y", "t", "train", "g5", True, None, "hy", "ny", "s"), "group"),
])
def test_overlap_publishes_nothing(spark, tmp_path, row, what):
    with pytest.raises(Exception, match=f"on both sides: {what}"):
        corpus.write_corpus(records(spark, [row]), str(tmp_path / "o"))
    assert left(tmp_path) == []


def test_empty_side_and_failed_task_publish_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="a side is empty"):
        corpus.write_corpus(records(spark).filter("split = 'train' or not included"), str(tmp_path / "o"))
    broken = records(spark).withColumn("text", F.when(F.col("path") == "p030", F.raise_error(F.lit("no such file"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no such file"):
        corpus.write_corpus(broken, str(tmp_path / "o"))
    with pytest.raises(Exception, match="no column group"):
        corpus.CorpusWriter({"path": str(tmp_path / "o")}, [c for c in corpus.NEEDED if c != "group"] + ["overlap"])
    assert left(tmp_path) == []


def test_a_task_that_runs_twice_leaves_one_copy(tmp_path, monkeypatch):
    """Both attempts of a task stage their files; the message of one is committed."""
    out = str(tmp_path / "o")
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["overlap"]
    writer = corpus.CorpusWriter({"path": out, "records": "2"}, names)

    class Attempt:
        def __init__(self, part, attempt):
            self.partitionId, self.taskAttemptId = (lambda: part), (lambda: attempt)

    def attempt(part, number, split):
        monkeypatch.setattr(corpus.TaskContext, "get", staticmethod(lambda: Attempt(part, number)))
        row = [f"p{part}", "some text", split, f"g{part}", True, None, f"h{part}", f"n{part}", "s", None]
        types = [pa.bool_() if n == "included" else pa.string() for n in names]
        return writer.write(iter([pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)]))

    attempt(0, 7, "train")  # its message is lost
    writer.commit([attempt(0, 9, "train"), None, attempt(1, 8, "validation")])
    files = [f for _, _, found in os.walk(out) for f in found if f.endswith(".parquet")]
    assert len(files) == 4 and not any("-7." in f for f in files)
    again = corpus.CorpusWriter({"path": str(tmp_path / "q"), "records": "3"}, names)
    with pytest.raises(ValueError, match="2 records"):
        again.commit([corpus.Staged(records=2)])


def test_audit(spark, tmp_path):
    out, told = str(tmp_path / "o"), str(tmp_path / "audit")
    corpus.write_corpus(records(spark), out)
    report = audit.audit(spark, out, told, vocab_size=300, context=20, windows=6)
    train = [r.text for r in spark.read.parquet(out + "/corpus").filter("split = 'train'").orderBy("path").collect()]
    payload = json.load(open(told + "/tokenizer.json"))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(json.dumps(payload["backend"]))
    ids = [i for t in train for i in tok.encode(t, add_special_tokens=False).ids]
    windows = [json.loads(x) for x in open(told + "/windows.jsonl")]
    assert report["splits"]["train"]["tokens"] == len(ids) and len(windows) == 6
    for w in windows:
        assert w["tokens"] == 20 and w["text"] == bpefit.decode(payload, ids[w["start_token"] : w["start_token"] + 20])
    assert json.load(open(told + "/audit.json")) == report
    with pytest.raises(ValueError, match="already exists"):
        corpus.publish(told, {})
    check = lambda **k: audit.validated(spark, out, told, **{"context": 20, "vocab_size": 300, "least": 4} | k)
    audit.accept(told, [0, 1, 2, 5])
    assert set(check()) == {"audit_sha256", "inspection_sha256", "tokenizer_sha256", "train_seal", "validation_seal"}
    with pytest.raises(ValueError, match="already exists"):
        audit.accept(told, [0])
    for why, limits in (("fewer than 5", {"least": 5}), ("differ from the study", {"context": 21}), ("differ from the study", {"vocab_size": 299})):
        with pytest.raises(ValueError, match=why):
            check(**limits)
    record = told + "/inspection/inspection.json"
    good = open(record).read()
    for change, why in (({"status": "rejected"}, "did not pass"), ({"audit_sha256": "0"}, "another audit"), ({"tokenizer_sha256": "0"}, "another tokenizer"), ({"inspected_windows": [0, 1, 2, 6]}, "not the audit's"), ({"inspected_windows": [0, 1, 2, True]}, "not the audit's"), ({"inspected_windows": [0, 1, 1, 0]}, "fewer than 4")):
        open(record, "w").write(json.dumps(json.loads(good) | change))
        with pytest.raises(ValueError, match=why):
            check()
    open(record, "w").write(good)
    with pytest.raises(ValueError, match="too few"):
        audit.audit(spark, out, str(tmp_path / "b"), vocab_size=260, context=10_000)
    spark.createDataFrame([("new", "more")], "path string, text string").write.mode("append").parquet(out + "/corpus/split=train")
    with pytest.raises(ValueError, match="not what its report says"):
        audit.audit(spark, out, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="train side changed"):
        check()
