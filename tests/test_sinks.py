"""Sinks, folder scan and small record operators."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import records as R
from textloom.sources import files, sinks


def test_folder_corpus_and_sink(spark, tmp_path):
    root = tmp_path / "node_modules" / "a+b(1)"  # what is above the root doesn't count, and its name is no pattern
    for name, data in {"a.txt": b"alpha text", "b.log": b"alpha text", "sub/c.md": ("日" * 4000).encode(), "node_modules/d.txt": b"no", "e.png": b"\x89PNG", "f.bin2": b"a\0b", "g.txt": b"x", "readme.txt": b"about this"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    docs, tally = sinks.folder_corpus(spark, str(root), min_chars=5)
    assert sorted(r.path for r in docs.collect()) == ["a.txt", "readme.txt", "sub/c.md"]
    assert {r.reason: r.n for r in tally.collect()} == {"in an ignored directory": 1, "binary file type (.png)": 1, "content is not text": 1, "too short": 1, "copy of another file": 1}
    sinks.write_corpus(docs, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("# file: a.txt\nalpha text\n\n# file: readme.txt\n")
    with pytest.raises(Exception):
        sinks.write_corpus(docs, str(tmp_path / "out"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", "content")
    assert "readme.txt" not in {r.path.rpartition("/")[2] for r in sinks.user_files(sinks.reasons(found, str(root))).collect()}


def test_logs(spark, tmp_path):
    log = str(tmp_path / "log")
    assert sinks.append_record(spark, log, {"run": "a", "step": 1}) and sinks.append_record(spark, log, {"run": "a", "step": 2})
    rows, late = sinks.read_metrics(spark, log, "run string, step long", 1)
    assert rows.count() == 1 and late == 1
    for name, steps in (("rise", (1, 3, 4)), ("fall", (1, 5, 3)), ("twice", (2, 2))):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"run": "a", "step": s}) + "\n" for s in steps))
    assert sinks.read_metrics(spark, str(tmp_path / "rise.json"), "run string, step long", 3)[1] == 1
    for name in ("fall", "twice"):
        with pytest.raises(ValueError):
            sinks.read_metrics(spark, str(tmp_path / f"{name}.json"), "run string, step long", 9)
    (tmp_path / "log" / "part-x.txt").write_text("{broken\n")
    with pytest.raises(Exception):
        sinks.read_metrics(spark, log, "run string, step long", 1)[0].count()
    assert not sinks.append_record(spark, "nosuch://x/y", {"run": "a"})


def test_conversations_sink(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ask. Answer it."), (2, ""), (3, "none"), (4, None)], "doc_id long, text string")
    built = R.conversation(docs, F.when(F.col("doc_id") == 1, F.lit("ran")))
    assert [t.role for t in built.filter("doc_id = 1").first().turns] == ["user", "tool", "assistant"]
    assert sinks.write_conversations(built, str(tmp_path / "c")) == {"kept": 1, "empty": 2, "no answer": 1}
    assert json.loads((tmp_path / "c/summary.json").read_text())["kept"] == 1
    assert sinks.newest(spark, str(tmp_path / "c")).first().newest is not None


def test_bytes():
    for text in ("日本", "é", "𝄞a", "plain"):
        raw = text.encode()
        for n in range(len(raw) + 1):
            assert text.startswith(files.whole_characters(raw[:n]).decode())
    assert files.whole_characters(b"a\xc0") == b"a\xc0" and files.whole_characters(b"\x80") == b"\x80"
    assert files.undecodable(b"a\xff\xfeb") == 2 and files.undecodable("�".encode()) == 0


def test_decoded_and_trace(spark):
    df = spark.createDataFrame([([0, 1, 9], "s1\n\ns2\noutput r = 7\nx"), ([], "no output")], "ids array<int>, t string")
    vocab = F.create_map(F.lit(0), F.lit("h"), F.lit(1), F.lit("i"))
    steps, answer = R.trace(F.col("t"))
    assert [tuple(r) for r in df.select(R.decoded(F.col("ids"), vocab), steps, answer).collect()] == [("hi", ["s1", "s2"], "7"), ("", ["no output"], None)]


def test_fills_and_reach():
    import numpy as np

    from textloom.operators import splits

    r = np.random.default_rng(3)
    for _ in range(50):
        sizes, room = r.integers(0, 20, 30), float(r.integers(0, 150))
        want, used = [], 0
        for n in sizes.tolist():
            want.append(used + n <= room)
            used += n * want[-1]
        assert splits.taken(sizes, room).tolist() == want
        lengths = sizes[sizes > 0].tolist()
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        total = sum(lengths)
        assert splits.best_fraction(lengths, 0.3) == max(s for s in sums if s <= int(total * 0.3)) / total


def test_json_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "lock.json")
    for value in ({"a": 1}, {"a": 2, "b": "é"}):
        sinks.replace_json(spark, path, value)
        assert json.loads((tmp_path / "lock.json").read_text()) == value
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["lock.json"]


def test_reports_and_candidates(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, 0.5), (None, 2, None)], "arm string, n int, loss double")
    assert sinks.markdown(df, "Arms", ("one seed",)) == "# Arms\n\n| arm | n | loss |\n|-|-:|-:|\n| a\\|b | 1 | 0.5000 |\n| — | 2 | — |\n\n- one seed\n"
    with pytest.raises(ValueError):
        sinks.markdown(df, "Arms", limit=1)
    made = spark.createDataFrame([("t1", "val", "x\n}\nmore"), ("t2", "val", "open")], "task_name string, split string, raw string")
    sinks.write_candidates(made, str(tmp_path / "c"))
    got = {r.task_name: (r.completion, r.stopped) for r in spark.read.json(str(tmp_path / "c")).collect()}
    assert got == {"t1": ("x\n}\n", True), "t2": ("open", False)}
