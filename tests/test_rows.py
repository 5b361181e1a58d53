"""Datasets with two masks, and FIM streams, against a plain building of the same rows."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import fimstream, rows


def test_dataset(spark):
    part = lambda ids, role: (ids, role)
    data = [(1, "synthesis", [1, 2], [part([3, 4], "answer")]), (2, "execution", [1], [part([5, 6], "execution"), part([7], "answer"), part([8], "execution")]), (3, "execution", [1, 2, 3], [part([4] * 9, "answer")]), (4, "execution", [9], [])]
    df = spark.createDataFrame(data, "id long, kind string, prompt array<int>, parts array<struct<ids:array<int>,role:string>>")
    examples, dropped = rows.dataset(df, 6)
    got = {r.id: (r.inputs, r.targets, r.execution) for r in examples.collect()}
    no = rows.IGNORE
    assert got[1] == ([1, 2, 3], [no, 3, 4], [no, no, no])
    assert got[2] == ([1, 5, 6, 7], [no, no, 7, no], [5, 6, no, 8])
    assert set(got) == {1, 2, 4} and {r.kind: (r.dropped, r.n) for r in dropped.collect()} == {"synthesis": (0, 1), "execution": (1, 3)}


def test_pairs(spark):
    df = spark.createDataFrame([(1, "ab", "c", "de"), (2, "ab", "c", "c"), (3, "", "c", "d"), (4, "a", None, "d")], "id long, p string, c string, r string")
    got = {r.id: r for r in rows.pairs(df, "p", "c", "r", 10).collect()}
    assert (got[1].chosen_inputs, got[1].chosen_targets) == ([97, 98], [rows.IGNORE, 99]) and got[1].rejected_targets == [rows.IGNORE, 100, 101]
    assert [got[i].refusal for i in (2, 3, 4)] == ["identical sides", "empty prompt", "empty side"] and got[2].chosen_inputs is None


@pytest.mark.parametrize("bucket", [7, 65_536])
def test_fim_stream(spark, monkeypatch, bucket):
    """Windows over documents and bucket ends; each epoch fills other middles of the same texts."""
    monkeypatch.setattr(fimstream, "BUCKET", bucket)
    texts = ["abcdefghij" * 3, "", None, " \n", "é\U0001d11ezz", "x", "klmnopqrstuvwxyz" * 6]
    docs = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    for epoch in (0, 1):
        made = fimstream.stream(docs, 5, epoch, 0.9)
        parts = sorted(made.collect())
        assert [r.doc_id for r in parts] == [0, 40, 50, 60]
        whole = [i for r in parts for i in r.ids][: parts[0].total]
        for r in parts:
            plain = [i for i in r.ids[:-2] if i < 0x110000]
            assert sorted(plain) == sorted(map(ord, texts[r.doc_id // 10]))
            marks = [i for i in r.ids if i >= 0x110000]
            assert marks in ([], [fimstream.PRE, fimstream.SUF, fimstream.MID, fimstream.EOT])
        got = fimstream.windows(made, 12, 5, epoch).collect()
        assert sorted(r.draw for r in got) == list(range(-(-len(whole) // 12)))
        for r in got:
            assert r.inputs == whole[r.start : r.start + 12] and r.targets == whole[r.start + 1 : r.start + 13]
        seen.append(whole)
    assert seen[0] != seen[1]
    with pytest.raises(ValueError):
        fimstream.windows(made, 10_000, 5, 0)
    with pytest.raises(ValueError):
        fimstream.stream(docs, 5, 0, 0.0)
    assert fimstream.stream(docs.limit(0), 5, 0, 0.5).select(F.count("*")).first()[0] == 0
