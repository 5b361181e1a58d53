"""Golden rows, invariants and edge cases of the reference's own operators."""

import hashlib
import io
import json
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedup, leakage, ledger, ngrams, rows, splits
from textloom.sources import files, shards
from textloom.streaming import metrics


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hash_split_matches_definition(spark):
    texts = [f"document {i}\n" * (i % 4 + 1) for i in range(200)]
    got = {r.doc_id: r.split for r in splits.hash_split(docs(spark, texts), 1337, 0.1).select("doc_id", "split").collect()}
    for i, side in got.items():
        h = hashlib.sha256(T.HOLDOUT_SALT.encode() + b"\0" + b"1337\0" + texts[i].strip().encode()).digest()
        assert side == ("val" if int.from_bytes(h[:8], "big") < 0.1 * 2**64 else "train")


def test_hash_split_ignores_other_documents_and_surrounding_space(spark):
    base = [f"text number {i}" for i in range(60)]
    side = lambda xs: {r.t: r.split for r in splits.hash_split(docs(spark, xs), 7, 0.3).select(T.strip(F.col("text")).alias("t"), "split").collect()}
    a, b = side(base), side([f"\n\n{x} " for x in base[5:]] + ["more"])
    assert all(b[x] == a[x] for x in base[5:])


@pytest.mark.parametrize("parts", [1, 7])
def test_two_level_dedup(spark, parts):
    texts = ["a\nb", "a \nb\n", "a\nb", "c", "\n c", None]
    got = {r.doc_id: (r.included, r.reason, r.duplicate_of) for r in dedup.two_level(docs(spark, texts[:5]).repartition(parts), F.col("text")).collect()}
    assert got == {0: (True, None, None), 1: (False, "normalized-duplicate", 0), 2: (False, "exact-duplicate", 0), 3: (True, None, None), 4: (False, "normalized-duplicate", 3)}


def test_lines_and_strip(spark):
    texts = ["", "a", "a\n", "a\r\nb\x0bc d", "\n", "x\n\n"]
    got = [r[0] for r in docs(spark, texts).orderBy("doc_id").select(T.lines(F.col("text"))).collect()]
    assert got == [t.splitlines() for t in texts]
    odd = ["　a b ", "\x1c x \x85", "  "]
    assert [r[0] for r in docs(spark, odd).orderBy("doc_id").select(T.strip(F.col("text"))).collect()] == [t.strip() for t in odd]


def test_order_split_never_empties_training_and_best_fraction(spark):
    got = splits.order_split(docs(spark, ["x" * 10]), 1.0, 3).collect()
    assert [r.split for r in got] == ["train"]
    assert splits.best_fraction([5, 5, 90], 0.1) == 0.1
    assert splits.best_fraction([], 0.1) == 0.0


def test_ngram_ordering(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the cat sat on ", "a dog ran to ", "one bird sang "]) for _ in range(30)) + str(i) for i in range(60)]
    nats = {r.model: r.nats for r in ngrams.baselines(docs(spark, texts), 1337, 0.2).collect()}
    assert nats["uniform"] > nats["frequency"] > nats["3-gram"]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(74, 120), st.randoms(use_true_random=False))
def test_winnowing_guarantee(at, run, rng):
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = word(run)
    a, b = word(at) + shared + word(80), word(17) + shared + word(at)
    assert set(leakage.winnowed(a)) & set(leakage.winnowed(b))


def test_verdict_floors(spark):
    cols = "val_docs long, val_docs_in_train long, val_lines long, val_lines_in_train long, val_shingles long, val_shingles_in_train long"
    call = lambda *x: leakage.verdict(spark.createDataFrame([x], cols)).first()
    assert call(10, 0, 19, 10, 100, 0).verdict == "CLEAN"  # too few lines to be read
    assert call(10, 0, 20, 10, 100, 0).verdict == "SUSPECT"
    assert call(10, 0, 3, 3, 100, 0).deciding == "lines"
    assert call(10, 1, 0, 0, 0, 0).verdict == "CONTAMINATED"
    assert call(0, 0, 0, 0, 0, 0).trustworthy


def test_document_rows_layout(spark):
    r = rows.document_rows(docs(spark, ["\nab\n", "abcdef", ""]), 4).orderBy("doc_id").select("x", "y", "n_cut").collect()
    assert r[0] == ([97, 98, 10, 0], [98, 10, 10, -1], 0)
    assert r[1] == ([97, 98, 99, 100], [98, 99, 100, 101], 3)
    assert r[2] == ([10, 0, 0, 0], [10, -1, -1, -1], 0)


def test_fim_parts_concatenate(spark):
    texts = ["", "a", "héllo wörld", None, "x" * 500]
    for r in rows.fim(docs(spark, texts), 0.9, 0.5, 1, 0).collect():
        assert r.prefix + r.middle + r.suffix == (texts[r.doc_id] or "")


def test_patience(spark):
    log = [("a", i, v) for i, v in enumerate([3.0, 2.0, 1.99, 1.98, 1.97])] + [("b", 0, 1.0), ("b", 1, float("nan"))]
    df = spark.createDataFrame(log, "run string, step long, value double")
    got = {r.run: (r.best_step, r.stop_step, r.reason) for r in ledger.patience(df, "run", "step", "value", 3, 0.05).collect()}
    assert got == {"a": (1, 4, "no improvement"), "b": (0, 1, "not finite")}


def container(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_read_any():
    word = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'
    docx = container({"[Content_Types].xml": "<x/>", "_rels/.rels": '<r><x Type="t/officeDocument" Target="word/document.xml"/></r>', "word/document.xml": word})
    assert files.read_any("a.docx", docx)[:2] == ("one\ttwo\nthree", "docx")
    opf = '<p><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></p>'
    epub = container({"META-INF/container.xml": '<c><rootfile full-path="x/p.opf"/></c>', "x/p.opf": opf, "x/a.xhtml": "<p>first</p>", "x/b.xhtml": "<p>second</p>"})
    assert files.read_any("b.epub", epub)[0] == "first\n\nsecond"
    text = "grüße aus köln, wie geht es"
    for name in ("utf-8", "utf-16", "utf-8-sig", "utf-32"):
        assert files.read_any("t.txt", text.encode(name))[0] == text
    assert files.read_any("t.txt", text.encode("cp1252"))[2] == "cp1252"
    assert files.read_any("p.html", b"<script>var t='</p>'</script><p>a&amp;b<p>c")[0] == "a&b\nc"
    for bad in (b"", b"a\0b", b"%PDF-1.4", b"PK\x03\x04broken", None):
        assert files.read_any("x", bad)[1] == "refused"


def test_shards(spark, tmp_path):
    for name, ids in (("a.bin", [1, 2, 3]), ("b.bin", [65535, 7])):
        np.array(ids, "<u2").tofile(tmp_path / name)
    got = shards.one_sequence(shards.read_shards(spark, str(tmp_path), slice_tokens=2)).orderBy("position").collect()
    assert [(r.position, r.token) for r in got] == list(enumerate([1, 2, 3, 65535, 7]))
    assert shards.read_shards(spark, str(tmp_path), limit_tokens=4).count() == 4
    assert [r["size"] for r in shards.manifest(spark, str(tmp_path)).orderBy("name").collect()] == [6, 4]


def test_metric_stream(spark, tmp_path):
    lines = [json.dumps({"run": "a", "step": s, "value": v}) for s, v in ((1, 3.0), (2, 2.0), (2, 2.0), (3, 2.0), (4, 2.0))] + ['{"run": "a", "st']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.json").write_text("\n".join(lines))
    assert metrics.committed(metrics.read_log(spark, str(tmp_path / "in")), 3).count() == 3
    stream = metrics.patience_stream(metrics.read_log(spark, str(tmp_path / "in"), stream=True), 2, 0.1)
    q = stream.writeStream.format("memory").queryName("patience_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    r = spark.table("patience_out").first()
    assert (r.best, r.best_step, r.stopped) == (2.0, 2, True)


def test_studies(spark):
    from textloom.operators import payloads, studies

    nested = spark.createDataFrame([('{"a": {"b": 1, "c": []}, "d": {}}',)], "j string")
    assert sorted(map(tuple, payloads.leaves(nested, "j").collect())) == [("a.b", "1"), ("a.c", "[]"), ("d", "{}")]
    pairs = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), (["a"], ["a"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [tuple(r) for r in pairs.select(*studies.agreement(F.col("a"), F.col("b"))).collect()] == [(1, 1), (1, 1), (0, 0)]


def test_memo_encodes_only_misses(spark):
    from textloom.operators import bpe

    texts = docs(spark, ["x", "yy", "x", "zzz"])
    encoder = lambda df: df.select("doc_id", F.array(F.length("text")).alias("ids"))
    memo = texts.filter("doc_id = 1").select(bpe.cache_key(F.col("text"), "t").alias("cache_key"), F.array(F.lit(9)).alias("ids"))
    every, fresh = bpe.cached(texts, memo, "t", encoder)
    assert {r.doc_id: r.ids for r in every.collect()} == {0: [1], 1: [9], 2: [1], 3: [3]}
    assert fresh.count() == 2


def test_read_files_and_summary(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grüße".encode())
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "c.html").write_bytes(b"<p>one<p>two")
    got = {r.path.rpartition("/")[2]: (r.text, r.word) for r in files.read_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"a.txt": ("grüße", "read"), "b.bin": (None, "not text"), "c.html": ("one\ntwo", "read")}
    assert {(r.word, r.n) for r in files.summary(files.read_files(spark, str(tmp_path), max_bytes=3)).collect()} == {("too big", 2), ("not text", 1)}


def test_running_totals_are_long(spark):
    d = spark.range(8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 30_000_000).alias("text"))
    assert splits.running(d.select("doc_id", F.lit(1).alias("n")), F.col("n")).schema["total"].dataType.simpleString() == "bigint"
    assert splits.stratified(d, 10, 7).count() == 10  # a stratum's edge is total * 10 before it is divided


def test_least_by_passes_over_nulls(spark):
    rows = [("a", 1, None), ("a", 3, 2.0), ("a", 2, 2.0), ("a", None, 1.0), ("b", 4, None)]
    got = spark.createDataFrame(rows, "k string, step long, value double").groupBy("k").agg(ledger.least_by("step", "value").alias("best")).collect()
    assert dict(map(tuple, got)) == {"a": 2, "b": None}


def test_portions_are_bounded_and_whole():
    from textloom.operators.bpe import portions

    texts = ["", "abc", "de", "x" * 9, "", "f"]
    got = list(portions(texts, 5))
    assert sum(got, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 5 for p in got)
    assert list(portions([], 5)) == []


def test_strip_looks_at_ends_only(spark):
    texts = ["", " ", "　\x1c a  b\u0085\n", "a", "é\xa0", "\x00 "]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    made = d.select("text", T.strip(F.col("text")).alias("s"), T.normalized(F.concat(F.lit("x  \n\t y\t\r\n"), "text")).alias("n"))
    for r in made.collect():
        assert r.s == r.text.strip()
        assert r.n == "\n".join(x.rstrip() for x in ("x  \n\t y\t\n" + r.text).splitlines()).strip()


def test_digest_heads_of_any_length():
    rng = random.Random(3)
    data = np.frombuffer(rng.randbytes(4000), np.uint8)
    start = np.array([rng.randrange(3700) for _ in range(500)])
    size = np.array([rng.choice([0, 1, 3, 4, 50, 55, 56, 63, 64, 119, 120, 200]) for _ in start])
    got = leakage.digest_heads(data, start, size)
    assert [f"{x:016x}" for x in got.tolist()] == [hashlib.md5(data[a : a + n].tobytes()).hexdigest()[:16] for a, n in zip(start, size)]


@pytest.mark.parametrize("order,letters", [(1, "ab"), (3, "abé日😀\0"), (3, "".join(map(chr, range(300, 900)))), (9, "".join(map(chr, range(300, 900))))])
def test_gram_counts(order, letters):
    from collections import Counter

    rng = random.Random(order)
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(50)]
    grams, n = ngrams.gram_counts(texts, order)
    assert len(set(grams)) == len(grams)
    assert dict(zip(grams, n.tolist())) == Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))


def test_encoding_by_alphabet_is_linear_and_whole(spark, monkeypatch):
    monkeypatch.setattr(rows, "AT_ONCE", 4)
    docs = spark.createDataFrame([(1, "ab😀cz"), (2, None), (3, ""), (4, "zzb")], "doc_id int, text string").coalesce(1)
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("😀", 2), ("c", 3)], "ch string, id long")
    made = rows.encoded(docs, vocab)
    assert {r.doc_id: r.ids for r in made.collect()} == {1: [0, 1, 2, 3], 2: None, 3: [], 4: [1]}
    assert "Join" not in made._jdf.queryExecution().toString()


def test_windows_are_cut_before_they_are_grouped(spark):
    from textloom.operators import fimstream

    docs = spark.createDataFrame([(i, "ab é " * (40 + i)) for i in range(9)], "doc_id long, text string")
    stream = fimstream.stream(docs, 5, 0, 0.5)
    flat = [x for r in stream.orderBy("before").collect() for x in r.ids]
    made = fimstream.windows(stream, 16, 5, 0)
    found = made.collect()
    assert len(found) == -(-(len(flat) - 2) // 16)
    assert all(r.inputs == flat[r.start : r.start + 16] and r.targets == flat[r.start + 1 : r.start + 17] for r in found)
    grouped = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [draw" in x]
    assert grouped and not any("slice(ids" in x.split("collect_list", 1)[1].split("]", 1)[0] for x in grouped)
