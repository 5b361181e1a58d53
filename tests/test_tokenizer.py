"""Learned tokenizers against one merge at a time, their sentinels and files, and the memo of encodings."""

from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from textloom.operators import bpe, bpefit, records
from textloom.sources.scratch import Scratch

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def one_at_a_time(texts, size, least):
    _, ids = bpefit.alphabet()
    words = [([int(ids[b]) for b in w.encode()], n) for w, n in Counter(w for t in texts for w in PIECES.findall(t or "")).items()]
    merges = []
    while 256 + len(merges) < size:
        found = Counter()
        for s, n in words:
            for p in zip(s, s[1:]):
                found[p] += n
        if not found:
            break
        (a, b), n = min(found.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        for s, _ in words:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [256 + len(merges)]
                i += 1
        merges.append((a, b))
    return merges


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


r = np.random.default_rng(8)
SYLLABLES = ["an", "ta", "aa", "é", "日本", "x1", "the", "n't", "\U0001d11e"]
TEXTS = [None, "", "aaaaaaa aaaa aaa  aa\n\na", "don't  we'll\tI'm 'd", "   x\x1cy\x85z"] + [" ".join("".join(r.choice(SYLLABLES, r.integers(1, 5))) for _ in range(60)) for _ in range(25)]


@pytest.mark.parametrize("size,least,compact", [(420, 2, 8), (300, 1, 2), (700, 3, 3)])
def test_fit_equals_one_merge_at_a_time(spark, monkeypatch, size, least, compact):
    monkeypatch.setattr(bpefit, "COMPACT", compact)
    want = one_at_a_time(TEXTS, size, least)
    assert bpefit.fit(table(spark, TEXTS).repartition(3), Scratch(spark, "t"), size, least) == want and len(want) > 40


def test_fit_of_runs(spark):
    texts = ["a" * n + " " + "ab" * (n % 5) for n in range(1, 40)]
    assert bpefit.fit(table(spark, texts), Scratch(spark, "t"), 290, 1) == one_at_a_time(texts, 290, 1)


def test_a_batch_stops_where_the_order_is_not_sure():
    assert bpefit.batch_of([(1, 2, 9), (3, 4, 8), (5, 6, 7)], {0: 5, 1: 7}, 2) == [(1, 2), (3, 4)]  # (.., 34) might be as frequent as (5, 6)
    assert bpefit.batch_of([(1, 2, 9), (2, 3, 8)], {}, 2) == [(1, 2)]  # takes a 2
    assert bpefit.batch_of([(1, 2, 9), (1, 3, 8), (4, 2, 7)], {}, 2) == [(1, 2), (1, 3), (4, 2)]
    assert bpefit.batch_of([(1, 1, 9), (1, 3, 8)], {}, 2) == [(1, 1)]
    assert bpefit.batch_of([(1, 2, 1)], {}, 2) == []


def test_fitted_tokenizer(spark, tmp_path):
    texts = table(spark, TEXTS)
    held_out = "zq" * 30
    with_held_out = texts.withColumn("split", F.lit("train")).unionByName(spark.createDataFrame([(99, held_out, "val")] * 9, "doc_id long, text string, split string"))
    payload = bpefit.fit_tokenizer(with_held_out.filter("split = 'train'"), Scratch(spark, "t"), 330)
    assert payload == bpefit.fit_tokenizer(texts, Scratch(spark, "t"), 330)
    vocab = payload["backend"]["model"]["vocab"]
    assert len(vocab) == 330 and not any("zq" in s for s in vocab) and set(bpefit.byte_letters()) <= set(vocab)
    backend = bpefit.json.dumps(payload["backend"])
    assert bpefit.lost(table(spark, [held_out, "\x00\x01 \r\n\t", "".join(map(chr, range(1, 0x300))), "𝔘​日"]), backend) == 0
    marked = bpefit.with_sentinels(payload, ["<end>", "<pad>"])
    with pytest.raises(ValueError):
        bpefit.with_sentinels(marked, ["x"])
    path = str(tmp_path / "tok.json")
    bpefit.save_tokenizer(spark, path, marked)
    bpefit.save_tokenizer(spark, path, marked)
    assert bpefit.load_tokenizer(spark, path) == marked
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(backend)
    ids = tok.encode("antaé", add_special_tokens=False).ids
    assert bpefit.decode(marked, [330, *ids, 331, *ids]) == "<end>antaé<pad>antaé"
    assert 330 not in tok.encode("<end>", add_special_tokens=False).ids
    (tmp_path / "other.json").write_text('["a"]')
    with pytest.raises(ValueError):
        bpefit.load_tokenizer(spark, str(tmp_path / "other.json"))
    a, b = (tmp_path / f"{n}.json" for n in "ab")
    a.write_text(bpefit.json.dumps(payload))
    b.write_text(bpefit.json.dumps({**payload, "training": {"other": 1}}))
    assert records.tokenizer_fingerprint(str(a)) == records.tokenizer_fingerprint(str(b)) != records.tokenizer_fingerprint(path)


def test_fit_refuses(spark):
    for texts, size, least in ((["a"], 255, 2), (["a"], 300, 0), ([None, ""], 300, 2)):
        with pytest.raises(ValueError):
            bpefit.fit_tokenizer(table(spark, texts), Scratch(spark, "t"), size, least)


def test_memo(spark, tmp_path):
    path = tmp_path / "tok.json"
    path.write_text(bpefit.tokenizer_json(one_at_a_time(TEXTS, 300, 2)))
    memo = str(tmp_path / "memo")
    first = table(spark, ["anta the", "anta the", None, "x1x1"])
    want = {r.doc_id: r.ids for r in bpe.encode(first, str(path)).collect()}
    assert {r.doc_id: r.ids for r in bpe.encode_cached(first, str(path), memo, "f1").collect()} == want
    assert bpe.read_memo(spark, memo, "f1").count() == 3 and bpe.read_memo(spark, memo, "f2").count() == 0
    spark.createDataFrame([(r.cache_key, [7]) for r in bpe.read_memo(spark, memo, "f1").collect()], "cache_key string, ids array<int>").withColumn("seal", F.lit(1).cast("long")).write.mode("overwrite").parquet(memo + "/f1")
    (tmp_path / "memo" / "f1" / "part-broken.parquet").write_bytes(b"PAR1 this is no table")
    assert {r.doc_id: r.ids for r in bpe.encode_cached(first, str(path), memo, "f1").collect()} == want  # rows without their seal and broken files are misses
    away = path.rename(tmp_path / "away.json")
    assert {r.doc_id: r.ids for r in bpe.encode_cached(first, str(path), memo, "f1").collect()} == want  # all from the memo
    assert {r.doc_id: r.ids for r in bpe.encode_cached(first, str(away), "nosuch://memo", "f1").collect()} == want


ODD = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2009", "\u3000", "'", "'s", "'re", "'l", "''", "a", "bc", "é", "日本", "の", "ж", "1", "²", "_", "!", "’", "\u0301", "😀", "\u0378", "한", "\x00", "e", "ll"]


@pytest.mark.parametrize("size", [256, 300, 420])
def test_encoder_in_columns_equals_the_library(size):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from textloom.operators import pieces

    rng = np.random.default_rng(size)
    texts = ["".join(rng.choice(ODD, rng.integers(0, 25))) for _ in range(3000)] + ["", "'s", "a" * 400 + " b", "x" + " " * 9]
    learned = bpefit.tokenizer_json(one_at_a_time(texts[:300], size, 1))
    library, encoder = Tokenizer.from_str(learned), bpefit.Encoder(learned)
    asked = []
    encoder._by_library, inner = lambda part: (asked.extend(part), inner(part))[1], encoder._by_library
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for share in (200, 1 << 24):
        got = [encoder.texts(s) for s in pieces.shares(pa.array([*texts, None]), share)]
        assert np.concatenate([n for n, _ in got]).tolist() == [*want, 0] and not any(other for _, other in got)
    asked.clear()
    (share,) = pieces.shares(pa.array(["for a while, it's the " + "\u0378 " * 50] * 200))
    encoder.texts(share)
    assert asked == [" \u0378"]  # each distinct stretch once, settled ones not at all


def test_encoder_tells_texts_that_are_not_kept():
    import pyarrow as pa

    encoder = bpefit.Encoder(bpefit.tokenizer_json([]))
    encoder.spelled = np.roll(encoder.spelled, 1)  # columns decode wrongly: the library has the last word
    (texts,) = bpefit.pieces.shares(pa.array(["ab", "c", None]))
    assert encoder.texts(texts)[1] == {} and encoder.texts(texts)[0].tolist() == [2, 1, 0]
    encoder._by_library = lambda part: [(len(t), b"?") for t in part]
    assert encoder.texts(texts)[1] == {0: b"?", 1: b"?"}


def test_fitted_tokens_of_odd_documents(spark, tmp_path):
    import duckdb

    from textloom.plans.catalog import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(5)
    texts = [None, "", *("".join(rng.choice([c for c in ODD if c != "\x00"], rng.integers(1, 40))) for _ in range(80)), *TEXTS[2:]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(x) for x in QUERIES["fitted_tokens"](spark, str(tmp_path)).select("doc_id", "n_tokens", "decoded_sha1").collect())
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(f"select doc_id, n_tokens, decoded_sha1 from ({ORACLE_SQL['fitted_tokens']})").fetchall())
    assert got[0] == (0, 0, None)
