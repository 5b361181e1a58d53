"""Leakage between two sides at document, line and winnowed-fingerprint level, and the verdict on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.bpe import portions

#: Gram length, window, and for each arm the bars of CONTAMINATED and SUSPECT.
GRAM, WINDOW = 50, 25
BARS = {"content": (0.20, 0.05), "documents": (0.10, 0.01), "lines": (0.90, 0.50)}
MIN_LINES, DECISIVE_LINES, DECISIVE = 20, 3, 0.90
#: MD5's constants and turns.
SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
TURNS = [[np.uint32(x) for x in row] for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
#: A validation side of at most so many characters has at most as many hashes of 64 bytes, and is broadcast.
BROADCAST_CHARS = 2_000_000


def gram_hash(gram: Column) -> Column:
    """64 bits of a gram as hex."""
    return F.substring(F.md5(gram), 1, 16)


def fingerprints(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, h): distinct winnowed hashes of each text.

    The least of 25 consecutive gram hashes is taken beside the text, so no text's grams are shuffled; array
    functions would take time in the square of its length.  A text shorter than a gram gives one hash, a blank one none, and one of fewer than 25 grams gives all.
    """
    kept = T.strip(F.col(text)) != ""

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for texts in portions(batch.column(1).to_pylist()):
                which, least = winnowed_texts(texts)
                digits = least.astype(">u8").tobytes().hex().encode()
                hexed = pa.StringArray.from_buffers(len(least), pa.py_buffer(np.arange(0, len(digits) + 1, 16, dtype=np.int32)), pa.py_buffer(digits))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at + which], pa.int64()), hexed], names=[key, "h"])
                at += len(texts)

    return df.filter(kept).select(F.col(key).cast("long").alias(key), F.col(text).alias("t")).mapInArrow(winnow, f"{key} long, h string")


def digest_heads(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First 64 bits of the MD5 of each piece of data (bytes), many pieces a step; the pieces may overlap."""
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([data, np.zeros(64, np.uint8)]).astype(np.uint32)
    word = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24  # the four bytes from each place on
    blocks = (size + 8) // 64 + 1
    for k in np.unique(blocks).tolist():
        of = np.flatnonzero(blocks == k)
        for some in np.array_split(of, max(1, len(of) // 8192)):
            out[some] = _heads(word, start[some], size[some], k)
    return out


def _heads(word: np.ndarray, start: np.ndarray, size: np.ndarray, blocks: int) -> np.ndarray:
    state = [np.full(len(start), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    even = int(size.min()) if len(size) else 0
    for block in range(blocks):
        m = []
        for j in range(16 * block, 16 * block + 16):
            if 4 * j + 4 <= even:
                m.append(word[start + 4 * j])
                continue
            left = np.clip(size - 4 * j, -1, 4)  # bytes of the piece in this word; the mark follows them
            here = np.where(left > 0, word[np.minimum(start + 4 * j, len(word) - 1)], 0).astype(np.uint64)
            bits = 8 * np.clip(left, 0, 3).astype(np.uint64)
            ended = (here & ((np.uint64(1) << bits) - np.uint64(1))) | (np.uint64(0x80) << bits)
            m.append(np.where(left >= 4, here, np.where(left >= 0, ended, 0)).astype(np.uint32))
        if block == blocks - 1:
            m[14] = (8 * size).astype(np.uint32)
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += m[g]
            f += SINES[i]
            turned = f << TURNS[i // 16][i % 4]
            f >>= np.uint32(32 - int(TURNS[i // 16][i % 4]))
            f |= turned
            f += b
            a, d, c, b = d, c, b, f
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return state[0].byteswap().astype(np.uint64) << np.uint64(32) | state[1].byteswap()


def winnowed_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's place in the list, hash): distinct window minima of each text's gram hashes, in order."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    char = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
    length = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, length - GRAM + 1)
    which = np.repeat(np.arange(len(texts)), n)
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.cumsum(length) - length
    begin = first[which] + own
    start = char[begin]
    hashes = digest_heads(data, start, char[np.minimum(begin + GRAM, (first + length)[which])] - start)
    least, size = hashes, 1
    while 2 * size <= WINDOW:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(hashes) - WINDOW + 1], least[WINDOW - size :]) if len(hashes) >= WINDOW else hashes[:0]
    windowed = n[which] >= WINDOW
    whole = np.flatnonzero(windowed & (own <= n[which] - WINDOW))  # a window's first gram, the window inside the text
    place, value = np.concatenate([which[whole], which[~windowed]]), np.concatenate([least[whole], hashes[~windowed]])
    order = np.lexsort((value, place))
    place, value = place[order], value[order]
    new = np.append(True, (place[1:] != place[:-1]) | (value[1:] != value[:-1]))[: len(place)]
    return place[new], value[new]


def winnowed(text: str) -> list[str]:
    """Distinct window minima of a text's gram hashes."""
    return [f"{x:016x}" for x in winnowed_texts([text])[1].tolist()]


def lines_of(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(F.split(text, "\n", -1)).alias("line"))


def small(val: DataFrame) -> bool:
    """Whether a validation side's hashes are few enough to broadcast."""
    return (val.agg(F.sum(F.length("text"))).first()[0] or 0) <= BROADCAST_CHARS


def met(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """(h): the distinct hashes of the right side that the left has; they meet before anything of the right is grouped."""
    wanted = left.select("h").distinct()
    return right.select("h").join(F.broadcast(wanted) if few else wanted, "h", "left_semi").distinct()


def scan(train: DataFrame, val: DataFrame) -> DataFrame:
    """One row of counts: documents, lines and fingerprints of the validation side, and those found in training.

    The training side is met with the validation side's distinct hashes before anything of it is grouped: by
    broadcast if the validation side has few characters, else by a shuffled join of hashes.
    """
    count = lambda df, names: df.agg(F.count("*").alias(names[0]), F.count_if("hit").alias(names[1]))

    few = small(val)

    def arm(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
        marked = met(left, right, few).withColumn("hit", F.lit(True))
        return count(left.join(marked, "h", "left").select(F.coalesce("hit", F.lit(False)).alias("hit")), names)

    hashed = lambda df, c="text": df.select(F.sha2(c, 256).alias("h"))
    documents = arm(hashed(val), hashed(train), ("val_docs", "val_docs_in_train"))
    lines = arm(hashed(lines_of(val).filter(T.strip(F.col("line")) != ""), "line"), hashed(lines_of(train), "line"), ("val_lines", "val_lines_in_train"))
    content = arm(fingerprints(val, "_k").select("h").distinct(), fingerprints(train, "_k"), ("val_shingles", "val_shingles_in_train"))
    return documents.crossJoin(lines).crossJoin(content)  # three rows of counts


def call(x: Column, arm: str) -> Column:
    """An arm's word for the share of the held-out side found in training."""
    bad, odd = BARS[arm]
    return F.when(x >= bad, "CONTAMINATED").when(x >= odd, "SUSPECT").otherwise("CLEAN")


def verdict(counts: DataFrame, doc_aligned: bool = True) -> DataFrame:
    """Fractions, calls of the arms that are read, the worst of them and who decided it."""
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 9)
    df = counts.withColumn("doc_frac", share("val_docs_in_train", "val_docs")).withColumn("line_frac", share("val_lines_in_train", "val_lines")).withColumn("content_frac", share("val_shingles_in_train", "val_shingles"))
    read_lines = (F.col("val_lines") >= MIN_LINES) | ((F.col("val_lines") >= DECISIVE_LINES) & (F.col("line_frac") >= DECISIVE))
    calls = {"content": call(F.col("content_frac"), "content"), "documents": F.when(F.lit(doc_aligned), call(F.col("doc_frac"), "documents")), "lines": F.when(read_lines, call(F.col("line_frac"), "lines"))}
    rank = lambda c: F.when(c == "CONTAMINATED", 2).when(c == "SUSPECT", 1).when(c == "CLEAN", 0)
    worst = F.greatest(*(rank(c) for c in calls.values()))
    df = df.withColumn("verdict", F.element_at(F.array(*(F.lit(x) for x in ("CLEAN", "SUSPECT", "CONTAMINATED"))), worst + 1))
    deciding = F.array_join(F.filter(F.array(*(F.when((rank(c) == worst) & (worst > 0), F.lit(n)) for n, c in calls.items())), lambda x: x.isNotNull()), ",")
    out = df.withColumn("deciding", deciding).withColumn("trustworthy", F.col("verdict") == "CLEAN")
    return out if doc_aligned else out.withColumn("doc_frac", F.lit(None).cast("double"))


def eligibility(df: DataFrame) -> DataFrame:
    """The first reason against a claim on this holdout: no text, the split, or leakage."""
    reason = F.when(F.col("val_chars") == 0, "no held-out text").when(F.col("split_verdict").isNotNull(), F.concat(F.lit("split: "), "split_verdict")).when(F.coalesce("leak_verdict", F.lit("SCAN_FAILED")) != "CLEAN", F.concat(F.lit("leakage: "), F.coalesce("leak_verdict", F.lit("SCAN_FAILED"))))
    return df.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())
