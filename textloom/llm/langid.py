"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are folded to a small alphabet; filters of widths 2 and 3 run over fixed-length windows, max pooling
takes each filter's largest response in a window, and a softmax layer turns those into language
probabilities.  A filter's response to a run of symbols is a sum of per-place weights, so it is tabulated
once for every run of its width and read by lookup.  A text's score is the mean over all its windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import id_crc, table

WINDOW = 256
WIDTHS = (2, 3)
FILTERS = 12
#: At most so many documents of each language are fitted on, with all their windows.
SAMPLE_PER_LANGUAGE = 300


def _alphabet() -> tuple[np.ndarray, int]:
    """Symbol of each byte: letters by themselves, trail bytes by their low five bits, lead bytes by the scripts that they begin."""
    symbol = np.zeros(256, np.int64)  # 0: white space, digits and other ASCII
    for i in range(26):
        symbol[97 + i] = symbol[65 + i] = 1 + i
    symbol[0x80:0xC0] = 27 + np.arange(64) % 32  # lower and upper case of Latin-1 letters share the low five bits
    # first lead bytes of: Latin-1, further Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic, Indic, Georgian and others, symbols, kana, Han, Hangul, forms, beyond
    starts = (0xC0, 0xC4, 0xCD, 0xD0, 0xD4, 0xD8, 0xE0, 0xE1, 0xE2, 0xE3, 0xE4, 0xEA, 0xEE, 0xF0)
    symbol[0xC0:] = 58 + np.searchsorted(starts, np.arange(0xC0, 0x100), side="right")
    return symbol, 59 + len(starts)


SYMBOL, SYMBOLS = _alphabet()


def windows_of(raw: bytes) -> np.ndarray:
    """(n, WINDOW) symbols covering the whole text; the last window ends at the text's end, a short text is padded with symbol 0."""
    s = SYMBOL[np.frombuffer(raw, np.uint8)]
    if len(s) <= WINDOW:
        return np.concatenate([s, np.zeros(WINDOW - len(s), np.int64)])[None, :]
    whole = len(s) // WINDOW
    out = s[: whole * WINDOW].reshape(whole, WINDOW)
    return out if whole * WINDOW == len(s) else np.concatenate([out, s[-WINDOW:][None, :]])


@dataclass
class Network:
    """``filters[w]`` is (w, SYMBOLS, FILTERS); ``dense`` and ``bias`` map pooled responses to languages."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> dict[int, np.ndarray]:
        out = {}
        for w, k in self.filters.items():
            t = k[0]
            for place in k[1:]:
                t = (t[:, None, :] + place[None, :, :]).reshape(-1, k.shape[2])
            out[w] = np.ascontiguousarray(t, np.float32)
        return out

    def probabilities(self, symbols: np.ndarray, tables: dict[int, np.ndarray], block: int = 256) -> np.ndarray:
        """(n, languages) for windows of symbols, in blocks of bounded memory."""
        out = []
        for a in range(0, len(symbols), block):
            part = symbols[a : a + block]
            pooled, code, size = [], part, 1
            for w in WIDTHS:
                while size < w:
                    code = code[:, :-1] * SYMBOLS + part[:, size:]
                    size += 1
                pooled.append(tables[w][code].max(axis=1))
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def fit(symbols: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, seed: int = 7) -> Network:
    """Adam on cross-entropy; gradients pass the pooling through the place of each filter's largest response."""
    rng = np.random.default_rng(seed)
    p: dict = {w: rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)) for w in WIDTHS}
    p |= {"dense": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages))}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    t = 0
    net = Network(languages, {w: p[w] for w in WIDTHS}, p["dense"], p["bias"])
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(symbols)), max(1, len(symbols) // batch)):
            x, y = symbols[at], labels[at]
            tables, pooled, places, code, size = net.tables(), [], {}, x, 1
            for w in WIDTHS:
                while size < w:
                    code = code[:, :-1] * SYMBOLS + x[:, size:]
                    size += 1
                response = tables[w][code]
                places[w] = response.argmax(axis=1)
                pooled.append(np.take_along_axis(response, places[w][:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, axis=1)
            h = np.maximum(raw, 0)
            z = h @ p["dense"] + p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z /= len(y)
            g = {"dense": h.T @ z, "bias": z.sum(axis=0)}
            back = (z @ p["dense"].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                grad = np.zeros_like(p[w])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(grad[k], (np.take_along_axis(x, places[w] + k, 1), np.arange(FILTERS)[None, :]), part)
                g[w] = grad
            t += 1
            for k, x_ in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                x_ -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return net


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """Fits on a bounded sample: the ``per_language`` documents of each language with the least id hash, held-out ids excluded.

    Rows with null id, text or lang are not used; repeated rows count as they come, but no more than the bound; None
    if there are none.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter("lang is not null and text is not null").filter(id_crc() % 4 != 2)
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as there are languages
    if not sizes:
        return None
    languages = sorted(sizes)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    hashed = named.select("doc_id", "lang", h.alias("h"))
    share, ids = 2.0, None
    while True:  # hashes below a bar give a few more than are wanted; a bar that gives too few is raised
        bars = {k: min(1.0, (share * per_language + 50) / n) for k, n in sizes.items()}
        bar = F.lit(0.0)
        for k, b in bars.items():
            bar = F.when(F.col("lang") == k, F.lit(b * 2.0**40)).otherwise(bar)
        ids = hashed.filter(F.col("h") < bar).collect()  # about twice the bound of each language, whatever the table's size
        got = Counter(r["lang"] for r in ids)
        if all(got[k] >= min(per_language, sizes[k]) or bars[k] >= 1 for k in sizes):
            break
        share *= 2
    chosen = []
    for k in languages:
        chosen += sorted((r["h"], r["doc_id"]) for r in ids if r["lang"] == k)[:per_language]
    picked = docs.sparkSession.createDataFrame([(x,) for x in sorted({d for _, d in chosen})], "doc_id long")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [windows_of(t.as_py().encode()).astype(np.uint8).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "lang", "x"])

    got = named.join(F.broadcast(picked), "doc_id").mapInArrow(draw, "doc_id long, lang string, x binary").collect()  # of the bounded sample
    got.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    xs = [np.frombuffer(r["x"], np.uint8).reshape(-1, WINDOW).astype(np.int64) for r in got]
    ys = [np.full(len(x), languages.index(r["lang"])) for x, r in zip(xs, got)]
    return fit(np.concatenate(xs), np.concatenate(ys), languages)


def predict(docs: DataFrame, net: Network | None, spark: SparkSession) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``und`` and 0 for a null text or one without a letter.

    Repeated rows give repeated rows, a null id stays null, an empty table gives none.
    """
    held = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        tables = net.tables() if net else {}
        for batch in batches:
            names, scores = [], []
            for t in batch.column(1):
                text = t.as_py()
                if net is None or not text or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                mean = net.probabilities(windows_of(text.encode()), tables).mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                names.append(net.languages[best])
                scores.append(min(1.0, float(mean[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs), spark)
    return found.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")
