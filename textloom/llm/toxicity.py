"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed byte n-grams (3 to 5 bytes, ASCII letters lower-cased, white
space runs as one space) that it holds anywhere.  Each feature's value is the log ratio of its smoothed
document frequencies under label 1 and label 0; a logistic regression on these values gives the weights.
Fitting reads a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.llm.common import Scratch, id_crc, table

HASH_BITS = 18
ORDERS = (3, 4, 5)
#: At most so many labelled rows of each label are fitted on, those with the least hash of doc_id.
SAMPLE_PER_LABEL = 2_500
#: Features of the classifier: those of largest chi-square in the sample.
FEATURES = 4_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_codes(text: str | None) -> list[np.ndarray]:
    """Hashed codes of the byte n-grams of a text, one array for each order; a null text has none of its own."""
    raw = _FOLD[np.frombuffer(b" " + (text or "").encode() + b" ", np.uint8)]
    raw = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))].astype(np.uint64)
    out = []
    code, size = raw, 1
    for n in ORDERS:
        while size < n and len(code) > 1:
            code = (code[:-1] << np.uint64(8)) | raw[size:]
            size += 1
        if size < n:
            break
        out.append((((code + np.uint64(n)) * _MIX) >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return out


def features(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a text, ascending."""
    seen = np.zeros(1 << HASH_BITS, bool)
    for codes in ngram_codes(text):
        seen[codes] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """``weights`` over hashed n-grams (zero for most) and a bias; their sum's logistic value is the score."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        used = self.weights != 0 if not hasattr(self, "_used") else self._used
        self._used = used
        hits = [codes[used[codes]] for codes in ngram_codes(text)]
        found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int32)
        z = self.bias + float(self.weights[found].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(chosen: np.ndarray, ratio: np.ndarray, cols: list[np.ndarray], labels: np.ndarray, steps: int = 250, decay: float = 2e-3, prior: float | None = None) -> Model:
    """Logistic regression by full-batch gradient descent (Adam) on features scaled by their log-count ratios.

    ``cols`` holds the places in ``chosen`` of each row's features.  ``prior`` is the share of label 1 that
    the bias is set for; rows of one label only give a constant score.
    """
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << HASH_BITS), 0.0 if not len(y) else (20.0 if y[0] else -20.0))
    n1, n0 = y.sum(), len(y) - y.sum()
    matrix = np.zeros((len(cols), len(chosen)), np.float32)
    for i, c in enumerate(cols):
        matrix[i, c] = ratio[c]
    scale = np.where(y == 1, 0.5 / n1, 0.5 / n0) if prior is None else np.where(y == 1, prior / n1, (1 - prior) / n0)
    w, bias, vw, vb = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
    second_w, second_b = np.zeros(len(chosen)), 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(matrix @ w.astype(np.float32) + bias, -40, 40)))
        g = (p - y) * scale
        gw, gb = matrix.T @ g.astype(np.float32) + decay * w / len(chosen), g.sum()
        vw, vb = 0.9 * vw + 0.1 * gw, 0.9 * vb + 0.1 * gb
        second_w, second_b = 0.99 * second_w + 0.01 * gw**2, 0.99 * second_b + 0.01 * gb**2
        w -= 0.02 * (vw / (1 - 0.9**t)) / (np.sqrt(second_w / (1 - 0.99**t)) + 1e-8)
        bias -= 0.05 * (vb / (1 - 0.9**t)) / (np.sqrt(second_b / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << HASH_BITS)
    weights[chosen] = w * ratio
    return Model(weights.astype(np.float32), float(bias))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["toxic", "x"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the features under each label, summed over a task's rows."""
    total = np.zeros((2, 1 << HASH_BITS), np.int64)
    for batch in batches:
        for label, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[label, np.frombuffer(x.as_py(), np.int32)] += 1
    used = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[0, used]), pa.array(total[1, used])], names=["feature", "neg", "pos"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, keep: int = FEATURES, alpha: float = 1.0) -> Model:
    """Fits on at most ``per_label`` labelled rows of each label (a documented bound), with ids outside the held-out fifth.

    The ``keep`` features of largest chi-square are used; only their counts and the rows' places among them
    reach the driver.  Rows with a null label, and documents without a label, are not used; a null text
    counts as empty.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(id_crc() % 5 != 0)
    shares = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    drawn = [marked.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(per_label) for t in (0, 1)]
    picked = F.broadcast(drawn[0].unionByName(drawn[1]))  # per_label rows of two numbers for each label
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").select("toxic", "text")
    scratch = Scratch(spark, "toxicity")
    held = scratch.keep(both.mapInArrow(_extract, "toxic int, x binary"), "features")
    n = {r["toxic"]: float(r["n"]) for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0.0), n.get(1, 0.0)
    counts = held.mapInArrow(_count, "feature int, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    gap = a * (n0 - b) - b * (n1 - a)
    chi = F.try_divide((n0 + n1) * gap * gap, F.lit(n1 * n0) * (a + b) * (F.lit(n0 + n1) - a - b))
    top = counts.withColumn("chi", chi).filter("chi > 0").orderBy(F.desc("chi"), "feature").limit(keep).collect()
    top.sort(key=lambda r: r["feature"])
    chosen = np.array([r["feature"] for r in top], np.int64)
    ratio = np.array([np.log((r["pos"] + alpha) / (n1 + 2 * alpha)) - np.log((r["neg"] + alpha) / (n0 + 2 * alpha)) for r in top])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            rows = [place[np.frombuffer(x.as_py(), np.int32)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[r >= 0].tobytes() for r in rows], pa.binary())], names=["toxic", "x"])

    got = held.mapInArrow(narrow, "toxic int, x binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))  # the order of arrival must not matter
    scratch.drop("features")
    total = sum(shares.values())
    return fit(chosen, ratio, [np.frombuffer(r[1], np.int32) for r in got], np.array([r[0] for r in got]), prior=shares.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, spark: SparkSession, text_column: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (score >= 0.5) to docs, whatever its other columns are; the model is of fixed size."""
    held = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            s = pa.array([model.score(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_column))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s], names=[*batch.schema.names, "score"])

    clean = docs.drop("score", "predicted")
    scored = clean.mapInArrow(run, StructType([*clean.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, spark)
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they are.

    The model learns from the labelled documents of the table the run began with.
    """
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(docs, model, spark).filter("predicted = 0").select(*docs.columns)
