"""Byte-level BPE by a tokenizer file: applied in Arrow batches, with a durable memo of encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters that a tokenizer is given at once: each token's record takes a hundred bytes and more beside its id.
AT_ONCE = 1 << 18


def portions(texts: list[str | None], size: int = AT_ONCE) -> Iterator[list[str]]:
    """The texts in order, in runs of at most size characters; a longer text stands alone."""
    run, room = [], size
    for t in texts:
        n = len(t or "")
        if run and n > room:
            yield run
            run, room = [], size
        run.append(t)
        room -= n
    if run:
        yield run


def encode(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", id_type: str = "long") -> DataFrame:
    """(doc_id, ids) by a tokenizer file, which each worker loads once; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = None
        for batch in batches:
            if tok is None:
                tok = Tokenizer.from_file(tokenizer_path)
                tok.encode_special_tokens = True
            at = 0
            for texts in portions([t or "" for t in batch.column(1).to_pylist()]):
                ids = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                at += len(ids)

    return df.select(F.col(id_column).cast(id_type).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>")


KEPT = "cache_key string, ids array<int>, seal long"


def cache_key(text, fingerprint: str):
    """Key of a memoised encoding: the text's digest and the tokenizer's."""
    return F.concat(F.sha2(text, 256), F.lit(":" + fingerprint))


def seal() -> Column:
    """What a memo's row must have beside its key and ids; a row that hasn't is a miss."""
    return F.xxhash64("cache_key", "ids")


def read_memo(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame:
    """(cache_key, ids) of a tokenizer's memo: missing or damaged files, and rows without their seal, are misses."""
    path = f"{folder.rstrip('/')}/{fingerprint}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], KEPT).select("cache_key", "ids")
    rows = spark.read.schema(KEPT).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
    good = rows.filter(F.col("seal") == seal())
    return good.groupBy("cache_key").agg(F.any_value("ids").alias("ids"))  # two writers may have added a text each


def cached(df: DataFrame, memo: DataFrame, fingerprint: str, encoder) -> tuple[DataFrame, DataFrame]:
    """(all encodings, those to append to the memo): only texts that the memo lacks are encoded, equal ones once."""
    keyed = df.withColumn("cache_key", cache_key(F.col("text"), fingerprint))
    misses = keyed.join(memo.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    fresh = encoder(misses).join(misses.select("doc_id", "cache_key"), "doc_id").select("cache_key", "ids")
    every = memo.select("cache_key", "ids").unionByName(fresh)
    return keyed.select("doc_id", "cache_key").join(every, "cache_key").select("doc_id", "ids"), fresh


def encode_cached(df: DataFrame, tokenizer_path: str, folder: str, fingerprint: str) -> DataFrame:
    """(doc_id, ids) of (doc_id, text) with unique ids, read from the memo in a shared folder where it has them; what it lacked is added.

    Null texts count as empty.  If the memo can't be read or written the encodings are made all the same.
    """
    spark, texts = df.sparkSession, df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lookup = lambda: cached(texts, read_memo(spark, folder, fingerprint), fingerprint, lambda m: encode(m, tokenizer_path))
    try:
        lookup()[1].withColumn("seal", seal()).write.mode("append").parquet(f"{folder.rstrip('/')}/{fingerprint}")
        return lookup()[0]
    except (Py4JJavaError, PySparkException):
        return encode(texts, tokenizer_path)
