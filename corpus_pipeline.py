"""A cleaning pipeline over the documents table: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import Scratch
from textloom.llm.decontaminate import drop_contaminated
from textloom.llm.neardup import keep_one
from textloom.llm.packing import pack, token_pieces, tokenizer_path
from textloom.llm.pii import redact
from textloom.llm.toxicity import drop_toxic


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of 4096."""
    return pack(token_pieces(docs, tokenizer_path()), spark)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact),
    ("best_fit_packing", packed),
]

#: Trained classifiers, fingerprints and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
