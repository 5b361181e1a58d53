"""Shared helpers of the training-data operators: tables, scratch space, training masks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session without one gets a folder of ours."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written into the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and returns the reread table."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as decimal text, as a non-negative long."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def numbered(docs: DataFrame, scratch: Scratch, name: str = "rows", column: str = "row") -> DataFrame:
    """The rows with a number of their own, written so that it stays the same whatever is lost: ids may be null or repeat."""
    return scratch.keep(docs.withColumn(column, F.monotonically_increasing_id()), name)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed(rows: DataFrame, scratch: Scratch, group: str, order: list[str], name: str = "placed") -> DataFrame:
    """rows with ``place``, the number (from 0) of each in its group by ``order``; the group column holds no null.

    The rows are dealt by ranges of (group, order), so that a group of any size is spread, and numbered as they
    pass in sorted order.  Only a partition's first group can go on from the partition before, so what is added
    to the numbers is one row a partition at most, and broadcast.  Nulls order first; rows equal in group and
    order take their places in any order.
    """
    schema = rows.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the group that the batch before ended in, and its rows so far
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(group).to_pylist(), object)
            cut = np.append(True, keys[1:] != keys[:-1])
            starts = np.flatnonzero(cut)
            rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
            if keys[0] == last:
                rank[: starts[1] if len(starts) > 1 else None] += seen
            head = np.zeros(len(keys), bool)
            head[0], first = first, False
            last, seen = keys[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank), pa.array(head)], names=[*batch.schema.names, "_rank", "_head"])

    ordered = rows.repartitionByRange(shuffle_parts(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    made = StructType([*schema.fields, StructField("_part", IntegerType()), StructField("_rank", LongType()), StructField("_head", BooleanType())])
    kept = scratch.keep(ordered.withColumn("_part", F.spark_partition_id()).mapInArrow(number, made), name)
    heads = kept.filter("_head").select(group, "_part")  # one row a partition
    sizes = kept.join(F.broadcast(heads.select(group).distinct()), group, "left_semi").groupBy(group, "_part").count()
    before = sizes.select(group, "_part", F.sum("count").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    moved = kept.join(F.broadcast(before.join(heads, [group, "_part"], "left_semi")), [group, "_part"], "left")
    return moved.select(*schema.names, (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias("place"))
