"""Token shards of little-endian uint16 ids: a Python data source, manifest and the shards as one sequence."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "shard string, offset long, token int"


class Slice(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(os.path.join(options["path"], "*.bin")) if os.path.isdir(options["path"]) else glob.glob(options["path"]))
        self.limit, self.step = int(options.get("limit_tokens", 0)), int(options.get("slice_tokens", 4_000_000))

    def partitions(self) -> list[Slice]:
        if not self.paths:
            raise ValueError("no token shards found")
        out, left = [], self.limit or None
        for p in self.paths:
            n = os.path.getsize(p) // 2
            n = n if left is None else min(n, left)
            out += [Slice(p, a, min(n, a + self.step)) for a in range(0, n, self.step)]
            left = None if left is None else left - n
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        path, start, stop = partition.value
        ids = np.memmap(path, "<u2", "r")[start:stop]
        for a in range(0, len(ids), 100_000):
            part = ids[a : a + 100_000].astype(np.int32)
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)] * n), pa.array(np.arange(start + a, start + a + n)), pa.array(part)], names=["shard", "offset", "token"])


class WindowReader(DataSourceReader):
    """Draws starts over the shards by their sizes and reads only the windows' own tokens.

    A shard weighs as many starts as it has for a whole window and the token after it, on its side of the split;
    a uniform draw over all of them is found among the shards' cumulative weights, so no window crosses a shard's
    end or the split.  The draws come in blocks from a counter, so a worker's share needs no other's.
    """

    def __init__(self, options: dict[str, str]):
        self.paths = ShardReader({"path": options["path"]}).paths
        if not self.paths:
            raise ValueError("no token shards found")
        self.size, self.draws, self.seed = int(options["window"]), int(options["draws"]), int(options.get("seed", 0))
        self.side, self.fraction, self.step = options.get("side", "train"), float(options.get("fraction", 0.1)), int(options.get("draws_a_partition", 10_000))
        if self.size < 1 or self.side not in ("train", "val") or not 0 <= self.fraction < 1:
            raise ValueError("a window has a token at least, the side is train or val, the fraction below 1")

    def spans(self) -> list[tuple[int, int]]:
        """The first start on the side, and how many there are, of each shard."""
        out = []
        for p in self.paths:
            n = os.path.getsize(p) // 2
            cut = int(n * (1 - self.fraction))
            first, end = (0, cut) if self.side == "train" else (cut, n)
            out.append((first, max(0, end - first - self.size)))
        return out

    def partitions(self) -> list[InputPartition]:
        if not sum(n for _, n in self.spans()):
            raise ValueError(f"no shard has room for a window of {self.size} tokens on the {self.side} side")
        return [InputPartition((a, min(self.draws, a + self.step))) for a in range(0, self.draws, self.step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        spans = self.spans()
        ends = np.cumsum([n for _, n in spans])
        draw = np.random.Generator(np.random.Philox(key=self.seed, counter=[0, 0, 0, first])).integers(0, ends[-1], last - first)
        shard = np.searchsorted(ends, draw, "right")
        start = np.array([a for a, _ in spans])[shard] + draw - (ends - [n for _, n in spans])[shard]
        order = np.lexsort((start, shard))
        for k in range(0, len(order), 1_000):
            rows = order[k : k + 1_000]
            tokens = np.stack([np.memmap(self.paths[shard[i]], "<u2", "r", 2 * int(start[i]), (self.size + 1,)) for i in rows]).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(tokens.reshape(-1)), self.size + 1).cast(pa.list_(pa.int32()))
            names = pa.array([os.path.basename(self.paths[i]) for i in shard[rows]])
            yield pa.RecordBatch.from_arrays([pa.array(first + rows), names, pa.array(start[rows]), lists], names=["draw", "shard", "offset", "tokens"])


class TokenWindows(DataSource):
    """``spark.read.format("token_windows").options(window=n, draws=k, side="train", fraction=f, seed=s).load(folder or glob)``."""

    @classmethod
    def name(cls) -> str:
        return "token_windows"

    def schema(self) -> str:
        return "draw long, shard string, offset long, tokens array<int>"

    def reader(self, schema) -> WindowReader:
        return WindowReader(self.options)


def read_windows(spark: SparkSession, path: str, window: int, draws: int, **options: object) -> DataFrame:
    """Random windows of window tokens and the one after, shards weighed by their size; inputs and targets of a training row."""
    spark.dataSource.register(TokenWindows)
    found = spark.read.format("token_windows").options(window=window, draws=draws, **options).load(path)
    return found.select("draw", "shard", "offset", F.slice("tokens", 1, window).alias("inputs"), F.slice("tokens", 2, window).alias("targets"))


class TokenShards(DataSource):
    """``spark.read.format("token_shards").option("limit_tokens", n).load(folder or glob)``; one partition a slice."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)


def read_shards(spark: SparkSession, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").options(**options).load(path)


def one_sequence(tokens: DataFrame) -> DataFrame:
    """Adds position: the place in all shards, one after another by name."""
    sizes = tokens.groupBy("shard").agg(F.count("*").alias("n"))
    rows, at = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r["shard"]):  # one row a shard file
        rows.append((r["shard"], at))
        at += r["n"]
    base = tokens.sparkSession.createDataFrame(rows, "shard string, base long")
    return tokens.join(F.broadcast(base), "shard").withColumn("position", F.col("base") + F.col("offset")).drop("base")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and sha256 of every shard file."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
