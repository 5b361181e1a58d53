"""A corpus sink with a commit protocol: tasks stage files, the commit checks what they say and publishes by one rename."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SPLITS = ("train", "validation")
#: What must not be on both sides.
APART = ("group", "sha256", "normalized_sha256")
NEEDED = ("path", "text", "split", "included", "reason", *APART)


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _exists(system: pafs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != pafs.FileType.NotFound


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: names under the staging folder, and sums of its rows."""

    files: list[str] = field(default_factory=list)
    splits: dict[str, dict[str, int]] = field(default_factory=dict)
    excluded: dict[str, int] = field(default_factory=dict)
    overlaps: dict[str, int] = field(default_factory=dict)
    records: int = 0


class CorpusWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own name; only those that a commit message names are published.

    The staging folder is hidden from readers; a task that outlives its aborted job can leave one behind.
    """

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"].rstrip("/"), columns
        missing = [c for c in (*NEEDED, "overlap") if c not in columns]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        system, path = _at(self.path)
        if _exists(system, path):
            raise ValueError("output already exists")
        self.expected = int(options["records"]) if "records" in options else None
        folder, name = posixpath.split(path)
        self.stage = posixpath.join(folder, f".{name}.building-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, _ = _at(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        told, open_files = Staged(), {}

        def put(folder: str, table: pa.Table) -> None:
            if folder not in open_files:
                system.create_dir(posixpath.join(self.stage, folder), recursive=True)
                told.files.append(f"{folder}/{name}")
                open_files[folder] = pq.ParquetWriter(posixpath.join(self.stage, folder, name), table.schema, filesystem=system, compression="zstd")
            open_files[folder].write_table(table)

        try:
            for batch in iterator:
                rows = pa.Table.from_batches([batch])
                told.records += rows.num_rows
                put("provenance", rows.drop_columns(["text", "overlap"]))
                inside = rows.filter(pc.fill_null(rows["included"], False))
                for split in pc.unique(inside["split"]).to_pylist():
                    side = inside.filter(pc.equal(inside["split"], split))
                    put(f"corpus/split={split}", side.select(["path", "text"]))
                    sums = told.splits.setdefault(split, {"files": 0, "chars": 0, "bytes": 0})
                    sums["files"] += side.num_rows
                    sums["chars"] += pc.sum(pc.utf8_length(side["text"])).as_py() or 0
                    sums["bytes"] += pc.sum(pc.binary_length(side["text"])).as_py() or 0
                told.overlaps = dict(Counter(told.overlaps) + Counter(x for x in inside["overlap"].to_pylist() if x))
                told.excluded = dict(Counter(told.excluded) + Counter(x for x in rows.filter(pc.invert(pc.fill_null(rows["included"], False)))["reason"].to_pylist()))
        finally:
            for f in open_files.values():
                f.close()
        return told

    def commit(self, messages: list[Staged | None]) -> None:
        system, path = _at(self.path)
        told = [m for m in messages if m is not None]
        overlaps = sum((Counter(m.overlaps) for m in told), Counter())
        if overlaps:
            raise ValueError("on both sides: " + ", ".join(f"{k} of {n} texts" for k, n in sorted(overlaps.items())))
        records = sum(m.records for m in told)
        if self.expected is not None and records != self.expected:
            raise ValueError(f"{records} records were written, not {self.expected}")
        splits = {s: dict(sum((Counter(m.splits.get(s, {})) for m in told), Counter())) for s in sorted({s for m in told for s in m.splits})}
        if any(not splits.get(s, {}).get("files") for s in SPLITS):
            raise ValueError("a side is empty")
        named = {posixpath.join(self.stage, f) for m in told for f in m.files}
        for info in system.get_file_info(pafs.FileSelector(self.stage, recursive=True)):
            if info.type == pafs.FileType.File and info.path not in named:
                system.delete_file(info.path)  # of an attempt that another one replaced
        excluded = sum((Counter(m.excluded) for m in told), Counter())
        quality = {"splits": splits, "excluded": {str(k): n for k, n in sorted(excluded.items(), key=str)}, "records": records, "cross_split_overlap": 0}
        for name, text in (("quality.json", json.dumps(quality, indent=2, sort_keys=True) + "\n"), ("card.md", card(quality, posixpath.basename(path)))):
            with system.open_output_stream(posixpath.join(self.stage, name)) as f:
                f.write(text.encode())
        if _exists(system, path):
            raise ValueError("output already exists")
        system.move(self.stage, path)

    def abort(self, messages: list[Staged | None]) -> None:
        system, _ = _at(self.path)
        if _exists(system, self.stage):
            system.delete_dir(self.stage)


class SplitCorpus(DataSource):
    """``df.write.format("split_corpus").mode("append").save(path)``; an existing output is refused."""

    @classmethod
    def name(cls) -> str:
        return "split_corpus"

    def writer(self, schema, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(self.options, schema.names)


def card(quality: dict, title: str) -> str:
    """A short dataset card, as markdown."""
    sides = "".join(f"| {k} | {v['files']} | {v['chars']} |\n" for k, v in sorted(quality["splits"].items()))
    left = "".join(f"| {k} | {n} |\n" for k, n in sorted(quality["excluded"].items()))
    return f"# {title}\n\n{quality['records']} records were looked at.\n\n| Split | Documents | Characters |\n|-|-|-|\n{sides}\n| Left out for | Records |\n|-|-|\n{left}"


def overlapping(records: DataFrame) -> DataFrame:
    """records with ``overlap``: the first of APART whose value an included record shares with the other side, else null."""
    inside, out = records.filter("included"), records.withColumn("overlap", F.lit(None).cast("string"))
    for key in APART:
        shared = inside.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(key, F.lit(key).alias("_shared"))
        out = out.join(shared, key, "left").withColumn("overlap", F.coalesce("overlap", F.when(F.col("included"), F.col("_shared")))).drop("_shared")
    return out


def write_corpus(records: DataFrame, path: str) -> dict:
    """Publishes the included records' texts by split with the provenance of all, and returns the quality report.

    ``records`` has the columns NEEDED and any others.  Everything appears at once or, if a side is empty, a text, its
    normalized form or its group is on both sides, or the output exists, nothing does.
    """
    records.sparkSession.dataSource.register(SplitCorpus)
    first = [c for c in NEEDED if c in records.columns]
    overlapping(records).select(*first, *[c for c in records.columns if c not in first], "overlap").write.format("split_corpus").mode("append").save(path)
    return read_report(path)


def read_file(path: str) -> bytes:
    """A small file, whole."""
    system, at = _at(path)
    with system.open_input_stream(at) as f:
        return f.read()


def read_report(path: str) -> dict:
    return json.loads(read_file(f"{path.rstrip('/')}/quality.json"))


def publish(path: str, files: dict[str, str]) -> None:
    """Small text files that appear together as a folder; an existing one is refused."""
    system, at = _at(path)
    if _exists(system, at):
        raise ValueError("output already exists")
    folder, name = posixpath.split(at.rstrip("/"))
    stage = posixpath.join(folder, f".{name}.building-{uuid.uuid4().hex}")
    system.create_dir(stage, recursive=True)
    for file, text in files.items():
        with system.open_output_stream(posixpath.join(stage, file)) as f:
            f.write(text.encode())
    system.move(stage, at.rstrip("/"))
