"""Corpus, log and conversation sinks, and the scan of a folder into a corpus with a reason for each file."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dedup, ledger
from textloom.sources import files

# Directories and suffixes that a folder scan passes over, containers that are opened in spite of theirs.
SKIP_DIRS = (".git", "__pycache__", ".venv", "node_modules", ".idea", ".vscode")
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tif", ".tiff", ".mp3", ".mp4", ".wav",
    ".avi", ".mov", ".mkv", ".flac", ".ogg", ".zip", ".gz", ".tar", ".7z", ".rar", ".bz2", ".xz",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".obj", ".class", ".pt", ".pth", ".ckpt", ".safetensors",
    ".onnx", ".npy", ".npz", ".pdf", ".docx", ".xlsx", ".pptx", ".sqlite", ".db", ".parquet",
)
HANDLED = (".docx", ".epub", ".html", ".htm", ".xhtml")
PROBE = 8192


def suffix(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, "(?<=.)(\\.[^.]*)$", 1))


def looks_like_text(content: Column) -> Column:
    """The cheap test of a file's first bytes: no NUL, and valid UTF-8 once a character cut by the end is dropped."""
    head = F.substring(content, 1, PROBE)
    cut = [F.when(F.length(head) > k, F.substring(head, F.lit(1), F.length(head) - k)) for k in range(4)]
    valid = lambda b: F.coalesce(F.is_valid_utf8(b.cast("string")), F.lit(False))
    whole = valid(cut[0])
    for c in cut[1:]:
        whole = whole | ((F.length(content) > PROBE) & valid(c))
    return (F.length(content) > 0) & (F.instr(F.regexp_replace(F.hex(head), "(..)", "$1,"), "00,") == 0) & whole


def reasons(found: DataFrame, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """Adds reason to (path, content) rows: the first that holds against a file, or 'text'."""
    plain = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    at = F.instr("path", F.lit(plain))
    inner = F.when(at > 0, F.substring("path", at + len(plain), F.length("path"))).otherwise(F.col("path"))
    skipped = F.arrays_overlap(F.split(inner, "/"), F.array(*(F.lit(x) for x in SKIP_DIRS)))
    kind = suffix(F.col("path"))
    wanted = F.lit(True) if suffixes is None else kind.isin(suffixes)
    binary = kind.isin(*BINARY) & ~kind.isin(*HANDLED)
    reason = F.when(skipped, "in an ignored directory").when(~wanted, F.concat(F.lit("filtered out by suffix ("), F.when(kind == "", "none").otherwise(kind), F.lit(")")))
    reason = reason.when(binary, F.concat(F.lit("binary file type ("), kind, F.lit(")"))).when(~kind.isin(*HANDLED) & ~looks_like_text(F.col("content")), "content is not text").otherwise("text")
    return found.withColumn("inner", inner).withColumn("reason", reason)


def folder_corpus(spark: SparkSession, root: str, suffixes: list[str] | None = None, min_chars: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, tally): the files of a folder that become (path, text), and how many got which reason, most first.

    Files are read properly or not at all; of equal texts the first by path stays.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    judged = reasons(found, root, suffixes)
    read = files.read_binary(judged.filter("reason = 'text'").select("path", "content")).join(judged.select("path", "inner"), "path")
    kept = F.when(F.col("text").isNull(), F.col("word")).when((F.length("text") < min_chars) | (T.strip(F.col("text")) == ""), "too short")
    told = read.withColumn("reason", kept)
    good = told.filter("reason is null").select(F.col("inner").alias("path"), "text")
    first = dedup.keep_first(good.withColumn("doc", F.col("path")), F.sha2("text", 256), "doc").select(F.col("doc").alias("path"))
    documents = good.join(first, "path", "left_semi")
    copies = good.join(first, "path", "left_anti").select(F.lit("copy of another file").alias("reason"))
    tally = judged.filter("reason <> 'text'").select("reason").unionByName(told.filter("reason is not null").select("reason")).unionByName(copies)
    return documents, tally.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def user_files(judged: DataFrame) -> DataFrame:
    """Files that a person put there: those that are text, but for the folder's own readme."""
    return judged.filter((F.col("reason") == "text") & (F.lower(F.element_at(F.split("path", "/"), -1)) != "readme.txt"))


def write_corpus(documents: DataFrame, path: str) -> None:
    """Joined text with a marker line before each document, in path order: one file a partition, named in order."""
    ordered = documents.orderBy("path").select(F.concat(F.lit("# file: "), "path", F.lit("\n"), "text").alias("value"))
    ordered.write.mode("errorifexists").option("lineSep", "\n\n").text(path)


def replace_json(spark: SparkSession, path: str, value) -> None:
    """Writes a small JSON file beside its place and renames it over the old one, on any file system that Spark knows: a reader finds one or the other."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    to, own = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(own)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(own, to, options)


def append_record(spark: SparkSession, path: str, row: dict) -> bool:
    """Appends a run record as a JSON line in a file of its own; a failure is told, never raised, so that no run dies of its log."""
    try:
        spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
        return True
    except (Py4JJavaError, PySparkException):  # the store's failure; a log must not end a run
        return False


def rewrite_metrics(log: DataFrame, completed: int, initial: DataFrame, path: str) -> None:
    """The log of a resumed run: step 0 anew and the rows of committed steps, in a new folder."""
    log.filter((F.col("step") > 0) & (F.col("step") <= completed)).unionByName(initial).write.mode("errorifexists").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str, completed: int) -> tuple[DataFrame, int]:
    """(committed rows, uncommitted count) of a log in which a bad line or a step that doesn't rise is an error.

    Lines are in order of their files' times and names, then of their place in the file.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    line = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    late = ledger.increasing(rows.select("*", line.alias("line_no")), "run", "step").select("run").distinct().count()
    if late:
        raise ValueError(f"{late} runs have a step that does not rise")
    return rows.filter(F.col("step") <= completed), rows.filter(F.col("step") > completed).count()


def write_conversations(built: DataFrame, path: str) -> dict:
    """Conversations as JSON lines, the skipped documents with their reasons, and a summary."""
    built.filter("why is null").select("doc_id", "turns").write.mode("errorifexists").json(f"{path}/conversations")
    built.filter("why is not null").select("doc_id", "why").write.mode("errorifexists").json(f"{path}/skipped")
    summary = {r["why"] or "kept": r["n"] for r in built.groupBy("why").agg(F.count("*").alias("n")).collect()}
    replace_json(built.sparkSession, f"{path}/summary.json", summary)
    return summary


def markdown(report: DataFrame, title: str, notes: tuple[str, ...] = (), limit: int = 1000) -> str:
    """A summary's rows, in their order, as a markdown table; numbers to the right, missing values as dashes.

    A report is for reading: one of more than ``limit`` rows is an error, not cut.
    """
    rows = report.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cell = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    rule = ["-:" if k in ("double", "float", "int", "bigint", "smallint", "tinyint") or k.startswith("decimal") else "-" for _, k in report.dtypes]
    lines = [f"# {title}", "", f"| {' | '.join(report.columns)} |", f"|{'|'.join(rule)}|", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]
    return "\n".join([*lines, "", *(f"- {n}" for n in notes), ""])


def write_candidates(generated: DataFrame, path: str, stop: str = "\n}\n") -> None:
    """Completions as JSON lines: (task_name, split, raw) with the text through its first stop, and whether it has one."""
    raw = F.col("raw")
    closed = F.instr(raw, F.lit(stop)) > 0
    generated.select("task_name", "split", T.truncate_after(raw, stop).alias("completion"), "raw", closed.alias("stopped")).write.mode("errorifexists").json(path)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """(newest): the latest change of a file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("modificationTime").alias("newest"))
