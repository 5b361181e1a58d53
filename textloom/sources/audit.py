"""Audit of a published corpus: a tokenizer of its training side, tokens of both, and windows to read."""

from __future__ import annotations

import hashlib
import json
import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import bpefit
from textloom.operators.splits import running
from textloom.sources.corpus import SPLITS, publish, read_file, read_report
from textloom.sources.scratch import Scratch


def encoded(texts: DataFrame, payload: dict) -> DataFrame:
    """(split, path, ids) of (split, path, text) by a fitted tokenizer."""
    backend = json.dumps(payload["backend"])

    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(backend)
        for batch in batches:
            ids = [e.ids for e in tok.encode_batch(batch.column(2).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["split", "path", "ids"])

    return texts.select("split", "path", "text").mapInArrow(run, "split string, path string, ids array<int>")


def window_starts(tokens: int, context: int, seed: int, windows: int) -> list[int]:
    """A start drawn in each of equal stretches of the token sequence."""
    draw = random.Random(seed)
    return [draw.randint(i * (tokens - context) // windows, (i + 1) * (tokens - context) // windows) for i in range(windows)]


def fingerprint(payload: dict) -> str:
    """sha256 of a tokenizer's rules as canonical JSON, without how it was made."""
    rules = {k: payload[k] for k in ("kind", "backend", "sentinels")}
    return hashlib.sha256(json.dumps(rules, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def sides(texts: DataFrame) -> dict[str, dict]:
    """By split: documents, characters, bytes, and a seal of all paths and texts, whatever files and order they are in."""
    sums = texts.groupBy("split").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sha2(F.concat_ws(",", *[F.bit_xor(F.xxhash64("path", "text", F.lit(k))).cast("string") for k in range(4)]), 256).alias("seal"))
    return {r.split: r.asDict() for r in sums.collect()}  # two rows


def audit(spark: SparkSession, corpus: str, out: str, vocab_size: int = 8192, context: int = 1024, seed: int = 1337, windows: int = 10) -> dict:
    """Writes tokenizer.json, audit.json and windows.jsonl together, and returns the audit.

    Refused are a corpus whose files don't hold what its report says, a text that its tokenizer doesn't keep, a side
    of no more tokens than the context, and an existing output.  Windows are of the training side, its documents in
    order of their paths, end to end.
    """
    if context < 1:
        raise ValueError("context must be positive")
    report = read_report(corpus)
    texts = spark.read.parquet(f"{corpus}/corpus")
    found = sides(texts)
    for split in SPLITS:
        if any(found.get(split, {}).get(k) != report["splits"][split][k] for k in ("files", "chars", "bytes")):
            raise ValueError(f"the {split} side is not what its report says")
    scratch = Scratch(spark, "audit")
    payload = bpefit.fit_tokenizer(texts.filter("split = 'train'"), scratch, vocab_size)
    backend = json.dumps(payload["backend"])
    if bpefit.lost(texts.filter("split <> 'train'"), backend):
        raise ValueError("the tokenizer changes a validation text")
    ids = scratch.keep(encoded(texts, payload), "ids")
    tokens = {r.split: r.n for r in ids.groupBy("split").agg(F.sum(F.size("ids")).alias("n")).collect()}
    for split in SPLITS:
        if tokens[split] <= context:
            raise ValueError(f"the {split} side has too few tokens for the context")
    placed = running(ids.filter("split = 'train'").select("path", "ids"), F.size("ids"), "path")
    starts = window_starts(tokens["train"], context, seed, windows)
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(starts)), "place int, start long"))  # a row a window
    inside = (F.col("before") < F.col("start") + context) & (F.col("before") + F.size("ids") > F.col("start"))
    skip = F.greatest(F.col("start") - F.col("before"), F.lit(0)).cast("int")
    piece = F.slice("ids", skip + 1, F.least(F.size("ids") - skip, F.col("start") + context - F.greatest("before", "start")).cast("int"))
    cut = placed.join(wanted, inside).groupBy("place", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", piece.alias("ids")))), lambda x: x["ids"])).alias("ids"))  # context ids a window
    shown = [{"index": r.place, "start_token": r.start, "tokens": len(r.ids), "text": bpefit.decode(payload, r.ids)} for r in cut.orderBy("place").collect()]
    stats = {s: {**{k: found[s][k] for k in ("files", "chars", "bytes", "seal")}, "tokens": tokens[s], "tokens_per_byte": tokens[s] / found[s]["bytes"], "roundtrip": True} for s in SPLITS}
    told = {"splits": stats, "records": report["records"], "excluded": report["excluded"], "vocab_size": 256 + payload["training"]["merges"], "requested_vocab_size": vocab_size, "tokenizer_sha256": fingerprint(payload), "context": context, "window_seed": seed, "training_windows": len(shown), "cross_split_overlap": 0}
    lines = "".join(json.dumps(w, ensure_ascii=False) + "\n" for w in shown)
    publish(out, {"tokenizer.json": json.dumps(payload, ensure_ascii=False, sort_keys=True), "audit.json": json.dumps(told, indent=2, sort_keys=True) + "\n", "windows.jsonl": lines})
    return told


def accept(folder: str, windows: list[int], accepted: bool = True) -> None:
    """Records beside an audit which of its windows a person read, and whether they will do; an earlier record is refused."""
    told = {"status": "passed" if accepted else "rejected", "inspected_windows": windows, "audit_sha256": _digest(f"{folder}/audit.json"), "tokenizer_sha256": _digest(f"{folder}/tokenizer.json")}
    publish(f"{folder}/inspection", {"inspection.json": json.dumps(told, sort_keys=True)})


def _digest(path: str) -> str:
    return hashlib.sha256(read_file(path)).hexdigest()


def validated(spark: SparkSession, corpus: str, folder: str, context: int, vocab_size: int, least: int = 10) -> dict:
    """What a study may be fed: digests of the audit, its inspection, tokenizer and corpus; the first fault is an error.

    The inspection must have passed and be of this very audit and tokenizer, with ``least`` distinct windows of it read;
    the audit must be of this context and vocabulary, and both sides of the corpus as they were, kept whole by the
    tokenizer and longer than the context.
    """
    told, seen = (json.loads(read_file(f"{folder}/{name}")) for name in ("audit.json", "inspection/inspection.json"))
    read = seen.get("inspected_windows")
    whole = isinstance(read, list) and all(type(i) is int and 0 <= i < told["training_windows"] for i in read)
    tokenizer = json.loads(read_file(f"{folder}/tokenizer.json"))
    backend = fingerprint(tokenizer)
    found = sides(spark.read.parquet(f"{corpus}/corpus"))
    rules = [
        (seen.get("status") == "passed", "the inspection did not pass"),
        (seen.get("audit_sha256") == _digest(f"{folder}/audit.json"), "the inspection is of another audit"),
        (seen.get("tokenizer_sha256") == _digest(f"{folder}/tokenizer.json"), "the inspection is of another tokenizer"),
        (whole, "the inspected windows are not the audit's"),
        (whole and len(set(read)) >= least, f"fewer than {least} windows were inspected"),
        (told.get("tokenizer_sha256") == backend, "the tokenizer is not the audited one"),
        (told.get("context") == context and told.get("requested_vocab_size") == vocab_size, "context or vocabulary differ from the study's"),
        (told.get("cross_split_overlap") == 0, "the sides overlap"),
        *((found.get(s, {}).get("seal") == told["splits"][s]["seal"], f"the {s} side changed after the audit") for s in SPLITS),
        *((told["splits"][s]["roundtrip"] is True and told["splits"][s]["tokens"] > context, f"the {s} side is not kept whole or too short") for s in SPLITS),
    ]
    for good, why in rules:
        if not good:
            raise ValueError(why)
    return {"audit_sha256": _digest(f"{folder}/audit.json"), "inspection_sha256": _digest(f"{folder}/inspection/inspection.json"), "tokenizer_sha256": backend, **{f"{s}_seal": found[s]["seal"] for s in SPLITS}}
