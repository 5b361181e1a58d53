"""Why a file is left out, which family it belongs to, and whose licence covers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

# Directory names, patterns.
EXCLUDED_DIRS = ("vendor", "vendored", "third_party", "third-party", "external", "fixtures", "fixture", "testdata", "test_data", "__pycache__", "node_modules", "target", "_build", "build", ".lake")
BENCHMARK = "(?i)(^|[^A-Za-z0-9])(human[_-]?eval|mbpp|code[_-]?contests|apps)([^A-Za-z0-9]|$)"
GENERATED = (
    "(?im)^[ \\t]*(//|#|/\\*|\\*|--|\\.\\.)?[ \\t]*([rubf]{0,2}(\"{3}|'{3})[ \\t]*)?"
    "(@generated\\b|this (file|code) (is|was) (automatically )?generated\\b|automatically generated\\b|generated by\\b|do not edit\\b|"
    "Python Character Mapping Codec [^\\r\\n]*\\bgenerated from\\b)"
)


def with_paths(docs: DataFrame) -> DataFrame:
    """Adds a made-up repository path to each document, as the tables have none."""
    i = F.col("doc_id")
    middle = F.when(i % 7 == 0, "tests").when(i % 11 == 0, "vendor").otherwise("lib")
    prefix = F.when(i % 13 == 0, "mbpp_").when(i % 5 == 0, "test_").otherwise("")
    return docs.withColumn("path", F.concat("source", F.lit("/"), "lang", F.lit("/"), middle, F.lit("/"), prefix, F.lit("mod"), (i % 50).cast("string"), F.lit(".md")))


def path_exclusion(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    banned = F.arrays_overlap(parts, F.array(*(F.lit(x) for x in EXCLUDED_DIRS)))
    test_data = F.array_contains(parts, "data") & F.lower(path).rlike("(^|/)(tests?(/|$)|test_)")
    return F.when(banned, "vendored-generated-or-fixture-directory").when(test_data, "test-fixture-data").when(path.rlike(BENCHMARK), "benchmark-name-in-path")


def inspect(df: DataFrame) -> DataFrame:
    """Adds reason (null for an included row) and included; the rules are tried in order, cheap ones first."""
    t = F.col("text")
    head = F.array_join(F.slice(T.lines(t), 1, 80), "\n")
    reason = (
        F.when(path_exclusion(F.col("path")).isNotNull(), path_exclusion(F.col("path")))
        .when(t.contains("\0"), "binary-nul")
        .when(T.strip(t) == "", "empty")
        .when(t.rlike(BENCHMARK), "benchmark-name-in-content")
        .when(head.rlike(GENERATED), "generated-header")
    )
    return df.withColumn("reason", reason).withColumn("included", F.col("reason").isNull())


def family(path: Column) -> Column:
    """Source and module stem: the name without its suffix and test prefix, so that a module and its tests share a side."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, "\\.[^.]*$", ""), "^(mbpp_|test_)", "")
    return F.concat(F.element_at(F.split(path, "/"), 1), F.lit(":"), stem)


def kind(path: Column) -> Column:
    return F.when(F.array_contains(F.split(path, "/"), "tests"), "test").otherwise("documentation")


def ancestor_licenses(df: DataFrame, licenses: DataFrame) -> DataFrame:
    """Licences whose directory is an ancestor of the path, joined by equality on the exploded ancestors."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    joined = df.select("doc_id", F.explode(dirs).alias("dir")).join(licenses, "dir")
    return joined.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dir", "license"))), lambda x: x["license"]), ",").alias("licenses"))
