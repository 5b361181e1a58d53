"""Table functions for SQL: a table goes in with the name of its text column, its own columns come out beside new ones.

``register(spark)`` makes them callable:
``select * from segments(table(docs) partition by (source), 'text')``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

MARKER = "\n\n# file: "
EXAMPLE = re.compile(r"^Example: ([a-z_]+)\((.*)\) == (.*)$", re.M)


def _schema(rows: AnalyzeArgument, text: AnalyzeArgument, made: list[StructField]) -> AnalyzeResult:
    """The table's columns and those made; the arguments are checked when a query is analysed, before anything runs."""
    if not rows.isTable or not isinstance(rows.dataType, StructType):
        raise ValueError("the first argument is a table: table(name)")
    if not text.isConstantExpression or text.value not in rows.dataType.names:
        raise ValueError(f"the second argument names a column of the table: {', '.join(rows.dataType.names)}")
    clash = {f.name for f in made} & set(rows.dataType.names)
    if clash:
        raise ValueError(f"the table has a column {sorted(clash)[0]} already")
    return AnalyzeResult(StructType([*rows.dataType.fields, *made]))


class Segments:
    """A row for each document of a joined text: at ``# file:`` markers if it has one, else at blank lines; blank ones go."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        return _schema(rows, text, [StructField("segment", IntegerType()), StructField("doc", StringType())])

    def eval(self, rows: Row, text: str) -> Iterator[tuple]:
        whole = rows[text]
        if whole is None:
            return
        first, *others = whole.split(MARKER)
        parts = [first, *("# file: " + x for x in others)] if others else whole.split("\n\n")
        for k, doc in enumerate(parts):
            if doc.strip():
                yield (*rows, k, doc)


class Examples:
    """A row for each line ``Example: name(args) == result``, its arguments as a JSON list; ``error`` says what can't be read."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        return _schema(rows, text, [StructField("line", IntegerType()), *(StructField(n, StringType()) for n in ("fn", "args", "expected", "error"))])

    def eval(self, rows: Row, text: str) -> Iterator[tuple]:
        for k, found in enumerate(EXAMPLE.finditer(rows[text] or "")):
            fn, args, expected = found.groups()
            try:
                json.loads(f"[{args}]")
                json.loads(expected)
                error = None
            except ValueError:
                error = "not JSON"
            yield (*rows, k, fn, args, expected, error)


def register(spark: SparkSession) -> None:
    """Makes segments and examples callable from SQL."""
    spark.udtf.register("segments", udtf(Segments))
    spark.udtf.register("examples", udtf(Examples))
