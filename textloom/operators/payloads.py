"""JSON payloads of any shape as variants: leaves level by level, typed values, claims withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ledger import declared
from textloom.sources.scratch import Scratch

GATE_FIELDS = ("holdout_eligible", "ineligible_reason", "claims_withheld")


def leaves(df: DataFrame, column: str) -> DataFrame:
    """df without the JSON column, a row for each leaf, with its dotted path and its value as JSON.

    Lists and empty objects are leaves, and so is a payload that is no object, with an empty path; null payloads and
    malformed ones have none.  Each level of nesting is one explode of the objects that are left, so there are as
    many rounds as levels, and only objects go on to the next.  Columns named path or value may not clash.
    """
    spark, others = df.sparkSession, [c for c in df.columns if c != column]
    scratch, k = Scratch(spark, "leaves"), 0
    now = df.select(F.struct(*others).alias("_row") if others else F.lit(1).alias("_row"), F.try_parse_json(column).alias("_v"), F.lit(None).cast("string").alias("_path")).filter("_v is not null")
    found = None
    while True:
        kind = F.schema_of_variant("_v")
        level = scratch.keep(now.withColumn("_object", kind.startswith("OBJECT<") & (kind != "OBJECT<>")), f"level{k}")
        here = level.filter("not _object").select(*[F.col("_row")[c].alias(c) for c in others], F.coalesce("_path", F.lit("")).alias("path"), F.to_json("_v").alias("value"))
        found = here if found is None else found.unionByName(here)
        objects = level.filter("_object")
        if objects.isEmpty():
            return found
        inside = objects.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        now = inside.select("_row", F.col("value").alias("_v"), F.concat_ws(".", "_path", "key").alias("_path"))
        k += 1


def _points(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))


def typed(value: Column, kind: Column) -> Column:
    """(value, error) of a variant as a value of kind int, bool or seq, written as JSON.

    A bool is no int and a number with a point is none; a string is the seq of its code points, in a list too;
    anything else of the kind asked is an error that names what was there.
    """
    is_ = F.schema_of_variant(value)
    wide = F.regexp_extract(is_, "^DECIMAL\\((\\d+),0\\)$", 1)  # integers beyond 64 bits; narrower ones were written with a point
    whole = (is_ == "BIGINT") | ((wide != "") & (F.try_to_number(wide, F.lit("99")) >= 19))
    text = F.try_variant_get(value, "$", "string")
    items = F.try_variant_get(value, "$", "array<variant>")
    one = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.to_json(_points(F.try_variant_get(v, "$", "string")))).otherwise(F.to_json(v))
    row = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY<"), F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), ","), F.lit("]"))).otherwise(one(v))
    seq = F.when(is_ == "STRING", F.to_json(_points(text))).when(is_.startswith("ARRAY<"), F.concat(F.lit("["), F.array_join(F.transform(items, row), ","), F.lit("]")))
    good = F.when(kind == "int", F.when(whole, F.to_json(value))).when(kind == "bool", F.when(is_ == "BOOLEAN", F.to_json(value))).when(kind == "seq", seq)
    known = kind.isin("int", "bool", "seq")
    error = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("no argument can be a "), F.coalesce(kind, F.lit("null")))).when(good.isNull(), F.concat(F.lit("expected a "), kind, F.lit(", got "), F.coalesce(F.to_json(value), F.lit("nothing"))))
    return F.struct(good.alias("value"), error.alias("error"))


def withhold(df: DataFrame, key: str, column: str, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """((key, path, value): the payloads' leaves, claims null where the holdout is not eligible; (key, gate fields)).

    ``df`` has a unique key, the JSON column, and ``reason`` against its holdout, null if there is none.  Leaves that
    no pattern declares to be measurements are claims; what a payload says itself in a gate field is dropped.
    """
    found = leaves(df.select(key, "reason", column), column)
    own = F.split("path", "\\.").getItem(0).isin(*GATE_FIELDS)
    marked = found.filter(~own & (F.col("path") != "")).withColumn("claim", ~declared(F.col("path"), patterns))
    shown = marked.select(key, "path", F.when(F.col("reason").isNull() | ~F.col("claim"), F.col("value")).alias("value"))
    claims = marked.filter("claim and reason is not null").groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("claims_withheld"))
    empty = F.array().cast("array<string>")
    gate = df.select(key, "reason").join(claims, key, "left").select(key, F.col("reason").isNull().alias("holdout_eligible"), F.col("reason").alias("ineligible_reason"), F.coalesce("claims_withheld", empty).alias("claims_withheld"))
    return shown, gate
