"""Table functions from SQL."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import tables
from textloom.operators import splits

TEXTS = [None, "", " \n\n\t", "a\n\nb\n\n \n\nc", "head\n\n# file: x\nbody\n\nmore\n\n# file: y\n", "# file: z\none\n\ntwo", "é\x1c\n\n\x1c\n\nq"]


@pytest.fixture
def docs(spark):
    tables.register(spark)
    df = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    df.createOrReplaceTempView("joined")
    return df


def test_segments_equal_the_column_form(spark, docs):
    want = sorted(map(str, splits.segments(docs).select("doc_id", "text", "source", "segment", "doc").collect()))
    for how in ("table(joined)", "table(joined) partition by (source)", "table(joined) partition by (source) order by (doc_id)"):
        got = spark.sql(f"select * from segments({how}, 'text')")
        assert got.columns == ["doc_id", "text", "source", "segment", "doc"] and sorted(map(str, got.collect())) == want


def test_examples(spark):
    tables.register(spark)
    text = 'Example: f(1, [2]) == 3\nExample: g_h("x)") == true\nno\nExample: f(nope) == 1\nExample: f() == (\n Example: f() == 1'
    spark.createDataFrame([(1, text), (2, None)], "id long, body string").createOrReplaceTempView("told")
    got = [tuple(r)[2:] for r in spark.sql("select * from examples(table(told), 'body') order by line").collect()]
    assert got == [(0, "f", "1, [2]", "3", None), (1, "g_h", '"x)"', "true", None), (2, "f", "nope", "1", "not JSON"), (3, "f", "", "(", "not JSON")]


@pytest.mark.parametrize("call,why", [("segments(table(joined), 'none')", "names a column"), ("segments('x', 'text')", "is a table"), ("segments(table(select text, 1 as doc from joined), 'text')", "column doc already")])
def test_wrong_calls_fail_when_analysed(spark, docs, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"select * from {call}")
