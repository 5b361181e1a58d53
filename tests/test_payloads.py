"""Leaves, typed values and withheld claims of JSON payloads against a walk of the parsed object."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import payloads

r = np.random.default_rng(21)


def thing(depth):
    k = int(r.integers(0, 8 if depth else 6))
    if k > 5:
        return {str(x): thing(depth - 1) for x in r.choice(list("abcdefg"), int(r.integers(0, 4)), replace=False)}
    return [None, True, int(r.integers(-9, 9)), "té\U0001d11e \"q\"", [1, {"x": [2]}, "s"], {}][k]


def walk(node, path=()):
    if isinstance(node, dict) and node:
        for k, v in node.items():
            yield from walk(v, (*path, k))
    else:
        yield ".".join(path), json.dumps(node, separators=(",", ":"), ensure_ascii=False)


def test_leaves(spark):
    rows = [(i, thing(5)) for i in range(150)] + [(200, {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}), (201, 7), (202, [1]), (203, {})]
    texts = [(i, json.dumps(t), "kept") for i, t in rows] + [(300, None, "x"), (301, "{broken", "x"), (302, "", "x")]
    df = spark.createDataFrame(texts, "id long, payload string, key string")
    found = payloads.leaves(df, "payload")
    assert found.columns == ["id", "key", "path", "value"]
    assert sorted((x.id, x.path, x.value) for x in found.collect()) == sorted((i, *leaf) for i, t in rows for leaf in walk(t))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert payloads.leaves(df.limit(0), "payload").count() == 0


@pytest.mark.parametrize("text,kind,value", [
    ("5", "int", "5"), ("12345678901234567890123", "int", "12345678901234567890123"), ("-3", "int", "-3"), ("true", "int", None), ("5.0", "int", None), ("1e2", "int", None), ('"5"', "int", None),
    ("true", "bool", "true"), ("1", "bool", None), ("null", "bool", None), ('"aé\\ud834\\udd1e"', "seq", "[97,233,119070]"), ('""', "seq", "[]"), ("[]", "seq", "[]"), ('[1,"ab",[2,"c"]]', "seq", "[1,[97,98],[2,[99]]]"),
    ("{}", "seq", None), ("7", "seq", None), ("7", "map", None),
])
def test_typed(spark, text, kind, value):
    got = spark.createDataFrame([(text, kind)], "t string, k string").select(payloads.typed(F.try_parse_json("t"), F.col("k")).alias("x")).first().x
    assert got.value == value and (got.error is None) == (value is not None)
    if value is None:
        assert got.error == ("no argument can be a map" if kind == "map" else f"expected a {kind}, got {text if not text.startswith(('5.0', '1e2')) else got.error.split('got ')[1]}")


def test_withhold(spark):
    payload = {"arms": {"a": {"mean": 1, "best": True}, "b": {"mean": 2}}, "verdict": "better", "holdout_eligible": True, "claims_withheld": ["x"], "list": [1]}
    rows = [(1, json.dumps(payload), None), (2, json.dumps(payload), "no held-out text"), (3, "{}", "leakage"), (4, None, None)]
    shown, gate = payloads.withhold(spark.createDataFrame(rows, "id long, payload string, reason string"), "id", "payload", ["arms.*.mean"])
    got = {(x.id, x.path): x.value for x in shown.collect()}
    assert got == {(i, p): v if i == 1 or p.endswith("mean") else None for i in (1, 2) for p, v in walk(payload) if p not in payloads.GATE_FIELDS}
    assert {x.id: (x.holdout_eligible, x.ineligible_reason, x.claims_withheld) for x in gate.collect()} == {1: (True, None, []), 2: (False, "no held-out text", ["arms.a.best", "list", "verdict"]), 3: (False, "leakage", []), 4: (True, None, [])}
