"""The keyed permutation of an epoch."""

import numpy as np
import pytest

from textloom.operators import permutation as P


def test_a_bijection_at_every_size():
    for n in [*range(1, 5001, 7), 4095, 4096, 4097, 5000]:
        places = P.permuted(np.arange(n), n, 3, n % 5)
        assert (np.sort(places) == np.arange(n)).all()
        assert (P.permuted(places, n, 3, n % 5, back=True) == np.arange(n)).all()


def test_epochs_differ_and_spread():
    n = 20_000
    a, b = (P.permuted(np.arange(n), n, 7, e) for e in (0, 1))
    assert (a == b).mean() < 0.01 and (a == np.arange(n)).mean() < 0.01
    for places in (a, b):
        assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.03
        cells = np.histogram2d(np.arange(n), places, bins=10)[0]  # 200 in each of 100 cells
        assert ((cells - 200) ** 2 / 200).sum() < 180
    assert (P.permuted(np.arange(n), n, 8, 0) != a).mean() > 0.99
    big = P.permuted(np.array([0, 1, 10**15]), 10**15 + 1, 1, 1)
    assert (P.permuted(big, 10**15 + 1, 1, 1, back=True) == [0, 1, 10**15]).all() and big.max() <= 10**15
    with pytest.raises(ValueError):
        P.permuted(np.arange(2), 1 << 63, 1, 1)


def test_places_of_rows_without_a_shuffle(spark):
    rows = spark.range(0, 1000, 1, 6).selectExpr("id number", "concat('t', id) text").unionByName(spark.createDataFrame([(None, "x")], "number long, text string"))
    placed = P.with_places(rows, 1000, 5, 2)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    got = placed.collect()
    assert sorted(r.place for r in got if r.number is not None) == list(range(1000)) and [r.place for r in got if r.number is None] == [None]
    back = P.with_places(placed.filter("number is not null").selectExpr("place number", "number was"), 1000, 5, 2, back=True)
    assert back.filter("place <> was").count() == 0
