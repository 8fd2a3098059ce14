"""Exact quantiles and ranks against NumPy."""

import random

import numpy as np
import pytest

from partwise.plans.quantiles import average_ranks, exact_quantiles


def test_exact_quantiles(spark):
    r = random.Random(2)
    rows = [(g, r.choice([1.0, 2.5, 7.0, r.random() * 9])) for g in ("a", "b", None) for _ in range(r.randrange(1, 200))] + [("a", None), ("one", 4.0), ("none", None)]
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {x.g: x.q for x in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], shares).tolist())
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", shares).count() == 0
    assert exact_quantiles(spark.createDataFrame([(5,), (1,)], "v int"), [], "v", [0.5]).first().q == [3.0]


def test_average_ranks(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 3.0), ("b", 9.0), (None, 2.0), ("a", None)]
    got = sorted(((x.g, x.v, x.k) for x in average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "k").collect()), key=str)
    assert got == sorted([("a", 3.0, 2.5), ("a", 3.0, 2.5), ("a", 1.0, 1.0), ("b", 9.0, 1.0), (None, 2.0, 1.0), ("a", None, None)], key=str)


@pytest.mark.parametrize("accuracy", [10, 40, 1000])
def test_brackets_hold_the_wanted_ranks(spark, accuracy):
    """Groups far larger than the brackets, with ties that hold many ranks; a coarse bracket changes nothing."""
    r = random.Random(accuracy)
    rows = [(g, r.choice([0.0, 5.0, r.gauss(0, 3), r.gauss(50, 1)]), 1) for g in ("a", "b") for _ in range(3000)] + [("c", 7.0, 1)] * 500
    shares = (0.0, 0.01, 0.333, 0.5, 0.99, 1.0)
    got = {x.g: x.q for x in exact_quantiles(spark.createDataFrame(rows, "g string, v double, n int").repartition(5), ["g"], "v", shares, accuracy=accuracy).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for h, v, _ in rows if h == g], shares).tolist())


def test_a_missed_bracket_ranks_everything(spark, monkeypatch):
    from partwise.plans import quantiles

    calls, real = [], quantiles._picked
    monkeypatch.setattr(quantiles, "_picked", lambda at, keys: real(at.filter("i <> 1") if not calls.append(1) and len(calls) == 1 else at, keys))
    got = exact_quantiles(spark.createDataFrame([(float(i),) for i in range(101)], "v double"), [], "v", [0.1, 0.5]).first()
    assert got.q == [10.0, 50.0] and len(calls) == 2
