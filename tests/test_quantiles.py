"""Exact quantiles against numpy, with ties, far values, many passes and nothing."""

import random

import numpy as np
import pytest

from lumenforge.operators.quantiles import exact_quantiles, median

SHARES = [0.0, 0.13, 0.5, 0.95, 1.0]


@pytest.mark.parametrize(("bins", "few"), [(1024, 4096), (32, 3)])
def test_against_numpy(spark, bins, few):
    rng = random.Random(bins)
    told = {
        ("flat", 1): [rng.random() for _ in range(700)], ("ties", 1): [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(501)], ("one", 2): [4.25], ("two", 2): [1.0, 2.0],
        ("far", None): [10.0 ** rng.randint(-6, 6) * rng.choice([1, -1]) for _ in range(120)], (None, 3): [5.0] * 90, ("null", 3): [7.0, 8.0], ("edge", 4): [-1.7e308, 1.7e308, 0.0, 1.0],
    }
    rows = [(*k, v) for k, vs in told.items() for v in vs] + [("flat", 1, None), ("flat", 1, float("nan")), ("empty", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(6)
    got = {(r.a, r.b): [r[f"q{i}"] for i in range(len(SHARES))] for r in exact_quantiles(df, ["a", "b"], "x", SHARES, bins, few).collect()}
    assert set(got) == set(told)
    for k, vs in told.items():
        at = sorted(vs)
        for s, q in zip(SHARES, got[k], strict=True):
            place = (len(at) - 1) * s
            low, high = at[int(np.floor(place))], at[int(np.ceil(place))]
            assert q == pytest.approx(low if low == high else low * (1 - place % 1) + high * (place % 1))


def test_no_key_and_nothing(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "x double")
    assert median(df, [], "x", "m").collect()[0].m == 5.0
    assert median(df.where("false"), [], "x", "m").count() == 0 or median(df.where("false"), [], "x", "m").first().m is None
