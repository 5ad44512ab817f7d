"""Scans over slices against plain loops, with keys that span many slices, and tables of one row."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumenforge.operators import scans


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "warm", None]), rng.randint(0, n // 3), k, rng.choice([True, True, False, None]), rng.choice([None, 1.5, -2.0, rng.random()])) for k in range(n)]
    return [*rows, ("one", 5, n, True, 3.0), ("none", 6, n + 1, False, None)]


def by_key(rows):
    told = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        told.setdefault(r[0], []).append(r)
    return told


@pytest.fixture(params=[1, 3, 40])
def case(spark, request):
    rows = rows_of(request.param, 400)
    return spark.createDataFrame(rows, "k string, t long, id long, f boolean, x double").repartition(4), by_key(rows), request.param


def test_running_sum_previous_and_number(case):
    df, told, parts = case
    scan = scans.Scan(df, ["k"], ["t", "id"], parts)
    assert scan.rows.select("_slice").distinct().count() > parts // 3
    rows = scan.previous(F.col("x"), "before", scan.numbered("n", scan.running_sum(F.col("id"), "total"))).collect()
    want = {}
    for own in told.values():
        total = 0
        for n, r in enumerate(own):
            total += r[2]
            want[r[2]] = (total, n + 1, own[n - 1][4] if n else None)
    assert {r.id: (r.total, r.n, r.before) for r in rows} == want and len(rows) == len(want)


def test_folds_and_runs(case):
    df, told, parts = case
    average, runs, streaks, incidents = {}, {}, {}, {}
    for k, own in told.items():
        values = [r[4] for r in own if r[4] is not None]
        if values:
            average[k] = 0.5
            for v in values:
                average[k] = average[k] * 0.8 + v * 0.2
        groups = [(f, list(g)) for f, g in itertools.groupby(own, key=lambda r: bool(r[3]))]
        incidents[k] = sum(f for f, _ in groups)
        streaks[k] = len(groups[-1][1]) if groups[-1][0] else 0
        runs[k] = sorted((len(g), g[0][1:3], g[-1][1:3], g is groups[-1][1]) for f, g in groups if f)
    key = ["k"], ["t", "id"]
    assert {r.k: r.folded for r in scans.moving_average(df, *key, F.col("x"), 0.5, 0.8, parts).collect()} == pytest.approx(average)
    assert {r.k: r.incidents for r in scans.incidents(df, *key, F.col("f"), parts).collect()} == incidents
    assert {r.k: r.streak for r in scans.trailing(df, *key, F.col("f"), parts).collect()} == streaks
    found = {}
    for r in scans.runs(df, *key, F.col("f"), parts).collect():
        found.setdefault(r.k, []).append((r.length, tuple(r["first"]), tuple(r["last"]), r.open))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in runs.items() if v}


def test_nothing(spark):
    df = spark.createDataFrame([], "k string, t long, id long, f boolean, x double")
    assert scans.moving_average(df, ["k"], ["t"], F.col("x"), 0.5, 0.8).count() == 0 and scans.runs(df, ["k"], ["t"], F.col("f")).count() == 0
