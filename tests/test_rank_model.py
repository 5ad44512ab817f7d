"""The list-wise ranking model against a plain loop, and its gain on lists that it has not seen."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import rank_model as R


def lists(seed, n):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        for k in range(rng.randint(1, 9)):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((g, k, a, b, 7.0, int(a - 0.5 * b + rng.gauss(0, 0.3) > 0.8) * rng.choice([1, 1, 2])))
    return rows


COLUMNS = "g long, k long, a double, b double, c double, y int"


def plain_fit(rows, rounds):
    x = np.array([r[2:5] for r in rows])
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    x, w = (x - mean) / scale, [0.0] * 3
    for _ in range(rounds):
        g, h, n = [0.0] * 3, [0.0] * 3, 0
        for group in sorted({r[0] for r in rows}):
            own = [(x[i], r[5]) for i, r in enumerate(rows) if r[0] == group]
            n += 1
            score = [float(np.dot(v, w)) for v, _ in own]
            order = sorted(range(len(own)), key=lambda i: (-score[i], i))
            rank = {i: p for p, i in enumerate(order)}
            ideal = sum((2**y - 1) / math.log2(p + 2) for p, y in enumerate(sorted((y for _, y in own), reverse=True)))
            for i, (u, yu) in enumerate(own):
                for j, (v, yv) in enumerate(own):
                    if yu > yv:
                        p = 1 / (1 + math.exp(score[i] - score[j]))
                        d = abs(2**yu - 2**yv) * abs(1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2)) / ideal
                        for f in range(3):
                            g[f] += d * p * (u[f] - v[f])
                            h[f] += d * p * (1 - p) * (u[f] - v[f]) ** 2
        w = [w[f] + R.STEP * (g[f] / n - R.PENALTY * w[f]) / (h[f] / n + R.PENALTY) for f in range(3)]
    return w


def test_fit_is_the_plain_loop(spark):
    rows = lists(1, 60)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    model = R.fit(df, "g", ["k"], ["a", "b", "c"], "y", rounds=4, least=10)
    assert model.weights == pytest.approx(plain_fit(rows, 4), rel=1e-6, abs=1e-9) and model.weights[0] > 0 > model.weights[1]
    assert R.fit(df, "g", ["k"], ["a"], "y", least=10_000) is None


def test_better_lists_than_before(spark):
    train, test = spark.createDataFrame(lists(2, 150), COLUMNS), spark.createDataFrame(lists(3, 100), COLUMNS)
    model = R.fit(train, "g", ["k"], ["a", "b", "c"], "y")
    back = R.RankModel.read(model.table(spark).unionByName(R.RankModel(["a"], [0.0], [1.0], [9.0], 0).table(spark)))
    assert (back.features, back.weights, back.version) == (["a", "b", "c"], model.weights, 1)
    mean = lambda score: R.ndcg(test, "g", "y", score, ["k"]).agg(F.avg("ndcg")).first()[0]
    assert mean(back.score()) > 0.9 > mean(F.lit(0.0)) and mean(back.score()) > mean(F.col("b"))
    scores = test.select(back.score().alias("p")).toPandas().p
    assert scores.between(0, 1).all() and scores.nunique() > 100


def test_counts_of_terms(spark):
    from lumenforge.operators import learning

    df = spark.createDataFrame([(["a", "b", "é"], ["a", "a", "é", "x"]), ([], ["a"]), (["a"], []), (["a"], None)], "q array<string>, w array<string>")
    assert [r.n for r in df.select(learning.counts_of()("q", "w").alias("n")).collect()] == [[2, 0, 1], [], [0], [0]]


def test_models_of_the_given_tables(spark, sf_dir):
    """Trained scores put the documents that hold a passage first, and clicks no lower than the position does."""
    from lumenforge.plans import catalogue
    from lumenforge.plans import retrieval_queries as Q

    q = catalogue.queries()
    gold = {(r["query"], r["doc"]) for r in Q.gold(spark, sf_dir).collect()}
    rows = q["r10_model_blend"](spark, sf_dir).collect()
    first = {r["query"]: (r["query"], r["doc"]) for r in rows if r.place == 1}
    asked = {g[0] for g in gold} & set(first)
    assert asked and sum(first[a] in gold for a in asked) >= 0.9 * len(asked)
    scored = q["m6_sigmoid_scores"](spark, sf_dir).toPandas()
    # only position and score differ inside a list here, and both follow the place
    assert scored.p.between(0, 1).all() and scored.p.nunique() >= 3 and set(scored.part) == {"train", "test"}
    assert (scored.groupby("impression_id").place.max() == scored.groupby("impression_id").place.count()).all()


def test_lists_are_worked_together(monkeypatch):
    """Batches come as whole lists, few calls whatever their number; pairs in pieces add up to the same sums."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 9, 3000)
    keys = np.repeat(np.arange(3000), sizes)
    x, y, w = rng.normal(size=(len(keys), 2)), rng.integers(0, 3, len(keys)).astype(float), np.array([0.7, -0.2])
    x[::5] = x[1::5][: len(x[::5])][0]  # ties of scores
    table = pa.table({"g": [None if k == 2999 else k for k in keys.tolist()], "y": y, "x": x.tolist()})
    calls = list(R._lists(table.to_batches(max_chunksize=1000)))
    assert len(calls) <= 2 * -(-len(keys) // 1000) and [n for c in calls for n in c[2]] == sizes.tolist()
    assert (np.concatenate([c[0] for c in calls]) == x).all() and (np.concatenate([c[1] for c in calls]) == y).all()
    assert [c[2].tolist() for c in R._lists(pa.table({"g": [1] * 5 + [2], "y": [0.0] * 6, "x": [[0.0]] * 6}).to_batches(max_chunksize=2))] == [[5], [1]]
    want = [0.0, 0.0, 0.0]
    for a, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        v, t = x[a : a + n], y[a : a + n]
        s = v @ w
        rank = {i: p for p, i in enumerate(sorted(range(n), key=lambda i: (-s[i], i)))}
        ideal = sum((2**u - 1) / math.log2(p + 2) for p, u in enumerate(sorted(t, reverse=True)))
        want[2] += sum((2 ** t[i] - 1) / math.log2(rank[i] + 2) for i in range(n)) / ideal if ideal else 1.0
        for i in range(n):
            for j in range(n):
                if t[i] > t[j]:
                    p = 1 / (1 + math.exp(s[i] - s[j]))
                    d = abs(2 ** t[i] - 2 ** t[j]) * abs(1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2)) / ideal
                    want[0], want[1] = want[0] + d * p * (v[i] - v[j]), want[1] + d * p * (1 - p) * (v[i] - v[j]) ** 2
    for pairs in (1 << 18, 50, 1):
        monkeypatch.setattr(R, "PAIRS", pairs)
        g, h, q = R.gradients(x, y, sizes, w)
        assert g == pytest.approx(want[0]) and h == pytest.approx(want[1]) and q == pytest.approx(want[2])
        if pairs > 1:
            parts = [R.gradients(*c, w) for c in calls]
            assert sum(p[0] for p in parts) == pytest.approx(want[0]) and sum(p[2] for p in parts) == pytest.approx(want[2])
    assert [v.tolist() for v in R.gradients(x[:0], y[:0], sizes[:0], w)[:2]] == [[0, 0], [0, 0]]


def test_labels_carry_their_features(spark, sf_dir):
    """The events are read once for what was shown and once for the clicks; nothing is joined back."""
    from lumenforge.plans import learning_queries as LQ

    rows = LQ.labelled(spark, sf_dir)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert rows.columns == ["impression_id", "url", "query", "user_id", *LQ.FEATURES, "label"]
    labels = {(r.impression_id, r.url): r.label for r in LQ.V.impressions(spark, sf_dir).select("impression_id", F.explode("results.url").alias("url")).join(rows.select("impression_id", "url", "label"), ["impression_id", "url"], "left").collect()}
    assert set(labels.values()) == {0, 1} and len(labels) == rows.count()
