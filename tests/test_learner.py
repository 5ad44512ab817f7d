"""The streaming learner against a plain loop over its flushes."""

import math
import random

import pytest

from lumenforge.streaming import jobs, learner


def plain(batches, rate):
    """State after each flush: rows (a, b, y, w)."""
    every, w, bias, counts, out = [], [0.0, 0.0, 0.0], 0.0, [0, 0, 0, 0], []
    for rows in batches:
        every += rows
        n = len(every)
        means = [sum(r[f] for r in every) / n for f in range(3)]
        spread = [math.sqrt(sum((r[f] - means[f]) ** 2 for r in every) / n) for f in range(3)]
        g, gb = [0.0] * 3, 0.0
        for r in rows:
            x = [(r[f] - means[f]) / spread[f] if spread[f] > 1e-12 else 0.0 for f in range(3)]
            p = 1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(x, w, strict=True)))))
            error = (r[3] - p) * r[4]
            g, gb = [a + error * b for a, b in zip(g, x, strict=True)], gb + error
            yes, one = p >= 0.5, r[3] >= 0.5
            counts = [c + bool(k) for c, k in zip(counts, (yes == one, yes and one, yes and not one, not yes and one), strict=True)]
        w, bias = [a + rate * b / len(rows) for a, b in zip(w, g, strict=True)], bias + rate * gb / len(rows)
        out.append((n, means, w, bias, counts))
    return out


def examples(n):
    rng = random.Random(4)
    return [(k, rng.gauss(2, 3), rng.random(), 5.0, int(rng.random() < 0.4), rng.choice([1.0, 0.5, 2.0])) for k in range(n)]


SCHEMA = "t long, a double, b double, c double, y int, w double"


@pytest.mark.parametrize(("flush_rows", "groups"), [(1, [[0], [1], [2], [3], [4]]), (250, [[0, 1], [2, 3], [4]])])
def test_five_batches_are_the_plain_loop(spark, tmp_path, flush_rows, groups):
    rows = examples(1000)
    df = spark.createDataFrame(rows + [(5, None, 1.0, 5.0, 1, 1.0), (6, 1.0, 1.0, 5.0, None, 1.0)], SCHEMA)
    for k in range(5):  # files of a landing folder, one a batch
        df.where(df.t % 5 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = learner.learn(stream, ["a", "b", "c"], "y", 0.3, flush_rows, "w", str(tmp_path / "base")).orderBy("version").collect()
    want = plain([[r[1:] for r in rows if r[0] % 5 in g] for g in groups], 0.3)
    assert [r.version for r in told] == list(range(1, len(want) + 1))
    for r, (n, means, w, bias, counts) in zip(told, want, strict=True):
        assert (r.n, [r.right, r.hits, r.false_hits, r.misses]) == (n, counts)
        assert list(r.means) == pytest.approx(means) and list(r.weights) == pytest.approx(w) and r.bias == pytest.approx(bias)
    # a later run with nothing new leaves the model as it is, one with new rows goes on from it
    again = learner.learn(stream, ["a", "b", "c"], "y", 0.3, flush_rows, "w", str(tmp_path / "base"))
    assert again.count() == len(told)
    df.where("t < 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = learner.learn(stream, ["a", "b", "c"], "y", 0.3, 1, "w", str(tmp_path / "base"))
    assert more.agg({"version": "max"}).first()[0] == len(told) + 1 and more.agg({"n": "max"}).first()[0] == 1050


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "x.parquet"))
    assert learner.learn(jobs.stream_of(spark, str(tmp_path), "x", "t"), ["a"], "y").where("n > 0").count() == 0
