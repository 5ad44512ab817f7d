"""Ranked search against plain scores of all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    listed = [(i, collections.Counter(terms(t))) for i, t in docs]
    listed = [(i, c, sum(c.values())) for i, c in listed if c]
    n_docs, total = len(listed), sum(n for _, _, n in listed)
    df = collections.Counter(t for _, c, _ in listed for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in listed:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["score"] == "bigint"
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["É", "é", "日本", "A_b", "Ab", "averylongcompoundterm" * 3, "averylongcompoundterm" * 20]
    text = lambda most: rng.choice([" ", "-", "_", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, most)))
    docs = [(k, text(rng.choice([3, 40, 400]))) for k in range(n)]
    docs += [(1000 + k, docs[5][1]) for k in range(25)] + [(2000, None), (2001, " -- ")]
    items = [(k, text(30)) for k in range(25)] + [(90, docs[5][1]), (91, None), (92, "nowhereatall"), (93, "w1 w1 w1 w2"), (94, "")]
    return docs, items


@pytest.mark.parametrize(("seed", "block", "k"), [(1, 8192, 10), (2, 16, 10), (3, 5, 3), (4, 64, 1)])
def test_against_brute_force(spark, seed, block, k):
    docs, items = corpus(seed, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert got(R.search(d, i, k, block_docs=block)) == brute(docs, items, k)


def test_items_in_blocks_and_repeated_rows(spark, monkeypatch):
    docs, items = corpus(5, 60)
    docs, items = docs + docs[:9], items + items[:3]
    monkeypatch.setattr(R, "ITEM_BLOCK", 7)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(R.search(d, i)) == brute(docs, items)
    monkeypatch.setattr(R, "ITEM_CHARS", 50)
    assert got(R.search(d, i)) == brute(docs, items)


def test_nothing(spark):
    d, i = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert got(R.search(d.where("false"), i)) == [] and got(R.search(d, i.where("false"))) == []
    assert got(R.search(d, i)) == brute([(1, "one two")], [(1, "two")])
    assert [r[2] for r in got(R.search(spark.createDataFrame([(None, "two a"), (7, "two b"), (3, "x y")], "doc_id long, text string"), i))] == [None, 7]


def test_creation_stops_and_survivors_stay_exact():
    """Few accumulators for a rare term with a high bound, and the same best documents as without a limit."""
    rng = np.random.default_rng(2)
    n = 2000
    rare, common = rng.choice(n, 30, replace=False), np.arange(n)
    docs, which = np.concatenate([rare, common]), np.concatenate([np.zeros(30, np.int64), np.ones(n, np.int64)])
    p = R.Postings(rng.integers(5, 90, n), docs, which, rng.integers(1, 4, len(docs)), n, n * 40, R.weights(n, np.array([30, n // 2])))
    who, scores = p.best(np.array([0, 1]), np.array([1, 1]), 10, 0)
    full = np.zeros(n, np.int64)
    np.add.at(full, p.docs, p.gains)
    assert set(who) <= set(rare) and (full[who] == scores).all()
    assert sorted(scores.tolist())[-10:] == sorted(full.tolist())[-10:]
