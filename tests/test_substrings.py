"""Substring search against plain containment."""

import random

from lumenforge.operators import joins, substrings


def test_against_plain_containment(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 20)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abAé /.") for _ in range(rng.randint(0, n)))
    docs = [(k, rng.choice([text(30), None]), text(12)) for k in range(150)]
    queries = [(q, text(5)) for q in range(40) for _ in range(rng.randint(1, 3))] + [(90, "zzzz"), (90, "aba"), (91, "ab")]
    got = substrings.containing(spark.createDataFrame(queries, "query long, term string"), spark.createDataFrame(docs, "id long, title string, url string"), "id", ["title", "url"]).collect()
    want = set()
    for q in {q for q, _ in queries}:
        terms = {t.lower() for p, t in queries if p == q and len(t) >= 3}
        want |= {(q, k) for k, *own in docs if terms and all(any(t in (c or "").lower() for c in own) for t in terms)}
    assert {(r["query"], r["doc"]) for r in got} == want and len(got) == len(want) and len(want) > 50


def test_nothing(spark):
    q, d = spark.createDataFrame([(1, "abc")], "query long, term string"), spark.createDataFrame([(1, "xabcx")], "id long, title string")
    assert substrings.containing(q, d, "id", ["title"]).count() == 1
    assert substrings.containing(q.where("false"), d, "id", ["title"]).count() == 0 and substrings.containing(q, d.where("false"), "id", ["title"]).count() == 0
