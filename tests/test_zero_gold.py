"""Causes of zero gold on small runs, and the report over axes."""

from lumenforge.operators import evaluation


def test_kinds_and_report(spark):
    pools = [(r, 1, 5, 1) for r in (1, 2, 3)] + [(r, 2, 5, 12) for r in (1, 2, 3)] + [(1, 3, 5, 11), (2, 3, 6, 1), (1, 4, 9, 1), (1, 6, 5, 1), (2, 6, 5, 3), (1, 7, 5, 2), (1, 8, 5, 1)]
    gold = [(q, 5) for q in (1, 2, 3, 4, 5, 6, 7)] + [(1, 5), (1, 99)]
    p, g = spark.createDataFrame(pools, "run int, query long, doc long, rank int"), spark.createDataFrame(gold, "query long, doc long")
    kinds = evaluation.zero_gold(p, g, p.select("query").union(g.select("query")).distinct(), [1, 2, 3])
    assert {r["query"]: (r.zero, r.kind, r.gold_runs) for r in kinds.collect()} == {1: (False, "found", 3), 2: (True, "ranking", 3), 3: (True, "mixed", 1), 4: (True, "coverage", 0), 5: (True, "empty", 0), 6: (False, "found", 2), 7: (True, "mixed", 1)}
    axes = spark.createDataFrame([(1, "lang", "en"), (2, "lang", "en"), (2, "lang", "en"), (5, "lang", None)], "query long, axis string, value string")
    got = {(r.axis, r.value): (r.queries, r.zero, r.share, r.empty, r.coverage, r.ranking, r.mixed) for r in evaluation.zero_gold_report(kinds, axes).collect()}
    assert got == {("all", "all"): (7, 5, 0.714286, 1, 1, 1, 2), ("lang", "en"): (2, 1, 0.5, 0, 0, 1, 0), ("lang", None): (1, 1, 1.0, 1, 0, 0, 0)}
    assert evaluation.zero_gold(p, g.where("false"), p.select("query").distinct(), [1]).count() == 0


def test_gold_drift(spark):
    schema = "run int, query long, ndcg double"
    before = spark.createDataFrame([(r, 1, 0.5) for r in (1, 2, 3)] + [(r, 2, 0.5) for r in (1, 2, 3)] + [(1, 3, 0.4)] + [(r, 5, 0.3) for r in (1, 2)], schema)
    after = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.505), (3, 1, 0.9)] + [(r, 2, 0.44) for r in (1, 2, 3)] + [(1, 4, 0.7)] + [(1, 5, 0.28)], schema)
    got = {r["query"]: (r.before, r.after, r.delta, r.drift, r.flips) for r in evaluation.gold_drift(before, after, spark.createDataFrame([(1,), (2,), (4,), (5,), (5,)], "query long")).collect()}
    assert got == {1: (0.5, 0.505, 0.005, "same", False), 2: (0.5, 0.44, -0.06, "changed", True), 3: (0.4, 0.0, -0.4, "removed", False), 4: (None, 0.7, None, "added", False), 5: (0.3, 0.14, -0.16, "changed", True)}
