"""Offline evaluation of ranked results against gold sets, over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_matches(host: Column, gold: Column) -> Column:
    """Equal, or a label suffix."""
    return (host == gold) | host.endswith(F.concat(F.lit("."), gold))


def ndcg(hosts: Column, gold: Column, k: int = 10) -> Column:
    """Binary NDCG@k; hosts in rank order, gold in gold order. Each gold entry is credited once and each result feeds one entry:
    in rank order a result takes the first unused entry that it matches. Empty gold gives 0."""
    top = F.slice(hosts, 1, k)
    start = F.struct(F.lit(0.0).alias("dcg"), F.lit(0).alias("rank"), gold.alias("left"))

    def step(a: Column, host: Column) -> Column:
        hit = F.get(F.filter(a["left"], lambda g: host_matches(host, g)), F.lit(0))
        at = F.array_position(a["left"], hit)
        rest = F.when(hit.isNull(), a["left"]).otherwise(F.concat(F.slice(a["left"], F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice(a["left"], (at + 1).cast("int"), F.size(a["left"]))))
        return F.struct((a["dcg"] + F.when(hit.isNull(), 0.0).otherwise(1 / F.log2(a["rank"] + F.lit(2.0)))).alias("dcg"), (a["rank"] + 1).alias("rank"), rest.alias("left"))

    dcg = F.aggregate(top, start, step, lambda a: a["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(gold), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    return F.when(F.size(gold) == 0, 0.0).otherwise(dcg / ideal)


def ranking_metrics(results: DataFrame, gold: DataFrame, key: list[str], k: int = 10) -> DataFrame:
    """ndcg, reciprocal rank and precision for each key that has gold. results: key, rank, domain; gold: query, gold_domain."""
    lists = results.where(F.col("rank") <= k).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "domain"))), lambda x: x["domain"]).alias("hosts"))
    golds = gold.groupBy("query").agg(F.sort_array(F.collect_set("gold_domain")).alias("gold"))
    both = lists.join(golds, "query")
    hits = F.transform("hosts", lambda h: F.exists("gold", lambda g: host_matches(h, g)))
    first = F.array_position(hits, True)
    return both.select(
        *key,
        F.round(ndcg(F.col("hosts"), F.col("gold"), k), 6).alias("ndcg"),
        F.round(F.when(first > 0, 1 / first).otherwise(0.0), 6).alias("rr"),
        F.round(F.when(F.size("hosts") > 0, F.size(F.filter(hits, lambda h: h)) / F.size("hosts")).otherwise(0.0), 6).alias("precision"),
    )


def median_of_runs(rows: DataFrame, query: str = "query") -> DataFrame:
    """Majority pass, median metrics and the typical run (nearest to the median NDCG, then fastest, then first). rows: query, run, ndcg, latency_ms, passed."""
    middle = rows.groupBy(query).agg(F.median("ndcg").alias("median_ndcg"), F.median("latency_ms").alias("median_latency"), F.count("*").alias("runs"), (2 * F.count_if("passed") > F.count("*")).alias("passed"))
    near = rows.join(middle.select(query, "median_ndcg"), query)
    typical = near.groupBy(query).agg(F.min(F.struct(F.round(F.abs(F.col("ndcg") - F.col("median_ndcg")), 9).alias("d"), "latency_ms", "run")).alias("t")).select(query, F.col("t.run").alias("typical_run"))
    return middle.join(typical, query).select(query, "runs", "passed", F.round("median_ndcg", 6).alias("median_ndcg"), F.round("median_latency", 6).alias("median_latency"), "typical_run")


def regressions(current: DataFrame, baseline: DataFrame, query: str = "query") -> DataFrame:
    """(query, metric, before, after) of worse rows: fewer results, latency over 1.3 times, pass to fail, NDCG down by more than 0.05."""
    b = baseline.select(query, *[F.col(c).alias(f"b_{c}") for c in ("ndcg", "latency_ms", "passed", "n_results")])
    j = current.join(b, query)
    rows = F.array(
        F.when(F.col("n_results") < F.col("b_n_results"), F.struct(F.lit("results").alias("metric"), F.col("b_n_results").cast("double").alias("before"), F.col("n_results").cast("double").alias("after"))),
        F.when(F.col("latency_ms") > 1.3 * F.col("b_latency_ms"), F.struct(F.lit("latency").alias("metric"), F.col("b_latency_ms").cast("double").alias("before"), F.col("latency_ms").cast("double").alias("after"))),
        F.when(F.col("b_passed") & ~F.col("passed"), F.struct(F.lit("passed").alias("metric"), F.lit(1.0).alias("before"), F.lit(0.0).alias("after"))),
        F.when(F.col("b_ndcg") - F.col("ndcg") > 0.05, F.struct(F.lit("ndcg").alias("metric"), F.col("b_ndcg").alias("before"), F.col("ndcg").alias("after"))),
    )
    return j.select(query, *([c for c in ["run"] if c in current.columns]), F.explode(F.array_compact(rows)).alias("r")).select(query, *([c for c in ["run"] if c in current.columns]), "r.metric", F.round("r.before", 6).alias("before"), F.round("r.after", 6).alias("after"))


def stabilised(rows: DataFrame, least: int = 2) -> DataFrame:
    """(query, metric, runs, worst before, worst after) of regressions that at least `least` runs show."""
    gap = F.struct(F.abs(F.col("after") - F.col("before")).alias("gap"), "before", "after")
    return rows.groupBy("query", "metric").agg(F.countDistinct("run").alias("runs"), F.max(gap).alias("w")).where(F.col("runs") >= least).select("query", "metric", "runs", F.col("w.before").alias("before"), F.col("w.after").alias("after"))


def zero_gold(pools: DataFrame, gold: DataFrame, queries: DataFrame, runs: list[int], k: int = 10) -> DataFrame:
    """(query, zero, kind, gold_runs) of each query with gold: whether the median over the runs of its NDCG at k is 0, and why.

    pools: (run, query, doc, rank); gold: (query, doc); queries: query. kind of a zero query: empty, if no run has a result; coverage, if no pool holds
    gold; ranking, if every pool does, below rank k; mixed, if some do. A run without results is an empty pool. NDCG is 0 where no gold
    stands among the first k, so the median of these marks decides.
    """
    every = queries.select("query").join(gold.select("query").distinct(), "query", "left_semi").select("query", F.explode(F.array(*[F.lit(r).cast("long") for r in runs])).alias("run"))
    marked = pools.join(gold.select("query", "doc", F.lit(True).alias("_gold")).distinct(), ["query", "doc"], "left")
    told = marked.groupBy(F.col("run").cast("long").alias("run"), "query").agg(F.count("*").alias("size"), F.count("_gold").alias("held"), F.count_if(F.col("_gold") & (F.col("rank") <= k)).alias("hits"))
    each = every.join(told, ["run", "query"], "left").na.fill(0, ["size", "held", "hits"])
    g = each.groupBy("query").agg((F.median((F.col("hits") > 0).cast("int")) == 0).alias("zero"), F.count_if(F.col("held") > 0).alias("gold_runs"), F.max("size").alias("size"))
    kind = F.when(F.col("size") == 0, "empty").when(F.col("gold_runs") == 0, "coverage").when(F.col("gold_runs") == len(runs), "ranking").otherwise("mixed")
    return g.select("query", "zero", F.when(F.col("zero"), kind).otherwise("found").alias("kind"), "gold_runs")


def zero_gold_report(kinds: DataFrame, axes: DataFrame) -> DataFrame:
    """(axis, value, queries, zero, share, empty, coverage, ranking, mixed) for axes (query, axis, value), with one row for all queries."""
    every = axes.select("query", "axis", "value").distinct().unionByName(kinds.select("query", F.lit("all").alias("axis"), F.lit("all").alias("value")))
    counts = [F.count_if(F.col("kind") == n).alias(n) for n in ("empty", "coverage", "ranking", "mixed")]
    g = every.join(kinds, "query").groupBy("axis", "value").agg(F.count("*").alias("queries"), F.count_if("zero").alias("zero"), *counts)
    return g.select("axis", "value", "queries", "zero", F.round(F.col("zero") / F.col("queries"), 6).alias("share"), "empty", "coverage", "ranking", "mixed")


def gold_drift(before: DataFrame, after: DataFrame, gold: DataFrame, threshold: float = 0.01, gate: float = 0.05) -> DataFrame:
    """(query, before, after, delta, drift, flips) of each query with a result in any run, where its gold has changed since the runs were judged.

    before, after: (run, query, ndcg) by the old and the new gold, null where a run was not judged; gold: queries with new gold. before, after and
    delta are medians over the runs. drift: removed (no new gold, but a judgement), added (new gold, no judgement), changed (a median delta of
    threshold or more either way), else same; flips: a change that reaches the gate.
    """
    key = ["run", "query"]
    both = before.select(*key, F.col("ndcg").alias("b")).join(after.select(*key, F.col("ndcg").alias("a")), key, "full_outer").join(gold.select("query", F.lit(True).alias("_gold")).distinct(), "query", "left")
    a = F.when(F.col("_gold"), F.coalesce("a", F.lit(0.0))).otherwise(0.0)  # without gold the NDCG is 0
    g = both.withColumn("a", a).groupBy("query").agg(F.median("b").alias("before"), F.median("a").alias("after"), F.median(F.col("a") - F.col("b")).alias("delta"), F.bool_or(F.coalesce("_gold", F.lit(False))).alias("held"))
    changed = F.coalesce(F.abs(F.round("delta", 6)) >= threshold, F.lit(False))
    drift = F.when(~F.col("held") & F.col("before").isNotNull(), "removed").when(F.col("held") & F.col("before").isNull(), "added").when(changed, "changed").otherwise("same")
    told = g.withColumn("drift", drift)
    return told.select("query", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("delta", 6).alias("delta"), "drift", ((F.col("drift") == "changed") & (F.abs(F.round("delta", 6)) >= gate)).alias("flips"))
