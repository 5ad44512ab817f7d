"""Operational metrics over request logs: percentiles, windows, error rates, service levels, cost and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.times import micros
from lumenforge.operators import scans
from lumenforge.operators.sessions import newest


def interpolated(column: str, shares: list[float]) -> list[Column]:
    """Exact percentiles with linear interpolation."""
    return [F.percentile(column, F.lit(s)).alias(f"p{round(s * 100)}") for s in shares]


def nearest_rank(df: DataFrame, key: list[str], order: list, column: str, share: float, newest_n: int | None = None) -> DataFrame:
    """key, value at the nearest rank; optionally over the newest rows of each key."""
    rows = newest(df, key, order, newest_n) if newest_n else df
    return rows.groupBy(*key).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(share * 100)}"), F.count("*").alias("samples"))


def error_rate(df: DataFrame, key: list[str], failed: Column) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*key).agg(n.alias("total"), F.count_if(failed).alias("errors"), F.round(100.0 * F.count_if(failed) / n, 6).alias("error_pct"))


def per_interval(df: DataFrame, ts: str, interval: str, key: list[str], aggregates: list[Column]) -> DataFrame:
    """Tumbling event-time windows by key; the window's start is bucket."""
    return df.groupBy(F.window(ts, interval).alias("w"), *key).agg(*aggregates).withColumn("bucket", F.col("w.start")).drop("w")


def panel(df: DataFrame, ts: str, interval: str, key: list[str], latency: str, failed: Column, slow_s: float = 5.0) -> DataFrame:
    """Requests, errors, latency and a health score (1 - error ratio, less up to a half for slow averages) per interval and key."""
    n = F.count("*")
    out = per_interval(df, ts, interval, key, [n.alias("requests"), F.count_if(failed).alias("errors"), F.avg(latency).alias("_avg"), F.round(F.percentile(latency, F.lit(0.95)), 6).alias("p95"), F.round(F.percentile(latency, F.lit(0.99)), 6).alias("p99")])
    ratio = F.col("errors") / F.col("requests")
    health = F.greatest(F.lit(0.0), 1.0 - ratio - 0.5 * F.least(F.lit(1.0), F.col("_avg") / slow_s))
    return out.withColumn("avg_latency", F.round("_avg", 6)).withColumn("error_ratio", F.round(ratio, 6)).withColumn("health", F.round(health, 6)).drop("_avg")


def slowest(df: DataFrame, column: str, share: float, limit: int, tie: str) -> DataFrame:
    """Rows at or above the exact quantile, slowest first. The quantile is one row, so the join has one row on one side."""
    bound = df.agg(F.percentile(column, F.lit(share)).alias("_bound"))
    return df.crossJoin(F.broadcast(bound)).where(F.col(column) >= F.col("_bound")).drop("_bound").orderBy(F.desc(column), tie).limit(limit)


def cache_effect(df: DataFrame, key: str, cold: str, warm: str, limit: float = 0.2) -> DataFrame:
    """One row: pairs, hits (warm below the limit and below cold), hit rate, averages. df has one row per key."""
    hit = (F.col(warm) < limit) & (F.col(warm) < F.col(cold))
    return df.agg(F.count("*").alias("pairs"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("hit_rate"), F.round(F.avg(cold), 6).alias("avg_cold"), F.round(F.avg(warm), 6).alias("avg_warm"))


def cost_breakdown(df: DataFrame, service: str, operation: str, amount: Column) -> DataFrame:
    """Rollup service -> operation -> total with its level (0 detail, 1 service, 3 total)."""
    return df.rollup(service, operation).agg(F.count("*").alias("calls"), F.round(F.sum(amount), 4).alias("cost"), F.grouping_id().cast("long").alias("level"))


def priced_usage(df: DataFrame, prices: DataFrame, service: str, operation: str, units: str, ts: str) -> DataFrame:
    """Cost of usage by a price table (service, operation, price: a bounded constant, so it is broadcast), for each month and day,
    by service and operation with totals. level: 0 detail, 1 service, 3 window; span: day, month or all."""
    # units add up, so they are summed by day, service and operation before anything is repeated for windows and totals
    daily = df.groupBy(service, operation, F.date_trunc("day", ts).alias("_day")).agg(F.sum(F.col(units).cast("decimal(18,4)")).cast("decimal(28,4)").alias("_units"), F.count("*").alias("_calls"))
    priced = daily.join(F.broadcast(prices), [service, operation], "left").withColumn("_cost", (F.coalesce("_units", F.lit(0)) * F.coalesce("price", F.lit(0)).cast("decimal(9,6)")).cast("decimal(38,10)"))
    spans = {"day": F.date_format("_day", "yyyy-MM-dd"), "month": F.date_format("_day", "yyyy-MM"), "all": F.lit("all")}
    dealt = priced.select(service, operation, "_cost", "_calls", F.explode(F.array(*[F.struct(F.lit(n).alias("span"), w.alias("window")) for n, w in spans.items()])).alias("w")).select(service, operation, "_cost", "_calls", "w.span", "w.window")
    sets = dealt.groupingSets([["span", "window", service, operation], ["span", "window", service], ["span", "window"]], "span", "window", service, operation)
    return sets.agg(F.sum("_calls").alias("calls"), F.round(F.sum("_cost").cast("double"), 4).alias("cost"), (F.grouping(service) * 2 + F.grouping(operation)).cast("long").alias("level"))


def budget_windows(df: DataFrame, ts: str, spent: str, daily: float, monthly: float) -> DataFrame:
    """(span, window, spent, share, status, advice) of each day and month against its limit: warning from 80 %, critical from 95 %."""
    spans = F.explode(F.array(F.struct(F.lit("day").alias("span"), F.date_format(ts, "yyyy-MM-dd").alias("window"), F.lit(float(daily)).alias("limit")), F.struct(F.lit("month").alias("span"), F.date_format(ts, "yyyy-MM").alias("window"), F.lit(float(monthly)).alias("limit")))).alias("w")
    out = df.select(F.col(spent).cast("decimal(20,4)").alias("_x"), spans).groupBy("w.span", "w.window", "w.limit").agg(F.sum("_x").cast("double").alias("spent"))
    share = F.col("spent") / F.col("limit")
    status = F.when(share >= 0.95, "critical").when(share >= 0.8, "warning").otherwise("ok")
    advice = F.when(share >= 1, "stop or raise the limit").when(share >= 0.95, "defer what can wait").when(share >= 0.8, "use cheaper services").otherwise("none")
    return out.select("span", "window", F.round("spent", 4).alias("spent"), F.round(share, 6).alias("share"), status.alias("status"), advice.alias("advice"))


def budget_status(df: DataFrame, spent: Column, limit: float) -> DataFrame:
    share = F.col("spent") / limit
    return df.agg(F.round(F.sum(spent), 4).alias("spent")).withColumn("share", F.round(share, 6)).withColumn("status", F.when(share >= 0.95, "critical").when(share >= 0.8, "warning").otherwise("ok"))


def compliance(df: DataFrame, key: list[str], measured: str, target: str, lower_is_better: Column) -> DataFrame:
    """Per key: checks, met, ratio, worst severity of a breach by relative deviation, and ok at 99%."""
    met = F.when(lower_is_better, F.col(measured) <= F.col(target)).otherwise(F.col(measured) >= F.col(target))
    off = F.abs(F.col(measured) - F.col(target)) / F.col(target)
    level = F.when(met, 0).when(off > 0.5, 4).when(off > 0.25, 3).when(off > 0.1, 2).otherwise(1)
    worst = F.max(level)
    names = F.element_at(F.array(*[F.lit(x) for x in ("none", "low", "medium", "high", "critical")]), worst + 1)
    ratio = F.count_if(met) / F.count("*")
    return df.groupBy(*key).agg(F.count("*").alias("checks"), F.count_if(met).alias("met"), F.round(ratio, 6).alias("compliance"), names.alias("worst"), (ratio >= 0.99).alias("ok"))


def uptime(df: DataFrame, key: list[str], up: Column, order: list[str]) -> DataFrame:
    """Uptime share, incidents (runs of failed checks) and status tier of each key."""
    down = scans.incidents(df, key, order, ~up)
    share = F.count_if(up) / F.count("*")
    tier = F.when(F.col("uptime") >= 0.999, "operational").when(F.col("uptime") >= 0.95, "degraded").otherwise("down")
    shares = df.groupBy(*key).agg(F.count("*").alias("checks"), F.round(share, 6).alias("uptime"))
    return scans.joined(shares, down, key).withColumn("status", tier)


def burn_rate(df: DataFrame, key: list[str], good: Column, objective: float) -> DataFrame:
    """Availability, error budget used and burn rate against an objective."""
    share = F.count_if(good) / F.count("*")
    return df.groupBy(*key).agg(F.count("*").alias("requests"), F.round(share, 6).alias("availability")).withColumn("burn_rate", F.round((1 - F.col("availability")) / (1 - objective), 6)).withColumn("met", F.col("availability") >= objective)


def bursts(df: DataFrame, key: list[str], order: list[str], limited: Column, least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive limited rows of a key: length, ends, and whether the run reaches the key's last row."""
    runs = scans.runs(df, key, order, limited).where(F.col("length") >= least)
    return runs.select(*key, "length", F.col(f"first.{order[0]}").alias("first_ts"), F.col(f"last.{order[0]}").alias("last_ts"), "open")


def state_changes(df: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the key's previous row."""
    return scans.Scan(df, key, order).previous(F.col(state), "previous").where(~F.col("previous").eqNullSafe(F.col(state))).drop("_slice")


def failure_risk(df: DataFrame, key: list[str], order: list[str], failed: Column) -> DataFrame:
    """key, streak, rate, risk: half of the share of failures, 0.3 for a streak of three failures at the end, 0.2 if the last failure is less than an hour old."""
    ts = order[0]
    streaks = scans.trailing(df, key, order, failed)
    s = df.groupBy(*key).agg((F.count_if(~failed) / F.count("*")).alias("rate"), F.max(F.when(failed, F.col(ts))).alias("last_failure"), F.max(ts).alias("last_seen"))
    s = scans.joined(s, streaks, key)
    recent = F.when(micros("last_seen") - micros("last_failure") < 3_600_000_000, 1.0).otherwise(0.0)
    return s.select(*key, "streak", F.round("rate", 6).alias("rate"), F.round(0.5 * (1 - F.col("rate")) + 0.3 * F.least(F.lit(1.0), F.col("streak") / 3.0) + 0.2 * recent, 6).alias("risk"))
