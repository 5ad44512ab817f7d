"""Behavioural analytics: funnels, cohorts, retention, engagement, click labels, interests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions.times import micros
from lumenforge.operators.sessions import newest


def funnel(df: DataFrame, user: str, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, name, users, conversion from the step before, drop-off and overall conversion. Steps are unordered in time; a step after an empty one converts fully."""
    row = df.agg(*[F.countDistinct(F.when(c, F.col(user))).alias(f"s{k}") for k, (_, c) in enumerate(steps)])
    lines = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("step"), F.lit(n).alias("name"), F.col(f"s{k}").alias("users"), (F.col(f"s{k - 1}") if k else F.col("s0")).alias("before"), F.col("s0").alias("entered")) for k, (n, _) in enumerate(steps)])
    x = row.select(F.explode(lines).alias("x")).select("x.*")
    rate = F.when(F.col("before") == 0, 1.0).otherwise(F.col("users") / F.col("before"))
    total = F.when(F.col("entered") == 0, 0.0).otherwise(F.col("users") / F.col("entered"))
    return x.select("step", "name", "users", F.round(rate, 6).alias("conversion"), F.round(1 - rate, 6).alias("drop_off"), F.round(total, 6).alias("overall"))


def cohort_retention(df: DataFrame, user: str, ts: str, days: int, periods: int = 12) -> DataFrame:
    """cohort (period of the first event), period 0..periods-1, active users, cohort size and retention."""
    number = F.floor(F.unix_timestamp(ts) / (86400 * days)).cast("long")
    seen = df.select(F.col(user).alias("u"), number.alias("p")).distinct()
    first = seen.groupBy("u").agg(F.min("p").alias("cohort"))
    sizes = first.groupBy("cohort").agg(F.count("*").alias("size"))
    active = seen.join(first, "u").withColumn("period", F.col("p") - F.col("cohort")).where(F.col("period") < periods).groupBy("cohort", "period").agg(F.count("*").alias("active"))
    grid = sizes.select("cohort", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long"))).alias("period"))
    out = grid.join(active, ["cohort", "period"], "left").withColumn("active", F.coalesce("active", F.lit(0)).cast("long"))
    return out.withColumn("retention", F.round(F.col("active") / F.col("size"), 6))


def active_users(df: DataFrame, user: str, ts: str, as_of: Column) -> DataFrame:
    def within(days: int) -> Column:
        return F.countDistinct(F.when((F.col(ts) > as_of - F.expr(f"interval {days} days")) & (F.col(ts) <= as_of), F.col(user)))

    return df.agg(within(1).alias("dau"), within(7).alias("wau"), within(30).alias("mau"))


def engagement(df: DataFrame, session: list[str], ts: str) -> DataFrame:
    """Sessions, average duration and events, bounce rate (sessions of one event)."""
    s = df.groupBy(*session).agg(F.count("*").alias("n"), ((micros(F.max(ts)) - micros(F.min(ts))) / 1e6).alias("seconds"))
    return s.agg(F.count("*").alias("sessions"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(F.avg("n"), 6).alias("avg_events"), F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("bounce_rate"))


def retained(df: DataFrame, user: str, ts: str, cutoff: Column) -> DataFrame:
    """Users seen before the cutoff and those of them who are seen after it."""
    flags = df.groupBy(user).agg(F.bool_or(F.col(ts) < cutoff).alias("before"), F.bool_or(F.col(ts) >= cutoff).alias("after")).where("before")
    return flags.agg(F.count("*").alias("users"), F.count_if("after").alias("retained"), F.round(F.count_if("after") / F.count("*"), 6).alias("retention"))


def click_labels(shown: DataFrame, clicks: DataFrame, hours: int = 24, carried: list[str] | None = None) -> DataFrame:
    """Label of each shown result: 1 if the same user (null equals null) clicks that URL for that query within `hours`, ends included.
    carried: further columns of the shown results, handed on.

    The time range becomes an equi-join on day buckets: a click can only follow an impression of its own day or of the days
    before it, so a pair of hot keys meets only inside its days.
    """
    day = 86_400_000_000
    spread = -(-hours // 24)
    c = clicks.select(F.col("user_id").alias("c_user"), F.col("query").alias("c_query"), F.col("url").alias("c_url"), micros("ts").alias("c_ts"))
    c = c.withColumn("c_day", F.explode(F.sequence(F.floor(F.col("c_ts") / day) - spread, F.floor(F.col("c_ts") / day)))).dropDuplicates()
    s = shown.withColumn("_us", micros("ts")).withColumn("_day", F.floor(F.col("_us") / day))
    hit = F.col("user_id").eqNullSafe(F.col("c_user")) & (F.col("query") == F.col("c_query")) & (F.col("url") == F.col("c_url")) & (F.col("_day") == F.col("c_day")) & (F.col("c_ts") >= F.col("_us")) & (F.col("c_ts") <= F.col("_us") + hours * 3_600_000_000)
    labelled = s.join(c, hit, "left")
    return labelled.groupBy("impression_id", "url", "position", *(carried or [])).agg(F.max(F.when(F.col("c_ts").isNotNull(), 1).otherwise(0)).cast("long").alias("label"))


def popular(df: DataFrame, key: str, ts: str, latency_ms: Column, as_of: Column, least: int, limit: int) -> DataFrame:
    """Impressions x exp(-hours/24) x min(2, latency/2000) of each item with at least `least` impressions."""
    g = df.groupBy(key).agg(F.count("*").alias("impressions"), F.max(ts).alias("last"), F.avg(latency_ms).alias("latency"))
    hours = (micros(as_of) - micros("last")) / 3.6e9
    score = F.col("impressions") * F.exp(-hours / 24) * F.least(F.lit(2.0), F.col("latency") / 2000)
    return g.where(F.col("impressions") >= least).select(key, "impressions", F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def top_values(df: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
    """key, name: the n most frequent values as a comma list, ties by value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    best = newest(counts, [key], [F.desc("_n"), value], n)
    return best.groupBy(key).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(value).cast("string").alias("v")))), lambda x: x["v"])).alias(name))


def decayed_interest(df: DataFrame, key: list[str], ts: str, weight: Column, as_of: Column, keep: float = 0.95) -> DataFrame:
    """Sum of weight x keep^days, capped at 1."""
    days = (micros(as_of) - micros(ts)) / 8.64e10
    return df.groupBy(*key).agg(F.round(F.least(F.lit(1.0), F.sum(weight * F.pow(F.lit(keep), days))), 6).alias("affinity"))


def intent_changes(df: DataFrame, session: list[str], order: list[str], intent: str) -> DataFrame:
    """Per session: events, changes of intent from one event to the next, and the last five intents in order."""
    by = Window.partitionBy(*session).orderBy(*order)
    marked = df.withColumn("_change", F.when(F.lag(intent).over(by) != F.col(intent), 1).otherwise(0)).withColumn("_back", F.row_number().over(Window.partitionBy(*session).orderBy(*[F.desc(c) for c in order])))
    tail = F.transform(F.sort_array(F.collect_list(F.when(F.col("_back") <= 5, F.struct((-F.col("_back")).alias("b"), F.col(intent).alias("v"))))), lambda x: x["v"])
    return marked.groupBy(*session).agg(F.count("*").alias("events"), F.sum("_change").cast("long").alias("changes"), F.concat_ws(">", tail).alias("recent"))
