"""Index catalogue work: statistics, schedules, queues, upserts, change detection, domain lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X


def domain_stats(cat: DataFrame) -> DataFrame:
    return cat.groupBy("domain").agg(F.count("*").alias("documents"), F.sum("total_chunks").cast("long").alias("chunks"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.max("last_indexed").alias("last_indexed"), F.min("next_index_at").alias("next_due"))


def health(cat: DataFrame) -> DataFrame:
    """One row: counts by status, distinct domains, and degraded above 10% failures."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "stale", "failed", "pending")]
    return cat.agg(F.count("*").alias("documents"), *counts, F.countDistinct("domain").alias("domains"), F.sum("total_chunks").cast("long").alias("chunks"), (F.count_if(F.col("status") == "failed") / F.count("*") > 0.1).alias("degraded"))


def due(cat: DataFrame, as_of: Column) -> DataFrame:
    """Indexed or stale rows that are due, most urgent first, with the reason."""
    reason = F.when(F.col("status") == "stale", "stale").when(F.col("importance") >= 0.7, "important").otherwise("scheduled")
    return cat.where(F.col("status").isin("indexed", "stale") & (F.col("next_index_at") <= as_of)).withColumn("reason", reason).orderBy(F.desc("priority"), F.desc("importance"), "next_index_at", "id")


def next_jobs(cat: DataFrame, as_of: Column, n: int = 100) -> DataFrame:
    return cat.where((F.col("status") == "pending") & (F.col("next_index_at") <= as_of)).orderBy(F.desc("priority"), "next_index_at", "id").limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both tables, newest version of each key; on equal versions the new table's row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn", "_new")


def cascade_delete(tables: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: new, changed, unchanged or deleted by a SHA-256 of the content."""
    a = old.select(key, F.sha2(content, 256).alias("_a"))
    b = new.select(key, F.sha2(content, 256).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def importance(length: Column, title: Column, age_days: Column, authority: Column) -> Column:
    """Importance in [0, 1] from length tiers, title words, recency and authority."""
    size = F.when(length > 5000, 0.3).when(length > 2000, 0.2).when(length > 500, 0.1).otherwise(0.0)
    words = F.when(F.lower(title).rlike("guide|tutorial|reference|documentation|official"), 0.2).otherwise(0.0)
    fresh = F.when(age_days < 7, 0.2).when(age_days < 30, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), 0.1 + size + words + fresh + 0.3 * authority)


def by_suffix(df: DataFrame, host: str, listed: DataFrame, domain: str, how: str) -> DataFrame:
    """Semi or anti join of hosts on label suffixes: x.com matches a.x.com and not ax.com. Suffixes make it an equi-join."""
    keyed = df.withColumn("_id", F.xxhash64(host))
    hits = df.select(F.col(host).alias("_host")).distinct().select("_host", F.explode(X.suffixes(F.col("_host"))).alias("_suffix")).join(listed.select(F.col(domain).alias("_suffix")).distinct(), "_suffix").select("_host").distinct()
    return df.join(hits, F.col(host) == F.col("_host"), "left_semi" if how == "semi" else "left_anti")


def longest_suffix(df: DataFrame, host: str, table: DataFrame, domain: str, weight: str) -> DataFrame:
    """df with the weight of the longest listed suffix of its host (null if none)."""
    hits = df.select(F.col(host).alias("_host")).distinct().select("_host", F.explode(X.suffixes(F.col("_host"))).alias("_suffix")).join(table.select(F.col(domain).alias("_suffix"), F.col(weight).alias("_w")), "_suffix")
    best = hits.groupBy("_host").agg(F.max_by("_w", F.char_length("_suffix")).alias(weight))
    return df.join(best, F.col(host) == F.col("_host"), "left").drop("_host")


def active(listed: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    return listed.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def metadata_filter(df: DataFrame, as_of: Column, language: str | None = None, topic: str | None = None, domain: str | None = None, newer_than_days: int | None = None, since: Column | None = None, until: Column | None = None, score: Column | None = None, min_score: float | None = None) -> DataFrame:
    """Rows that pass every filter that is given; rows without content never do. Filters run before any top-k."""
    tests = [F.col("n_chars") > 0]
    if language is not None:
        tests.append(F.col("language") == language)
    if topic is not None:
        tests.append(F.contains(F.lower("title"), F.lit(topic.lower())))
    if domain is not None:
        tests.append(F.col("domain") == domain)
    if newer_than_days is not None:
        tests.append(F.col("last_indexed") >= as_of - F.expr(f"interval {newer_than_days} days"))
    if since is not None:
        tests.append(F.col("last_indexed") >= since)
    if until is not None:
        tests.append(F.col("last_indexed") <= until)
    if min_score is not None and score is not None:
        tests.append(score >= min_score)
    return df.where(reduce(lambda a, b: a & b, tests))


def context_weights(df: DataFrame, host: str, contexts: Column, tables: DataFrame) -> DataFrame:
    """df with weight: the sum, over the tables of a row's contexts (array), of the weight of the longest listed suffix of its
    host. tables: context, domain, weight (bonus or penalty). Suffixes make it an equi-join over distinct hosts and contexts."""
    asked = df.select(F.col(host).alias("_host"), F.explode(contexts).alias("_context")).distinct()
    hits = asked.select("_host", "_context", F.explode(X.suffixes(F.col("_host"))).alias("_suffix")).join(tables.select(F.col("context").alias("_context"), F.col("domain").alias("_suffix"), "weight"), ["_context", "_suffix"])
    best = hits.groupBy("_host", "_context").agg(F.max_by("weight", F.char_length("_suffix")).alias("weight"))
    keyed = df.withColumn("_row", F.array_join(F.array_sort(contexts), ","))
    named = keyed.select(F.col(host).alias("_host"), "_row", F.explode(contexts).alias("_context")).distinct().join(best, ["_host", "_context"]).groupBy("_host", "_row").agg(F.sum("weight").alias("weight"))
    return keyed.withColumn("_host", F.col(host)).join(named, ["_host", "_row"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_host", "_row")


def page_slice(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Rows of one page (from 1) in a total order, with total and total_pages."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def resolved(url: Column, href: Column) -> Column:
    """Absolute form of a link on a page: against its scheme, host or folder, with ./ and ../ removed from the path; null for other schemes."""
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    full = F.when(href.startswith("//"), F.concat(F.regexp_extract(url, "^(https?:)", 1), href)).when(href.startswith("/"), F.concat(host, href)).when(href.startswith("?"), F.concat(host, path, href)).otherwise(F.concat(host, folder, href))
    absolute = F.when(href.rlike("(?i)^https?://"), href).when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None).otherwise(full)
    own = F.regexp_extract(absolute, r"^(https?://[^/?#]+)", 1)
    steps = F.split(F.regexp_extract(absolute, r"^https?://[^/?#]+/([^?#]*)", 1), "/")
    last = F.element_at(steps, -1)
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    tidy = F.concat(own, F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/"), F.regexp_extract(absolute, r"^[^?#]*(\?.*)$", 1))
    return F.when(F.array_contains(steps, ".") | F.array_contains(steps, ".."), tidy).otherwise(absolute)


def links(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """(page, dst): distinct absolute http(s) links; relative ones are resolved against the page, assets and fragments are dropped."""
    raw = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*href="([^"#]+)'), 1))).alias("href")
    x = pages.select(page, F.col(url).alias("_url"), raw).select(page, resolved(F.col("_url"), F.col("href")).alias("dst"))
    return x.where(F.col("dst").isNotNull() & ~F.col("dst").rlike(r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|pdf|zip|mp4)(\?|$)")).distinct()


def robots_rules(dumps: DataFrame, domain: str, body: str) -> DataFrame:
    """(domain, prefix, delay) of the rules for every agent (*), from robots.txt bodies."""
    lines = dumps.select(domain, F.posexplode(F.split(body, r"\r?\n")).alias("n", "line"))
    field = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_extract("line", r"^[^:]*:\s*([^#]*)", 1))
    by = Window.partitionBy(domain).orderBy("n")
    agents = lines.select(domain, "n", field.alias("field"), value.alias("value")).withColumn("agent", F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(by)).where("agent = '*'")
    delay = agents.where("field = 'crawl-delay'").groupBy(domain).agg(F.max(F.col("value").try_cast("double")).alias("delay"))
    return agents.where("field = 'disallow' AND value <> ''").select(domain, F.col("value").alias("prefix")).distinct().join(delay, domain, "left")


def allowed(urls: DataFrame, url: str, domain: str, rules: DataFrame) -> DataFrame:
    """Rows whose path begins with no disallowed prefix of their domain."""
    path = F.concat(F.lit("/"), F.regexp_extract(F.col(url), r"^https?://[^/]+/?([^#]*)", 1))
    r = rules.select(F.col(domain).alias("_d"), "prefix")
    return urls.withColumn("_path", path).join(r, (F.col(domain) == F.col("_d")) & F.startswith("_path", "prefix"), "left_anti").drop("_path")


def frontier(seeds: DataFrame, edges: DataFrame, visited: DataFrame, per_seed: int, total: int) -> DataFrame:
    """One hop from the seeds: links to unvisited URLs of the same domain, at most per_seed for each seed and `total` at all."""
    e = edges.join(seeds.select(F.col("url").alias("src"), F.col("domain").alias("src_domain")), "src")
    fresh = e.where(X.domain(F.col("dst")) == F.col("src_domain")).join(visited.select(F.col("url").alias("dst")), "dst", "left_anti")
    by = Window.partitionBy("src").orderBy("dst")
    return fresh.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= per_seed).select("src", "dst").orderBy("src", "dst").limit(total)
