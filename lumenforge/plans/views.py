"""Relations that the queries use, derived by Spark from the given tables, each with its SQL form.

AS_OF is the reference time of every query that depends on "now".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions.times import micros

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def shard():
    """The number in an event's properties {"k": n}."""
    return F.get_json_object("props", "$.k").cast("long")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", F.concat(F.lit("b"), (shard() % 4).cast("string")).alias("backend"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("outcome"), (F.col("value") / 100.0).alias("latency_s"))


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a session id: a new session begins after 30 idle minutes."""
    from lumenforge.operators.sessions import sessionise

    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("event_name"), "value", shard().alias("k"))
    return sessionise(e, "user_id", "ts", "event_id")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One impression for each view: three results, variant by the parity of the user."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    k = shard()
    results = F.array(*[F.struct(F.concat(F.lit("u"), ((k * 3 + p) % 40).cast("string")).alias("url"), F.lit(p).alias("position"), (F.lit(1.0) / p).alias("score")) for p in (1, 2, 3)])
    return e.select(F.col("event_id").alias("impression_id"), "user_id", F.concat(F.lit("q"), (k % 20).cast("string")).alias("query"), "ts", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("variant"), results.alias("results"), "value")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    k = shard()
    return e.select(F.col("event_id").alias("click_id"), "user_id", F.concat(F.lit("q"), (k % 20).cast("string")).alias("query"), F.concat(F.lit("u"), ((k * 3 + 1 + F.col("event_id") % 3) % 40).cast("string")).alias("url"), (F.col("event_id") % 3 + 1).cast("int").alias("position"), "ts")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index catalogue rows from pages."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    return p.select(
        F.concat(F.lit("d"), i.cast("string")).alias("id"), "url", F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1), r"^www\.", "").alias("domain"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("language"), F.char_length("html").cast("long").alias("n_chars"),
        (F.floor(F.char_length("html") / 1200) + 1).cast("long").alias("total_chunks"), F.round((i % 100) / 100.0, 2).alias("importance"), (i * 7 % 10).cast("long").alias("priority"),
        F.element_at(F.array(*[F.lit(s) for s in ("indexed", "indexed", "stale", "failed", "pending")]), (i % 5 + 1).cast("int")).alias("status"),
        F.timestamp_micros(micros(as_of()) - (i * 37 % 90) * F.lit(86400000000)).alias("last_indexed"), F.timestamp_micros(micros(as_of()) + (i * 13 % 21 - 10) * F.lit(86400000000)).alias("next_index_at"),
    )


SQL_REQUESTS = """requests AS (SELECT event_id, ts, user_id, 'b' || (regexp_extract(props, '([0-9]+)', 1)::BIGINT % 4)::VARCHAR AS backend,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome, value / 100.0 AS latency_s FROM events)"""

SQL_SESSIONS = """pe0 AS (SELECT event_id, ts, user_id, event_type AS event_name, value, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k,
  CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
product_events AS (SELECT event_id, ts, user_id, event_name, value, k, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM pe0)"""

SQL_IMPRESSIONS = """imp0 AS (SELECT event_id AS impression_id, user_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, ts, value,
  CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant FROM events WHERE event_type = 'view'),
impressions AS (SELECT impression_id, user_id, 'q' || (k % 20)::VARCHAR AS query, ts, variant, value, k FROM imp0),
shown AS (SELECT impression_id, user_id, query, ts, variant, p AS position, 'u' || ((k * 3 + p) % 40)::VARCHAR AS url, 1.0 / p AS score FROM impressions, (VALUES (1), (2), (3)) v(p))"""

SQL_CLICKS = """clicks AS (SELECT event_id AS click_id, user_id, 'q' || (regexp_extract(props, '([0-9]+)', 1)::BIGINT % 20)::VARCHAR AS query,
  'u' || ((regexp_extract(props, '([0-9]+)', 1)::BIGINT * 3 + 1 + event_id % 3) % 40)::VARCHAR AS url, (event_id % 3 + 1)::INT AS position, ts FROM events WHERE event_type = 'click')"""

SQL_CATALOGUE = f"""catalogue AS (SELECT 'd' || page_id::VARCHAR AS id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS domain,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, length(html) AS n_chars,
  (length(html) // 1200 + 1)::BIGINT AS total_chunks, round((page_id % 100) / 100.0, 2) AS importance, page_id * 7 % 10 AS priority,
  ['indexed', 'indexed', 'stale', 'failed', 'pending'][page_id % 5 + 1] AS status,
  TIMESTAMP '{AS_OF}' - to_days((page_id * 37 % 90)::INT) AS last_indexed, TIMESTAMP '{AS_OF}' + to_days((page_id * 13 % 21 - 10)::INT) AS next_index_at FROM pages)"""


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key under a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
