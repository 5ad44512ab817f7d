"""Streaming queries: the same results as a batch over the same events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X
from lumenforge.operators import text_tables as T
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry
from lumenforge.sources.storage import shared_dir
from lumenforge.streaming import jobs as J

query = Registry()


def backend():
    return F.concat(F.lit("b"), (V.shard() % 4).cast("string"))


R = f"WITH {V.SQL_REQUESTS} "


@query(R + "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, backend, count(*) AS requests, count(*) FILTER (outcome = 'error') AS errors FROM requests GROUP BY 1, 2")
def st1_tumbling(spark, sf_dir):
    return J.drained(J.tumbling(J.events(spark, sf_dir).withColumn("backend", backend()), "5 minutes", ["backend"]), "complete", "st1")


@query("SELECT time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * n) AS bucket, count(*) AS requests FROM events, range(6) t(n) GROUP BY 1")
def st2_sliding(spark, sf_dir):
    return J.drained(J.sliding(J.events(spark, sf_dir), "60 seconds", "10 seconds", []), "complete", "st2")


@query(f"WITH {V.SQL_SESSIONS} SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM product_events GROUP BY user_id, session_no")
def st3_sessions(spark, sf_dir):
    return J.drained(J.sessions(J.events(spark, sf_dir)), "complete", "st3")


@query(f"WITH {V.SQL_IMPRESSIONS}, {V.SQL_CLICKS} SELECT impression_id, click_id FROM impressions i JOIN clicks c ON c.user_id = i.user_id AND c.query = i.query AND c.ts >= i.ts AND c.ts <= i.ts + INTERVAL 24 HOUR")
def st4_click_join(spark, sf_dir):
    e = J.events(spark, sf_dir)
    asked = F.concat(F.lit("q"), (V.shard() % 20).cast("string")).alias("query")
    shown = e.where("event_type = 'view'").select(F.col("event_id").alias("impression_id"), "user_id", asked, "ts")
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", asked, "ts")
    return J.drained(J.clicked(shown, clicks), "append", "st4")


LATE = "event_id % 50 = 7"


@query(f"SELECT DISTINCT user_id, coalesce(regexp_extract(props, '([0-9]+)', 1)::BIGINT, 0) AS k FROM events")
def st5_first_seen(spark, sf_dir):
    """First row of each user and key; repeats come in later batches, and some rows late. The memory spans the table."""
    e = J.events(spark, sf_dir, F.expr(LATE)).withColumn("k", V.shard())
    return J.drained(J.first_seen(e, ["user_id", "k"], "400 days").select("user_id", "k"), "append", "st5")


@query("""WITH e AS (SELECT ts, event_id, value, event_type, 'b' || (coalesce(regexp_extract(props, '([0-9]+)', 1)::BIGINT, 0) % 4)::VARCHAR AS backend FROM events),
g AS (SELECT backend, list(value / 100 ORDER BY ts, event_id) AS l, list((event_type = 'error')::INT ORDER BY ts, event_id) AS f FROM e GROUP BY 1)
SELECT backend, round(list_reduce(list_prepend(0.5::DOUBLE, l), lambda a, x: 0.8 * a + 0.2 * x), 6) AS latency, round(list_reduce(list_prepend(1.0::DOUBLE, f::DOUBLE[]), lambda a, x: 0.9 * a + 0.1 * (1 - x)), 6) AS success, list_reduce(list_prepend(0::BIGINT, f::BIGINT[]), lambda a, x: CASE WHEN x = 1 THEN a + 1 ELSE 0 END) AS streak FROM g""")
def st6_health_state(spark, sf_dir):
    """State of each backend after the last of several batches."""
    e = J.events(spark, sf_dir).select("event_id", "ts", "value", "event_type", backend().alias("backend"))
    return J.drained(J.health(e, "backend"), "update", "st6", key=["backend"])


@query("""WITH m AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'delete' WHEN page_id % 5 = 0 THEN 'reindex' ELSE 'index' END AS op FROM pages) SELECT page_id, op, CASE WHEN op = 'index' THEN 1 ELSE 2 END::BIGINT AS version FROM m""")
def st7_indexing(spark, sf_dir):
    """Index messages of all pages in four batches, then reindex and delete messages for some: the last state of each page."""
    pages = V.table(spark, sf_dir, "pages")
    again = F.when(F.col("page_id") % 7 == 0, "delete").when(F.col("page_id") % 5 == 0, "reindex")
    first = pages.withColumn("op", F.lit("index")).withColumn("second", F.lit(False))
    told = first.unionByName(pages.withColumn("op", again).where("op IS NOT NULL").withColumn("second", F.lit(True)))
    folder = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
    told.write.parquet(f"{folder}/messages.parquet")

    def built(rows):
        text = rows.select("page_id", X.page_text(F.col("html")).alias("text"))
        chunks = T.chunks(text, "page_id", "text").groupBy("page_id").agg(F.count("*").alias("chunks"))
        return text.select("page_id", F.sha2("text", 256).alias("content_hash")).join(chunks, "page_id", "left")

    stream = J.stream_of(spark, folder, "messages", late=F.col("second"), file_rows=4000)
    out = J.drained(stream, "append", "st7", lambda b, n, past: J.messages(b, past, "page_id", "op", built).withColumn("batch_no", F.lit(n)))
    last = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("version")))
    return out.withColumn("n", last).where("n = 1").select("page_id", "op", "version")


@query("""SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * n) AS bucket, count(*) AS requests FROM events, range(6) t(n) GROUP BY 1, 2 HAVING count(*) > 2""")
def st8_rate_violations(spark, sf_dir):
    return J.drained(J.violations(J.events(spark, sf_dir), "user_id", 2), "complete", "st8")


@query("SELECT date_trunc('day', ts) AS bucket, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def st9_variant_counters(spark, sf_dir):
    e = J.events(spark, sf_dir).withColumn("variant", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment"))
    return J.drained(J.tumbling(e, "1 day", ["variant"]), "complete", "st9")


@query(f"""WITH n AS (SELECT max(ts) AS newest FROM events WHERE NOT ({LATE})) SELECT event_type, {LATE} AND ts < newest - INTERVAL 10 DAY AS late, count(*) AS n FROM events, n GROUP BY 1, 2""")
def st10_late_rows(spark, sf_dir):
    """Rows that come in a last batch, more than ten days behind the newest row of the earlier ones, counted by type."""
    out = J.drained(J.events(spark, sf_dir, F.expr(LATE)), "append", "st10", lambda b, n, past: J.routed(b, past, "ts", 10 * 86_400_000_000))
    return out.groupBy("event_type", "late").agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = query.queries, query.sql
