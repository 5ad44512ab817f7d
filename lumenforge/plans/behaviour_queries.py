"""Queries over user behaviour."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions.times import micros
from lumenforge.operators import behaviour as B
from lumenforge.operators import retention
from lumenforge.operators.sessions import newest
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry
from lumenforge.sources.storage import shared_dir

query = Registry()
AS_OF = f"TIMESTAMP '{V.AS_OF}'"
S = f"WITH {V.SQL_SESSIONS} "


@query("""WITH r AS (SELECT count(DISTINCT user_id) FILTER (event_type = 'view') AS a, count(DISTINCT user_id) FILTER (event_type = 'click') AS b, count(DISTINCT user_id) FILTER (event_type = 'purchase' AND value > 50) AS c FROM events),
x AS (SELECT 1::BIGINT AS step, 'view' AS name, a AS users, a AS before, a AS entered FROM r UNION ALL SELECT 2, 'click', b, a, a FROM r UNION ALL SELECT 3, 'big purchase', c, b, a FROM r)
SELECT step, name, users, round(CASE WHEN before = 0 THEN 1.0 ELSE users / before END, 6) AS conversion, round(1 - CASE WHEN before = 0 THEN 1.0 ELSE users / before END, 6) AS drop_off, round(CASE WHEN entered = 0 THEN 0.0 ELSE users / entered END, 6) AS overall FROM x""")
def a25_funnel(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return B.funnel(e, "user_id", [("view", kind == "view"), ("click", kind == "click"), ("big purchase", (kind == "purchase") & (F.col("value") > 50))])


@query("""WITH s AS (SELECT DISTINCT user_id AS u, epoch_us(ts) // 604800000000 AS p FROM events), f AS (SELECT u, min(p) AS cohort FROM s GROUP BY 1), z AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1),
a AS (SELECT cohort, p - cohort AS period, count(*) AS active FROM s JOIN f USING (u) WHERE p - cohort < 12 GROUP BY 1, 2)
SELECT z.cohort, g.period, z.size, coalesce(a.active, 0)::BIGINT AS active, round(coalesce(a.active, 0) / z.size, 6) AS retention FROM z CROSS JOIN (SELECT range AS period FROM range(12)) g LEFT JOIN a ON a.cohort = z.cohort AND a.period = g.period""")
def a26_cohort_retention(spark, sf_dir):
    return B.cohort_retention(V.table(spark, sf_dir, "events"), "user_id", "ts", 7)


@query(f"SELECT count(DISTINCT user_id) FILTER (ts > {AS_OF} - INTERVAL 1 DAY AND ts <= {AS_OF}) AS dau, count(DISTINCT user_id) FILTER (ts > {AS_OF} - INTERVAL 7 DAY AND ts <= {AS_OF}) AS wau, count(DISTINCT user_id) FILTER (ts > {AS_OF} - INTERVAL 30 DAY AND ts <= {AS_OF}) AS mau FROM events")
def a27_active_users(spark, sf_dir):
    return B.active_users(V.table(spark, sf_dir, "events"), "user_id", "ts", V.as_of())


@query(S + """, s AS (SELECT user_id, session_no, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM product_events GROUP BY 1, 2)
SELECT count(*) AS sessions, round(avg(seconds), 6) AS avg_seconds, round(avg(n), 6) AS avg_events, round(count(*) FILTER (n = 1) / count(*), 6) AS bounce_rate FROM s""")
def a28_engagement(spark, sf_dir):
    return B.engagement(V.product_events(spark, sf_dir), ["user_id", "session_no"], "ts")


@query("SELECT count(*) FILTER (event_type = 'purchase') AS conversions, count(*) FILTER (event_type = 'view') AS views, round(count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'view'), 6) AS rate FROM events")
def a29_conversions(spark, sf_dir):
    bought, seen = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")
    return V.table(spark, sf_dir, "events").agg(bought.alias("conversions"), seen.alias("views"), F.round(bought / seen, 6).alias("rate"))


@query("""WITH f AS (SELECT user_id, bool_or(ts < TIMESTAMP '2024-01-15') AS b, bool_or(ts >= TIMESTAMP '2024-01-15') AS a FROM events GROUP BY 1)
SELECT count(*) AS users, count(*) FILTER (a) AS retained, round(count(*) FILTER (a) / count(*), 6) AS retention FROM f WHERE b""")
def a30_retained(spark, sf_dir):
    return B.retained(V.table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query(f"""WITH {V.SQL_IMPRESSIONS}, {V.SQL_CLICKS} SELECT (SELECT count(*) FROM impressions) AS impressions, (SELECT count(*) FROM clicks) AS clicks, round((SELECT count(*) FROM clicks) / (SELECT count(*) FROM impressions), 6) AS ctr,
(SELECT string_agg(url, ',' ORDER BY n DESC, url) FROM (SELECT url, count(*) AS n FROM clicks GROUP BY 1 ORDER BY n DESC, url LIMIT 10)) AS top_urls""")
def a6_ctr_report(spark, sf_dir):
    shown, clicked = V.impressions(spark, sf_dir), V.clicks(spark, sf_dir)
    top = clicked.groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(10)
    names = top.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "url"))), lambda x: x["url"])).alias("top_urls"))
    totals = shown.agg(F.count("*").alias("impressions")).crossJoin(clicked.agg(F.count("*").alias("clicks")))
    return totals.withColumn("ctr", F.round(F.col("clicks") / F.col("impressions"), 6)).crossJoin(names)


@query(f"""WITH {V.SQL_IMPRESSIONS} , g AS (SELECT query, count(*) AS impressions, max(ts) AS last, avg(value * 50) AS latency FROM impressions GROUP BY 1)
SELECT query, impressions, round(impressions * exp(-((epoch_us({AS_OF}) - epoch_us(last)) / 3.6e9) / 24) * least(2.0, latency / 2000), 6) AS score FROM g WHERE impressions >= 3 ORDER BY score DESC, query LIMIT 10""")
def a35_popular_queries(spark, sf_dir):
    return B.popular(V.impressions(spark, sf_dir), "query", "ts", F.col("value") * 50, V.as_of(), 3, 10)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c),
h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS rn FROM h)
SELECT user_id, (SELECT string_agg(event_type, ',' ORDER BY n DESC, event_type) FROM t WHERE rn <= 3 AND t.user_id = u.user_id) AS topics, (SELECT string_agg(h::VARCHAR, ',' ORDER BY n DESC, h::VARCHAR) FROM p WHERE rn <= 3 AND p.user_id = u.user_id) AS peak_hours FROM (SELECT DISTINCT user_id FROM events) u""")
def a36_interests(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("h", F.hour("ts"))
    return B.top_values(e, "user_id", "event_type", 3, "topics").join(B.top_values(e, "user_id", "h", 3, "peak_hours"), "user_id")


@query(S + f""", s AS (SELECT user_id, session_no, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, max(ts) AS last FROM product_events GROUP BY 1, 2)
SELECT count(*) AS sessions, count(*) FILTER (last > {AS_OF} - INTERVAL 30 MINUTE) AS active, round(avg(seconds), 6) AS avg_seconds, round(avg(n), 6) AS avg_queries FROM s""")
def a37_session_stats(spark, sf_dir):
    s = V.product_events(spark, sf_dir).groupBy("user_id", "session_no").agg(F.count("*").alias("n"), ((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6).alias("seconds"), F.max("ts").alias("last"))
    return s.agg(F.count("*").alias("sessions"), F.count_if(F.col("last") > V.as_of() - F.expr("interval 30 minutes")).alias("active"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(F.avg("n"), 6).alias("avg_queries"))


@query(f"""WITH {V.SQL_IMPRESSIONS}, {V.SQL_CLICKS}, i AS (SELECT date_trunc('day', ts) AS day, count(*) AS impressions FROM impressions GROUP BY 1), c AS (SELECT date_trunc('day', ts) AS day, count(*) AS clicks FROM clicks GROUP BY 1)
SELECT day, impressions, coalesce(clicks, 0)::BIGINT AS clicks, round(coalesce(clicks, 0) / impressions, 6) AS ctr, coalesce(clicks, 0) / impressions < 0.5 AS alert FROM i LEFT JOIN c USING (day)""")
def a47_quality_monitor(spark, sf_dir):
    i = V.impressions(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("impressions"))
    c = V.clicks(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("clicks"))
    ctr = F.col("clicks") / F.col("impressions")
    return i.join(c, "day", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)).cast("long")).select("day", "impressions", "clicks", F.round(ctr, 6).alias("ctr"), (ctr < 0.5).alias("alert"))


@query(f"""WITH {V.SQL_IMPRESSIONS}, {V.SQL_CLICKS} SELECT s.impression_id, s.url, s.position::INT AS position, max(CASE WHEN c.click_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS label FROM shown s
LEFT JOIN clicks c ON c.user_id IS NOT DISTINCT FROM s.user_id AND c.query = s.query AND c.url = s.url AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL 24 HOUR GROUP BY 1, 2, 3""")
def j3_click_labels(spark, sf_dir):
    shown = V.impressions(spark, sf_dir).select("impression_id", "user_id", "query", "ts", F.explode("results").alias("r")).select("impression_id", "user_id", "query", "ts", "r.url", "r.position")
    return B.click_labels(shown, V.clicks(spark, sf_dir))


@query(f"""WITH {V.SQL_IMPRESSIONS}, {V.SQL_CLICKS} SELECT i.impression_id, count(c.click_id) AS clicks, coalesce(string_agg(c.position::VARCHAR, ',' ORDER BY c.position, c.click_id), '') AS positions
FROM impressions i LEFT JOIN clicks c ON c.user_id = i.user_id AND c.query = i.query GROUP BY 1""")
def j4_clicked_positions(spark, sf_dir):
    i = V.impressions(spark, sf_dir).select("impression_id", "user_id", "query")
    c = V.clicks(spark, sf_dir).select("user_id", "query", "position", "click_id")
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("click_id").isNotNull(), F.struct("position", "click_id")))), lambda x: x["position"].cast("string"))
    return i.join(c, ["user_id", "query"], "left").groupBy("impression_id").agg(F.count("click_id").alias("clicks"), F.concat_ws(",", listed).alias("positions"))


@query(S + "SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM product_events GROUP BY 1, 2")
def w9_sessions(spark, sf_dir):
    return V.product_events(spark, sf_dir).groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


@query(S + """, m AS (SELECT *, CASE WHEN lag(event_name) OVER w <> event_name THEN 1 ELSE 0 END AS change, row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts DESC, event_id DESC) AS back FROM product_events WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, event_id))
SELECT user_id, session_no, count(*) AS events, sum(change)::BIGINT AS changes, string_agg(event_name, '>' ORDER BY back DESC) FILTER (back <= 5) AS recent FROM m GROUP BY 1, 2""")
def w10_session_context(spark, sf_dir):
    return B.intent_changes(V.product_events(spark, sf_dir), ["user_id", "session_no"], ["ts", "event_id"], "event_name")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def w11_newest_per_user(spark, sf_dir):
    return newest(V.table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "user_id", "ts")


@query("""WITH k AS (SELECT regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, max(ts) AS last_used, count(*) AS uses FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY last_used, k) AS rn, count(*) OVER () AS total FROM k)
SELECT k, last_used, uses FROM n WHERE rn <= least(50, greatest(0, total - 10))""")
def w12_eviction_set(spark, sf_dir):
    keys = V.table(spark, sf_dir, "events").groupBy(V.shard().alias("k")).agg(F.max("ts").alias("last_used"), F.count("*").alias("uses"))
    total = keys.agg(F.least(F.lit(50), F.greatest(F.lit(0), F.count("*") - 10)).alias("over"))
    oldest = keys.orderBy("last_used", "k").limit(50)  # no more than 50 leave in one pass
    return oldest.withColumn("rn", F.row_number().over(Window.orderBy("last_used", "k"))).crossJoin(F.broadcast(total)).where("rn <= over").select("k", "last_used", "uses")


@query(f"""SELECT user_id, event_type, round(least(1.0, sum(value / 1000.0 * pow(0.95, (epoch_us({AS_OF}) - epoch_us(ts)) / 8.64e10))), 6) AS affinity FROM events GROUP BY 1, 2""")
def w16_interest_decay(spark, sf_dir):
    return B.decayed_interest(V.table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", F.col("value") / 1000.0, V.as_of())


@query(f"""WITH {V.SQL_IMPRESSIONS}, {V.SQL_CLICKS}, v AS (SELECT user_id, url, count(*) AS visits FROM clicks GROUP BY 1, 2), n AS (SELECT user_id, url, count(*) AS seen FROM shown GROUP BY 1, 2),
t AS (SELECT user_id, query, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS affinity FROM clicks GROUP BY 1, 2)
SELECT s.impression_id, s.url, round(s.score + least(0.1, 0.01 * coalesce(v.visits, 0) + 0.05 * least(1.0, coalesce(v.visits, 0) / n.seen)) + 0.05 * coalesce(t.affinity, 0), 6) AS personal_score
FROM shown s JOIN n ON n.user_id = s.user_id AND n.url = s.url LEFT JOIN v ON v.user_id = s.user_id AND v.url = s.url LEFT JOIN t ON t.user_id = s.user_id AND t.query = s.query""")
def w17_personal_rank(spark, sf_dir):
    """Scores raised by a user's visits to a result and its click rate, a tenth at most, and by the user's affinity to the topic (the
    share of the user's clicks that the query has)."""
    shown = V.impressions(spark, sf_dir).select("impression_id", "user_id", "query", F.explode("results").alias("r")).select("impression_id", "user_id", "query", "r.url", "r.score")
    clicks = V.clicks(spark, sf_dir)
    visits = clicks.groupBy("user_id", "url").agg(F.count("*").alias("visits"))
    seen = shown.groupBy("user_id", "url").agg(F.count("*").alias("seen"))
    topics = clicks.groupBy("user_id", "query").agg(F.count("*").alias("n")).withColumn("affinity", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).drop("n")
    x = shown.join(seen, ["user_id", "url"]).join(visits, ["user_id", "url"], "left").join(topics, ["user_id", "query"], "left")
    n = F.coalesce("visits", F.lit(0))
    boost = F.least(F.lit(0.1), 0.01 * n + 0.05 * F.least(F.lit(1.0), n / F.col("seen"))) + 0.05 * F.coalesce("affinity", F.lit(0.0))
    return x.select("impression_id", "url", F.round(F.col("score") + boost, 6).alias("personal_score"))


@query(f"""WITH {V.SQL_IMPRESSIONS}, h AS (SELECT user_id, query, count(*) AS n FROM impressions WHERE query LIKE 'q1%' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, query) AS place FROM h)
SELECT user_id, query, place FROM r WHERE place <= 10""")
def w18_suggestions(spark, sf_dir):
    h = V.impressions(spark, sf_dir).where(F.col("query").startswith("q1")).groupBy("user_id", "query").agg(F.count("*").alias("n"))
    by = Window.partitionBy("user_id").orderBy(F.desc("n"), "query")
    return h.withColumn("place", F.row_number().over(by).cast("long")).where("place <= 10").select("user_id", "query", "place")


@query("""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS asked, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS asker FROM conversations),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM t WHERE role = 'assistant' AND asker = 'user')
SELECT conv_id, back, turn, md5(asked) AS question, md5(text) AS answer FROM x WHERE back <= 3""")
def w19_last_exchanges(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = V.table(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(by)).withColumn("asker", F.lag("role").over(by)).where("role = 'assistant' AND asker = 'user'")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))).cast("long")
    return t.withColumn("back", back).where("back <= 3").select("conv_id", "back", "turn", F.md5("asked").alias("question"), F.md5("text").alias("answer"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 1 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def f8_event_selector(spark, sf_dir):
    t = F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return V.table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 1) & t).select("event_id", "user_id")


@query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def f9_audit_page(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(20).select("event_id", "event_type", "ts")


@query(f"""WITH {V.SQL_CATALOGUE}, rows AS (SELECT 'events' AS source, event_type AS kind, ts, ts < {AS_OF} - INTERVAL 14 DAY AS gone FROM events
UNION ALL SELECT 'schedule', status, last_indexed, status IN ('indexed', 'failed') AND last_indexed < {AS_OF} - INTERVAL 30 DAY FROM catalogue),
days AS (SELECT source, ts::DATE AS day FROM rows GROUP BY ALL HAVING bool_or(gone))
SELECT source, kind, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS removed, (SELECT count(*) FROM days d WHERE d.source = r.source) AS days_written FROM rows r GROUP BY source, kind""")
def f13_retention(spark, sf_dir):
    """Events older than two weeks and finished schedule rows older than thirty days leave tables that are partitioned by day: what
    each kind keeps, as read back, what it lost, and how many days were written anew or dropped."""
    two_weeks, month = V.as_of() - F.expr("interval 14 days"), V.as_of() - F.expr("interval 30 days")
    tables = [
        ("events", V.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "ts"), F.col("ts") < two_weeks),
        ("schedule", V.catalogue(spark, sf_dir).select(F.col("status").alias("kind"), F.col("last_indexed").alias("ts")), F.col("kind").isin("indexed", "failed") & (F.col("ts") < month)),
    ]
    out = None
    for name, rows, gone in tables:
        path = f"{shared_dir(spark)}/retained-{name}-{uuid.uuid4().hex}"
        retention.write_days(rows, path, F.col("ts"))
        days = retention.prune(spark, path, gone).agg(F.count("*").alias("days_written"))
        left = spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("kept"))
        before = rows.groupBy("kind").agg(F.count("*").alias("n"))
        part = before.join(left, "kind", "left").na.fill(0, ["kept"]).crossJoin(F.broadcast(days)).select(F.lit(name).alias("source"), "kind", "kept", (F.col("n") - F.col("kept")).alias("removed"), "days_written")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-15' INTERSECT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def d3_user_intersection(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15").cast("timestamp")
    return e.where(F.col("ts") < cut).select("user_id").intersect(e.where(F.col("ts") >= cut).select("user_id"))


@query(S + f""", v AS (SELECT user_id, k % 7 AS domain, count(*) AS visits FROM product_events GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY visits DESC, domain) AS rn FROM v WHERE visits >= 3)
SELECT e.event_id, round(least(1.0, e.value / 120.0 + CASE WHEN t.rn IS NULL THEN 0.0 ELSE 0.15 END), 6) AS boosted FROM product_events e LEFT JOIN t ON t.user_id = e.user_id AND t.domain = e.k % 7 AND t.rn <= 10""")
def j18_personal_boost(spark, sf_dir):
    e = V.product_events(spark, sf_dir).withColumn("domain", F.col("k") % 7)
    visits = e.groupBy("user_id", "domain").agg(F.count("*").alias("visits")).where("visits >= 3")
    known = newest(visits, ["user_id"], [F.desc("visits"), "domain"], 10).withColumn("boost", F.lit(0.15)).drop("visits")
    return e.join(known, ["user_id", "domain"], "left").select("event_id", F.round(F.least(F.lit(1.0), F.col("value") / 120.0 + F.coalesce("boost", F.lit(0.0))), 6).alias("boosted"))


QUERIES, ORACLE_SQL = query.queries, query.sql
