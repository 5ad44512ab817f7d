"""Queries over the request log (events as requests)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.operators import metrics as M
from lumenforge.operators.quantiles import exact_quantiles, median
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry

query = Registry()
R = f"WITH {V.SQL_REQUESTS} "


def failed():
    return F.col("outcome") == "error"


@query(R + """SELECT backend, quantile_cont(latency_s, 0.5) AS p50, quantile_cont(latency_s, 0.95) AS p95, quantile_cont(latency_s, 0.99) AS p99, min(latency_s) AS least, max(latency_s) AS most FROM requests GROUP BY backend""")
def a8_interpolated_percentiles(spark, sf_dir):
    q = exact_quantiles(V.requests(spark, sf_dir), ["backend"], "latency_s", [0.5, 0.95, 0.99, 0.0, 1.0])
    return q.withColumnsRenamed({"q0": "p50", "q1": "p95", "q2": "p99", "q3": "least", "q4": "most"})


@query(R + """, n AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY ts DESC, event_id DESC) AS rn FROM requests)
SELECT backend, quantile_disc(latency_s, 0.95) AS p95, count(*) AS samples FROM n WHERE rn <= 100 GROUP BY backend""")
def a9_recent_percentile(spark, sf_dir):
    return M.nearest_rank(V.requests(spark, sf_dir), ["backend"], [F.desc("ts"), F.desc("event_id")], "latency_s", 0.95, 100)


@query()
def a10_approximate_quantiles(spark, sf_dir):
    r = V.requests(spark, sf_dir).where(F.col("ts") >= V.as_of() - F.expr("interval 7 days"))
    return r.groupBy("backend").agg(F.percentile_approx("latency_s", [0.5, 0.95, 0.99], 10000).alias("quantiles"), F.round(F.avg("latency_s"), 6).alias("avg_latency"))


@query(R + "SELECT date_trunc('minute', ts) AS minute, count(*) AS requests, count(DISTINCT backend) AS backends FROM requests GROUP BY 1")
def a11_requests_per_minute(spark, sf_dir):
    return V.requests(spark, sf_dir).groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests"), F.countDistinct("backend").alias("backends"))


@query(R + "SELECT backend, count(*) AS total, count(*) FILTER (outcome = 'error') AS errors, round(100.0 * count(*) FILTER (outcome = 'error') / count(*), 6) AS error_pct FROM requests GROUP BY backend")
def a12_error_rate(spark, sf_dir):
    return M.error_rate(V.requests(spark, sf_dir), ["backend"], failed())


@query(R + "SELECT backend, outcome, count(*) AS n, round(avg(latency_s), 6) AS avg_latency, min(latency_s) AS least, max(latency_s) AS most FROM requests GROUP BY 1, 2")
def a13_latency_by_outcome(spark, sf_dir):
    return V.requests(spark, sf_dir).groupBy("backend", "outcome").agg(F.count("*").alias("n"), F.round(F.avg("latency_s"), 6).alias("avg_latency"), F.min("latency_s").alias("least"), F.max("latency_s").alias("most"))


@query(R + "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, backend, count(*) AS requests, round(count(*) / 300.0, 6) AS per_second FROM requests GROUP BY 1, 2")
def a14_throughput(spark, sf_dir):
    out = M.per_interval(V.requests(spark, sf_dir), "ts", "5 minutes", ["backend"], [F.count("*").alias("requests")])
    return out.withColumn("per_second", F.round(F.col("requests") / 300.0, 6))


@query(R + "SELECT event_id, backend, outcome, latency_s FROM requests WHERE latency_s >= (SELECT quantile_cont(latency_s, 0.99) FROM requests) ORDER BY latency_s DESC, event_id LIMIT 100")
def a15_slowest_percent(spark, sf_dir):
    return M.slowest(V.requests(spark, sf_dir), "latency_s", 0.99, 100, "event_id").select("event_id", "backend", "outcome", "latency_s")


@query(R + "SELECT date_trunc('minute', ts) AS minute, count(*) AS slow, count(DISTINCT backend) AS backends FROM requests WHERE latency_s >= 2 GROUP BY 1")
def a16_slow_per_minute(spark, sf_dir):
    return V.requests(spark, sf_dir).where("latency_s >= 2").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("slow"), F.countDistinct("backend").alias("backends"))


@query(R + """, p AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, backend, count(*) AS requests, count(*) FILTER (outcome = 'error') AS errors,
  avg(latency_s) AS mean, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(quantile_cont(latency_s, 0.99), 6) AS p99 FROM requests GROUP BY 1, 2)
SELECT * EXCLUDE mean, round(mean, 6) AS avg_latency, round(errors / requests, 6) AS error_ratio, round(greatest(0.0, 1.0 - errors / requests - 0.5 * least(1.0, mean / 5.0)), 6) AS health FROM p""")
def a17_panel(spark, sf_dir):
    return M.panel(V.requests(spark, sf_dir), "ts", "6 hours", ["backend"], "latency_s", failed())


@query(R + """, d AS (SELECT user_id, backend, latency_s, row_number() OVER (PARTITION BY user_id, backend ORDER BY ts, event_id) AS rn FROM requests),
pairs AS (SELECT c.user_id, c.backend, c.latency_s AS cold, w.latency_s AS warm FROM d c JOIN d w ON c.user_id = w.user_id AND c.backend = w.backend WHERE c.rn = 1 AND w.rn = 2)
SELECT count(*) AS pairs, count(*) FILTER (warm < 0.2 AND warm < cold) AS hits, round(count(*) FILTER (warm < 0.2 AND warm < cold) / count(*), 6) AS hit_rate, round(avg(cold), 6) AS avg_cold, round(avg(warm), 6) AS avg_warm FROM pairs""")
def a19_cache_effect(spark, sf_dir):
    by = Window.partitionBy("user_id", "backend").orderBy("ts", "event_id")
    r = V.requests(spark, sf_dir).withColumn("rn", F.row_number().over(by)).where("rn <= 2")
    pairs = r.groupBy("user_id", "backend").agg(F.max(F.when(F.col("rn") == 1, F.col("latency_s"))).alias("cold"), F.max(F.when(F.col("rn") == 2, F.col("latency_s"))).alias("warm")).where("warm IS NOT NULL")
    return M.cache_effect(pairs, "user_id", "cold", "warm")


#: Price of a unit by service and operation.
PRICES = [("O", "N", 0.002), ("F", "N", 0.0015), ("F", "A", 0.01), ("F", "R", 0.0125)]


@query(f"""WITH p(service, operation, price) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DECIMAL(18,6))" for a, b, c in PRICES)}), u AS (SELECT l_linestatus AS service, l_returnflag AS operation, l_quantity::DECIMAL(18,4) AS units, l_shipdate AS ts FROM lineitem),
c AS (SELECT u.service, u.operation, units * coalesce(price, 0) AS cost, unnest([{{'span': 'day', 'w': strftime(ts, '%Y-%m-%d')}}, {{'span': 'month', 'w': strftime(ts, '%Y-%m')}}, {{'span': 'all', 'w': 'all'}}]) AS s FROM u LEFT JOIN p USING (service, operation)),
d AS (SELECT service, operation, cost, s.span AS span, s.w AS "window" FROM c)
SELECT span, "window", service, operation, count(*) AS calls, round(sum(cost)::DOUBLE, 4) AS cost, (grouping(service) * 2 + grouping(operation))::BIGINT AS level FROM d GROUP BY GROUPING SETS ((span, "window", service, operation), (span, "window", service), (span, "window"))""")
def a20_cost_rollup(spark, sf_dir):
    """Line items as usage: status is the service, return flag the operation, quantity the units."""
    l = V.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("service"), F.col("l_returnflag").alias("operation"), F.col("l_quantity").alias("units"), F.col("l_shipdate").alias("ts"))
    prices = spark.createDataFrame(PRICES, "service string, operation string, price double")
    return M.priced_usage(l, prices, "service", "operation", "units", "ts")


@query("""WITH w AS (SELECT 'day' AS span, strftime(o_orderdate, '%Y-%m-%d') AS "window", 3000000.0::DOUBLE AS lim, o_totalprice::DECIMAL(20,4) AS x FROM orders UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), 40000000.0, o_totalprice::DECIMAL(20,4) FROM orders),
s AS (SELECT span, "window", lim, sum(x)::DOUBLE AS spent FROM w GROUP BY 1, 2, 3)
SELECT span, "window", round(spent, 4) AS spent, round(spent / lim, 6) AS share, CASE WHEN spent / lim >= 0.95 THEN 'critical' WHEN spent / lim >= 0.8 THEN 'warning' ELSE 'ok' END AS status,
 CASE WHEN spent / lim >= 1 THEN 'stop or raise the limit' WHEN spent / lim >= 0.95 THEN 'defer what can wait' WHEN spent / lim >= 0.8 THEN 'use cheaper services' ELSE 'none' END AS advice FROM s""")
def a21_budget_status(spark, sf_dir):
    return M.budget_windows(V.table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", 3_000_000.0, 40_000_000.0)


@query(R + """, d AS (SELECT backend, date_trunc('day', ts) AS day, count(*) FILTER (outcome = 'error') / count(*) AS measured FROM requests GROUP BY 1, 2),
m AS (SELECT backend, measured <= 0.2 AS met, abs(measured - 0.2) / 0.2 AS off FROM d)
SELECT backend, count(*) AS checks, count(*) FILTER (met) AS met, round(count(*) FILTER (met) / count(*), 6) AS compliance,
 ['none', 'low', 'medium', 'high', 'critical'][max(CASE WHEN met THEN 0 WHEN off > 0.5 THEN 4 WHEN off > 0.25 THEN 3 WHEN off > 0.1 THEN 2 ELSE 1 END) + 1] AS worst,
 count(*) FILTER (met) / count(*) >= 0.99 AS ok FROM m GROUP BY backend""")
def a22_sla_compliance(spark, sf_dir):
    daily = V.requests(spark, sf_dir).groupBy("backend", F.date_trunc("day", "ts").alias("day")).agg((F.count_if(failed()) / F.count("*")).alias("measured")).withColumn("target", F.lit(0.2))
    return M.compliance(daily, ["backend"], "measured", "target", F.lit(True))


@query(R + """, n AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY backend ORDER BY ts, event_id) AS island FROM requests),
i AS (SELECT backend, count(DISTINCT island) AS incidents FROM n WHERE outcome = 'error' GROUP BY 1),
u AS (SELECT backend, count(*) AS checks, round(count(*) FILTER (outcome <> 'error') / count(*), 6) AS uptime FROM requests GROUP BY 1)
SELECT backend, checks, uptime, coalesce(incidents, 0)::BIGINT AS incidents, CASE WHEN uptime >= 0.999 THEN 'operational' WHEN uptime >= 0.95 THEN 'degraded' ELSE 'down' END AS status FROM u LEFT JOIN i USING (backend)""")
def a23_uptime(spark, sf_dir):
    return M.uptime(V.requests(spark, sf_dir), ["backend"], ~failed(), ["ts", "event_id"])


@query(R + """, a AS (SELECT backend, count(*) AS requests, round(count(*) FILTER (outcome <> 'error') / count(*), 6) AS availability FROM requests GROUP BY 1)
SELECT *, round((1 - availability) / (1 - 0.999), 6) AS burn_rate, availability >= 0.999 AS met FROM a""")
def a24_burn_rate(spark, sf_dir):
    return M.burn_rate(V.requests(spark, sf_dir), ["backend"], ~failed(), 0.999)


@query(R + "SELECT backend, count(*) AS requests, round(count(*) / count(DISTINCT user_id), 6) AS per_user, count(*) FILTER (outcome = 'error') AS errors FROM requests GROUP BY backend")
def a45_usage_ratios(spark, sf_dir):
    return V.requests(spark, sf_dir).groupBy("backend").agg(F.count("*").alias("requests"), F.round(F.count("*") / F.countDistinct("user_id"), 6).alias("per_user"), F.count_if(failed()).alias("errors"))


@query(R + """, m AS (SELECT backend, user_id % 5 AS bucket, median(latency_s) FILTER (user_id % 2 = 0) AS on_median, median(latency_s) FILTER (user_id % 2 = 1) AS off_median FROM requests GROUP BY 1, 2),
g AS (SELECT median(latency_s) AS overall FROM requests)
SELECT backend, round(avg(coalesce(on_median, overall) - coalesce(off_median, overall)), 6) AS effect, count(*) AS pairs FROM m, g GROUP BY backend""")
def a49_paired_effect(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    rows = r.select("backend", (F.col("user_id") % 5).alias("bucket"), (F.col("user_id") % 2).alias("side"), "latency_s")
    halves = median(rows, ["backend", "bucket", "side"], "latency_s", "m")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("m")))
    pairs = rows.select("backend", "bucket").distinct().join(halves.groupBy("backend", "bucket").agg(of(0).alias("on"), of(1).alias("off")), ["backend", "bucket"], "left")
    overall = median(r, [], "latency_s", "overall")
    effect = F.coalesce("on", "overall") - F.coalesce("off", "overall")
    return pairs.crossJoin(F.broadcast(overall)).groupBy("backend").agg(F.round(F.avg(effect), 6).alias("effect"), F.count("*").alias("pairs"))


@query(R + "SELECT backend, outcome, grouping_id(backend, outcome)::BIGINT AS level, count(*) AS n, quantile_disc(latency_s, 0.5) AS p50, quantile_disc(latency_s, 0.95) AS p95 FROM requests GROUP BY GROUPING SETS ((backend), (outcome), ())")
def a50_dashboard(spark, sf_dir):
    V.requests(spark, sf_dir).createOrReplaceTempView("requests_view")
    return spark.sql("SELECT backend, outcome, grouping_id(backend, outcome) AS level, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_s) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_s) AS p95 FROM requests_view GROUP BY GROUPING SETS ((backend), (outcome), ())")


@query("SELECT event_type, regexp_extract(props, '([0-9]+)', 1)::BIGINT % 3 AS tenant, user_id % 2 AS outcome, grouping_id(event_type, regexp_extract(props, '([0-9]+)', 1)::BIGINT % 3, user_id % 2)::BIGINT AS level, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (regexp_extract(props, '([0-9]+)', 1)::BIGINT % 3), (user_id % 2), ())")
def a7_audit_totals(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_type", (V.shard() % 3).alias("tenant"), (F.col("user_id") % 2).alias("outcome"))
    return e.groupingSets([["event_type"], ["tenant"], ["outcome"], []], "event_type", "tenant", "outcome").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query(R + """, r AS (SELECT backend, date_trunc('hour', ts) AS round, count(*) FILTER (outcome = 'error') AS bad, count(*) AS n FROM requests GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN bad = 0 THEN 'healthy' WHEN bad < n THEN 'partial' ELSE 'limited' END AS status FROM r)
SELECT backend, count(*) AS rounds, count(*) FILTER (status = 'limited') AS limited, count(*) FILTER (status = 'partial') AS partial, round(count(*) FILTER (status = 'healthy') / count(*), 6) AS healthy_share FROM s GROUP BY backend""")
def a51_probe_rounds(spark, sf_dir):
    rounds = V.requests(spark, sf_dir).groupBy("backend", F.date_trunc("hour", "ts").alias("round")).agg(F.count_if(failed()).alias("bad"), F.count("*").alias("n"))
    status = F.when(F.col("bad") == 0, "healthy").when(F.col("bad") < F.col("n"), "partial").otherwise("limited")
    return rounds.withColumn("status", status).groupBy("backend").agg(F.count("*").alias("rounds"), F.count_if(F.col("status") == "limited").alias("limited"), F.count_if(F.col("status") == "partial").alias("partial"), F.round(F.count_if(F.col("status") == "healthy") / F.count("*"), 6).alias("healthy_share"))


@query(R + """, n AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY backend ORDER BY ts, event_id) AS island,
  row_number() OVER (PARTITION BY backend ORDER BY ts DESC, event_id DESC) = 1 AS is_last FROM requests)
SELECT backend, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(is_last) AS open FROM n WHERE outcome = 'error' GROUP BY backend, island HAVING count(*) >= 2""")
def w20_bursts(spark, sf_dir):
    return M.bursts(V.requests(spark, sf_dir), ["backend"], ["ts", "event_id"], failed())


@query(R + """, l AS (SELECT *, lag(outcome) OVER (PARTITION BY backend ORDER BY ts, event_id) AS previous FROM requests)
SELECT event_id, backend, ts, outcome, previous FROM l WHERE previous IS DISTINCT FROM outcome""")
def w21_state_changes(spark, sf_dir):
    return M.state_changes(V.requests(spark, sf_dir), ["backend"], ["ts", "event_id"], "outcome").select("event_id", "backend", "ts", "outcome", "previous")


@query(R + """, d AS (SELECT backend, date_trunc('day', ts) AS day, count(*) FILTER (outcome = 'error') / count(*) > 0.2 AS failing FROM requests GROUP BY 1, 2),
l AS (SELECT *, lag(failing) OVER (PARTITION BY backend ORDER BY day) AS before FROM d)
SELECT backend, day FROM l WHERE failing AND before = false""")
def w15_transitions(spark, sf_dir):
    by = Window.partitionBy("backend").orderBy("day")
    days = V.requests(spark, sf_dir).groupBy("backend", F.date_trunc("day", "ts").alias("day")).agg((F.count_if(failed()) / F.count("*") > 0.2).alias("failing"))
    return days.withColumn("before", F.lag("failing").over(by)).where("failing AND before = false").select("backend", "day")


@query("""WITH RECURSIVE n AS (SELECT 'b' || (regexp_extract(props, '([0-9]+)', 1)::BIGINT % 4)::VARCHAR AS backend, value / 100.0 AS x, row_number() OVER (PARTITION BY regexp_extract(props, '([0-9]+)', 1)::BIGINT % 4 ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT backend, rn, 0.5 * 0.8 + x * (1.0 - 0.8) AS a FROM n WHERE rn = 1 UNION ALL SELECT n.backend, n.rn, f.a * 0.8 + n.x * (1.0 - 0.8) FROM f JOIN n ON n.backend = f.backend AND n.rn = f.rn + 1)
SELECT backend, round(arg_max(a, rn), 6) AS latency_average FROM f GROUP BY backend""")
def w7_moving_average(spark, sf_dir):
    from lumenforge.operators.scans import moving_average

    return moving_average(V.requests(spark, sf_dir), ["backend"], ["ts", "event_id"], F.col("latency_s"), 0.5, 0.8).select("backend", F.round("folded", 6).alias("latency_average"))


@query(R + """, n AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY backend ORDER BY ts DESC, event_id DESC) AS ahead FROM requests),
s AS (SELECT backend, count(*) FILTER (outcome = 'error' AND ahead = 0) AS streak, count(*) FILTER (outcome <> 'error') / count(*) AS rate, max(ts) FILTER (outcome = 'error') AS last_failure, max(ts) AS last_seen FROM n GROUP BY 1)
SELECT backend, streak, round(rate, 6) AS rate, round(0.5 * (1 - rate) + 0.3 * least(1.0, streak / 3.0) + 0.2 * CASE WHEN epoch_us(last_seen) - epoch_us(last_failure) < 3600000000 THEN 1.0 ELSE 0.0 END, 6) AS risk FROM s""")
def w8_failure_risk(spark, sf_dir):
    return M.failure_risk(V.requests(spark, sf_dir), ["backend"], ["ts", "event_id"], failed())


QUERIES, ORACLE_SQL = query.queries, query.sql
