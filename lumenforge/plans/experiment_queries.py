"""Queries of A/B tests over events; variant by the parity of the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenforge.functions.statistics import fnv1a
from lumenforge.operators import experiments as X
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry

query = Registry()

SQL_ARMS = """arms AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, event_type, value FROM events),
row2 AS (SELECT count(*) FILTER (variant = 'a' AND event_type IN ('view', 'click')) AS n_a, count(*) FILTER (variant = 'a' AND event_type = 'click') AS k_a,
 count(*) FILTER (variant = 'b' AND event_type IN ('view', 'click')) AS n_b, count(*) FILTER (variant = 'b' AND event_type = 'click') AS k_b,
 avg(value) FILTER (variant = 'a') AS mean_a, avg(value) FILTER (variant = 'b') AS mean_b, var_samp(value) FILTER (variant = 'a') AS var_a, var_samp(value) FILTER (variant = 'b') AS var_b,
 count(*) FILTER (variant = 'a') AS all_a, count(*) FILTER (variant = 'b') AS all_b FROM arms)"""


def sql_cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    erf = f"(1 - (((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}) * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def arms(spark, sf_dir):
    return V.table(spark, sf_dir, "events").withColumn("variant", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))


def counts(spark, sf_dir):
    shown = F.col("event_type").isin("view", "click")
    return X.side_by_side(arms(spark, sf_dir), "variant", "a", "b", {"n": F.count_if(shown), "k": F.count_if(F.col("event_type") == "click")})


@query()
def x1_assignment(spark, sf_dir):
    """Users of each variant by hash; tests hold the hash against its definition."""
    users = V.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", fnv1a(F.col("user_id").cast("string")).alias("hash"), X.assign(F.col("user_id"), "ranking", [("control", 0.5), ("treatment", 0.3), ("other", 0.2)]).alias("variant"))


@query("""SELECT variant, count(*) FILTER (event_type IN ('view', 'click')) AS impressions, count(*) FILTER (event_type = 'click') AS clicks, round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type IN ('view', 'click')), 6) AS ctr,
round(avg(value), 6) AS mean_latency, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant FROM events) GROUP BY 1""")
def x2_variant_metrics(spark, sf_dir):
    kind = F.col("event_type")
    return X.variant_metrics(arms(spark, sf_dir), "variant", kind.isin("view", "click"), kind == "click", F.col("value"), kind == "error")


@query(f"""WITH {SQL_ARMS}, m AS (SELECT *, (k_a + 1) / (n_a + 2) AS ma, (k_a + 1.0) * (n_a - k_a + 1.0) / ((n_a + 2.0) * (n_a + 2.0) * (n_a + 3.0)) AS va, (k_b + 1) / (n_b + 2) AS mb, (k_b + 1.0) * (n_b - k_b + 1.0) / ((n_b + 2.0) * (n_b + 2.0) * (n_b + 3.0)) AS vb FROM row2),
z AS (SELECT *, (mb - ma) / sqrt(va::DOUBLE + vb::DOUBLE) AS z FROM m), p AS (SELECT *, {sql_cdf("z")} AS better, 2 * (1 - {sql_cdf("abs(z)")}) AS pv FROM z)
SELECT n_a, n_b, k_a, k_b, round(better, 6) AS p_better, round(pv, 6) AS p_value, CASE WHEN n_a < 30 OR n_b < 30 THEN 'too few' WHEN better > 0.975 THEN 'b' WHEN better < 0.025 THEN 'a' ELSE 'none' END AS winner FROM p""")
def x3_beta_posterior(spark, sf_dir):
    return X.beta_posterior(counts(spark, sf_dir))


@query(f"""WITH {SQL_ARMS}, z AS (SELECT *, (mean_b - mean_a) / sqrt(var_a / all_a + var_b / all_b) AS z FROM row2) SELECT all_a AS n_a, all_b AS n_b, round(z, 6) AS z, round(2 * (1 - {sql_cdf("abs(z)")}), 6) AS p_value FROM z""")
def x4_welch(spark, sf_dir):
    row = X.side_by_side(arms(spark, sf_dir), "variant", "a", "b", {"n": F.count("*"), "mean": F.avg("value"), "var": F.var_samp("value")})
    return X.welch(row).select("n_a", "n_b", "z", "p_value")


@query(f"""WITH {SQL_ARMS}, p AS (SELECT *, k_a / n_a AS pa, k_b / n_b AS pb, (k_a + k_b) / (n_a + n_b) AS pp FROM row2), z AS (SELECT *, (pb - pa) / sqrt(pp * (1 - pp) * (1 / n_a + 1 / n_b)) AS z, 1.959964 * sqrt(pa * (1 - pa) / n_a + pb * (1 - pb) / n_b) AS half FROM p)
SELECT n_a, n_b, k_a, k_b, round(z, 6) AS z, round(2 * (1 - {sql_cdf("abs(z)")}), 6) AS p_value, round(pb - pa - half, 6) AS low, round(pb - pa + half, 6) AS high, round(2 * asin(sqrt(pb)) - 2 * asin(sqrt(pa)), 6) AS cohens_h, abs(z) > 2.797 AS stop_early FROM z""")
def x5_two_proportions(spark, sf_dir):
    return X.two_proportions(counts(spark, sf_dir))


@query("""WITH c AS (SELECT user_id % 2 AS variant, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT variant, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT event_type, sum(n) AS k FROM c GROUP BY 1),
g AS (SELECT r.variant, k.event_type, coalesce(c.n, 0) AS n, r * k / (SELECT sum(n) FROM c) AS e FROM r CROSS JOIN k LEFT JOIN c ON c.variant = r.variant AND c.event_type = k.event_type)
SELECT round(sum((n - e) * (n - e) / e), 6) AS statistic, (count(DISTINCT variant) - 1) * (count(DISTINCT event_type) - 1) AS df FROM g""")
def x6_chi_squared(spark, sf_dir):
    cells = V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("variant"), "event_type").agg(F.count("*").alias("n"))
    return X.chi_squared(cells, "variant", "event_type")


@query(f"""WITH {SQL_ARMS}, b AS (SELECT k_a / n_a AS p FROM row2), e AS (SELECT p, effect::DOUBLE AS effect, p * (1 + effect::DOUBLE) AS q FROM b, (VALUES (0.05), (0.1), (0.2)) v(effect)),
t AS (SELECT effect, p, q, 1.959964 * sqrt(2 * ((p + q) / 2) * (1 - (p + q) / 2)) + 0.841621 * sqrt(p * (1 - p) + q * (1 - q)) AS top FROM e) SELECT effect, ceil(top * top / ((q - p) * (q - p)))::BIGINT AS per_arm FROM t""")
def x7_sample_size(spark, sf_dir):
    base = counts(spark, sf_dir).select((F.col("k_a") / F.col("n_a")).alias("base"))
    effects = base.select("base", F.explode(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2))).alias("effect"))
    return effects.select("effect", X.sample_size(F.col("base"), F.col("effect")).alias("per_arm"))


@query()
def x8_posterior_draws(spark, sf_dir):
    return X.posterior_draws(counts(spark, sf_dir), 160_000, 11)


@query(f"""WITH {SQL_ARMS}, p AS (SELECT *, k_a / n_a AS pa, k_b / n_b AS pb, (k_a + k_b) / (n_a + n_b) AS pp FROM row2), z AS (SELECT *, (pb - pa) / sqrt(pp * (1 - pp) * (1 / n_a + 1 / n_b)) AS z FROM p), v AS (SELECT *, round(2 * (1 - {sql_cdf("abs(z)")}), 6) AS pv FROM z)
SELECT CASE WHEN pv < 0.05 AND least(n_a, n_b) >= 500 THEN CASE WHEN pb > pa THEN 'ship' ELSE 'stop' END WHEN least(n_a, n_b) >= 1000 THEN 'no difference' ELSE 'continue' END AS decision FROM v""")
def x9_recommendation(spark, sf_dir):
    t = X.two_proportions(counts(spark, sf_dir))
    lift = F.col("k_b") / F.col("n_b") - F.col("k_a") / F.col("n_a")
    return t.select(X.recommendation(F.col("p_value"), F.least("n_a", "n_b"), F.lit(1000), lift).alias("decision"))


QUERIES, ORACLE_SQL = query.queries, query.sql
