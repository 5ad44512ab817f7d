"""Queries of learning to rank over labelled impressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.operators import behaviour as B
from lumenforge.operators import learning as L
from lumenforge.operators import rank_model as RM
from lumenforge.plans import text_queries as TQ
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry
from lumenforge.sources.storage import kept, shared_dir
from lumenforge.streaming import jobs as J
from lumenforge.streaming import learner

query = Registry()
FEATURES = ["f_position", "f_score", "f_hour", "f_value"]


def labelled(spark, sf_dir) -> DataFrame:
    """Impression rows with label and features; the position is a feature and so leaks a little."""
    i = V.impressions(spark, sf_dir).where("impression_id IS NOT NULL").select("impression_id", "query", "user_id", "ts", "value", F.explode("results").alias("r"))
    i = i.select("impression_id", "query", "user_id", "ts", "r.url", "r.position", F.col("r.position").cast("double").alias("f_position"), F.col("r.score").cast("double").alias("f_score"), F.hour("ts").cast("double").alias("f_hour"), (F.col("value") / 100).alias("f_value"))
    carried = ["query", "user_id", *FEATURES]
    return B.click_labels(i.where("url IS NOT NULL"), V.clicks(spark, sf_dir), carried=carried).select("impression_id", "url", *carried, "label")


SQL_LABELLED = f"""{V.SQL_IMPRESSIONS}, {V.SQL_CLICKS}, lab AS (SELECT s.impression_id, s.url, s.query, s.user_id, s.position::DOUBLE AS f_position, s.score::DOUBLE AS f_score, hour(s.ts)::DOUBLE AS f_hour, i.value / 100 AS f_value,
 max(CASE WHEN c.click_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS label FROM shown s JOIN impressions i USING (impression_id) LEFT JOIN clicks c ON c.user_id IS NOT DISTINCT FROM s.user_id AND c.query = s.query AND c.url = s.url AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL 24 HOUR GROUP BY ALL)"""
W = f"WITH {SQL_LABELLED} "


#: Sources that count as well known, as news and as academic.
MAJOR, NEWS, ACADEMIC = ["src1", "src2"], ["src3"], ["src4"]


def pairs(spark, sf_dir) -> DataFrame:
    """Passages with their 20 best documents and what the features need: the age, authority and images of a document come from its
    number, the visits to its source are the clicks of the user with the passage's number on that many results."""
    c = TQ.candidates(spark, sf_dir, 20)
    b = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    visits = V.table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("query")).agg(F.count("*").alias("visits"))
    doc = F.col("doc")
    x = c.join(b, "query").join(visits, "query", "left").select("query", "doc", "query_text", "title", F.col("text").alias("content"), F.col("source").alias("domain"), F.col("rank").alias("position"), F.coalesce("visits", F.lit(0)).alias("visits"))
    return x.withColumns({"age_days": F.when(doc % 5 != 0, doc % 400), "has_images": doc % 2 == 0, "authority": doc % 4 / 10.0, "age_proxy": doc % 10 / 10.0, "source_share": doc % 7 / 7.0})


SQL_PAIRS = TQ.SQL_CANDIDATES + """, vis AS (SELECT user_id AS query, count(*) AS visits FROM events WHERE event_type = 'click' GROUP BY 1),
pr AS (SELECT c.query, c.doc, b.text AS qt, lower(b.text) AS ql, c.title, c.text AS content, lower(c.title) AS lt, lower(c.text) AS lc, c.source, c.rank, coalesce(visits, 0) AS visits,
  list_distinct(list_filter(string_split_regex(lower(b.text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1)) AS q, list_filter(string_split_regex(lower(c.title), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1) AS t, list_filter(string_split_regex(lower(c.text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1) AS w
  FROM cand c JOIN benchmark b ON b.item_id = c.query LEFT JOIN vis ON vis.query = c.query),
fx AS (SELECT *, least(1.0, length(qt) / 100) AS q_len, least(1.0, len(q) / 20) AS q_terms, CASE WHEN contains(ql, '?') THEN 1.0 ELSE 0 END AS q_has_question, CASE WHEN regexp_matches(ql, '[0-9]') THEN 1.0 ELSE 0 END AS q_has_number, 0.0 AS q_has_cjk,
  least(1.0, length(title) / 200) AS title_len, least(1.0, length(content) / 2000) AS content_len, least(1.0, least(length(content), 200) / 200) AS snippet_len, CASE WHEN doc % 5 <> 0 THEN 1.0 ELSE 0 END AS has_date,
  CASE WHEN doc % 5 = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - (doc % 400) / 365)) END AS date_recency, CASE WHEN doc % 2 = 0 THEN 1.0 ELSE 0 END AS has_images,
  CASE WHEN len(q) = 0 OR lt = '' THEN 0 ELSE len(list_filter(q, lambda x: contains(lt, x))) / len(q) END AS title_overlap, CASE WHEN len(q) = 0 OR lc = '' THEN 0 ELSE len(list_filter(q, lambda x: contains(lc, x))) / len(q) END AS content_overlap,
  CASE WHEN len(q) = 0 OR lc = '' THEN 0 ELSE len(list_filter(q, lambda x: contains(substr(lc, 1, 200), x))) / len(q) END AS snippet_overlap, CASE WHEN contains(lt, ql) THEN 1.0 ELSE 0 END AS title_exact_match,
  least(1.0, coalesce(list_sum(list_transform(q, lambda x: ln(1 + 999000.5 / 1000.5) * len(list_filter(t, lambda y: y = x)) * 2.5 / (len(list_filter(t, lambda y: y = x)) + 1.5 * (0.25 + 0.75 * len(t) / 100.0)))), 0) / 10) AS bm25_title,
  least(1.0, coalesce(list_sum(list_transform(q, lambda x: ln(1 + 999000.5 / 1000.5) * len(list_filter(w, lambda y: y = x)) * 2.5 / (len(list_filter(w, lambda y: y = x)) + 1.5 * (0.25 + 0.75 * len(w) / 100.0)))), 0) / 10) AS bm25_content,
  CASE WHEN len(q) > 0 THEN least(1.0, len(list_intersect(q, w)) * ln(101) / (len(q) * 5)) ELSE 0 END AS tfidf_avg, (doc % 4) / 10.0 AS domain_authority, (doc % 10) / 10.0 AS domain_age_proxy, CASE WHEN source IN ('src1', 'src2') THEN 1.0 ELSE 0 END AS is_major_domain,
  (doc % 7) / 7.0 AS result_source, least(1.0, rank / 20) AS result_position, CASE WHEN source = 'src3' THEN 1.0 ELSE 0 END AS is_news_source, CASE WHEN source = 'src4' THEN 1.0 ELSE 0 END AS is_academic_source,
  CASE WHEN regexp_matches(ql, '\\b(news|latest|breaking|headline)') THEN 1.0 ELSE 0 END AS is_news, CASE WHEN regexp_matches(ql, '\\b(stock|market|price|finance|bank)') THEN 1.0 ELSE 0 END AS is_finance, 0.0 AS korean, 0.0 AS chinese,
  CASE WHEN is_news > 0 THEN 1.0 WHEN is_finance > 0 THEN 2.0 ELSE 0 END / 3 AS query_type_num, CASE WHEN visits > 0 THEN 1.0 ELSE 0 END AS user_visited, least(1.0, visits / 10) AS user_visits_norm FROM pr)"""


@query("WITH " + SQL_PAIRS + " SELECT query, doc, " + ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in L.LONG_FEATURES) + " FROM fx")
def m1_features(spark, sf_dir):
    """The 32 features of every passage with each of its 20 best documents."""
    f = L.long_features(pairs(spark, sf_dir), MAJOR, NEWS, ACADEMIC)
    return f.select("query", "doc", *[F.round(n, 6).alias(n) for n in L.LONG_FEATURES])


@query(W + "SELECT count(*) AS examples, count(*) FILTER (label > 0) AS positives, count(*) FILTER (label <= 0) AS negatives, count(DISTINCT query) AS queries, count(DISTINCT url) AS domains FROM lab")
def a31_training_stats(spark, sf_dir):
    return L.set_stats(labelled(spark, sf_dir), "query", "url", "label")


@query(W + """, x AS (SELECT label, 0 AS feature, f_position AS x FROM lab UNION ALL SELECT label, 1, f_score FROM lab UNION ALL SELECT label, 2, f_hour FROM lab UNION ALL SELECT label, 3, f_value FROM lab),
g AS (SELECT feature, avg(x) FILTER (label > 0) - avg(x) FILTER (label <= 0) AS gap FROM x GROUP BY 1) SELECT feature::BIGINT AS feature, round(abs(gap) / (SELECT max(abs(gap)) FROM g), 6) AS importance FROM g""")
def a32_feature_importance(spark, sf_dir):
    return L.importance(labelled(spark, sf_dir).withColumn("features", F.array(*FEATURES)), "features", "label")


@query()
def m4_split(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy(L.split(F.col("query")).alias("part")).agg(F.count("*").alias("rows"), F.countDistinct("query").alias("queries"))


def click_model(spark, sf_dir):
    """(rows, model): labelled rows with their part, and the list-wise model of the training part, read back from its table; None below the least number of rows."""
    rows = kept(L.usable(labelled(spark, sf_dir), "impression_id").withColumn("part", L.split(F.col("query"))), "labelled")
    model = RM.fit(rows.where("part = 'train'"), "impression_id", ["f_position", "url"], FEATURES, "label")
    return rows, model if model is None else RM.RankModel.read(kept(model.table(spark), "rank-model"))


@query()
def m5_train_and_score(spark, sf_dir):
    """A list-wise model of four fifths of the queries, scored on the rest and blended with the current score."""
    rows, model = click_model(spark, sf_dir)
    out = rows.where("part = 'test'").withColumn("model_score", F.lit(0.5) if model is None else model.score())
    return out.select("impression_id", "url", "label", F.round("model_score", 4).alias("model_score"), F.round(L.blend(F.col("model_score"), F.col("f_score")), 4).alias("blended"))


@query("""WITH x AS (SELECT event_type = 'purchase' AS truth, value > 60 AS predicted FROM events WHERE event_type IN ('purchase', 'view')), c AS (SELECT count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (truth = predicted) AS ok, count(*) AS n FROM x),
p AS (SELECT ok / n AS a, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c) SELECT round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p""")
def m7_classification_metrics(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    return L.classification_metrics(e, F.col("event_type") == "purchase", F.col("value") > 60)


@query("""WITH b AS (SELECT avg(value) AS m0, stddev_samp(value) AS s0, avg(hour(ts)) AS h0, stddev_samp(hour(ts)) AS t0 FROM events WHERE ts < TIMESTAMP '2024-01-15'), n AS (SELECT avg(value) AS m1, avg(hour(ts)) AS h1, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT 'value' AS feature, round(abs(m1 - m0) / s0, 6) AS shift, n >= 1000 AND abs(m1 - m0) / s0 > 0.1 AS drifted FROM b, n UNION ALL SELECT 'hour', round(abs(h1 - h0) / t0, 6), n >= 1000 AND abs(h1 - h0) / t0 > 0.1 FROM b, n""")
def m8_drift(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return L.drift(e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut), ["value", "hour"])


@query()
def m9_gradient_step(spark, sf_dir):
    """The labelled rows as a stream in the order of time: a version of the model for each flush, with its metrics before learning."""
    rows = labelled(spark, sf_dir).join(V.impressions(spark, sf_dir).select("impression_id", "ts"), "impression_id")
    folder = f"{shared_dir(spark)}/examples-{uuid.uuid4().hex}"
    rows.select("ts", *FEATURES, "label").write.parquet(f"{folder}/examples.parquet")
    told = learner.learn(J.stream_of(spark, folder, "examples", "ts"), FEATURES, "label", flush_rows=200)
    right = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0), 6)
    return told.select("version", F.col("n").cast("long").alias("rows"), F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), right("hits", "false_hits").alias("precision"), right("hits", "misses").alias("recall"), F.round("bias", 6).alias("bias"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


QUERIES, ORACLE_SQL = query.queries, query.sql
