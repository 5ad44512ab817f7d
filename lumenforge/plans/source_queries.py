"""Round trips of sources and sinks over data that Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenforge.plans import learning_queries as Q
from lumenforge.plans import behaviour_queries as B
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry
from lumenforge.sources import readers as S
from lumenforge.sources.storage import shared_dir

query = Registry()
K = f"WITH {V.SQL_CATALOGUE} "


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(K + "SELECT status, count(*) AS n, round(sum(importance), 6) AS importance FROM catalogue GROUP BY 1")
def s1_catalogue_table(spark, sf_dir):
    path = _place(spark, "s1")
    V.catalogue(spark, sf_dir).select(*[F.col(c).cast("timestamp") if c in ("last_indexed", "next_index_at") else F.col(c) for c in ("id", "url", "domain", "title", "language", "total_chunks", "importance", "priority", "status", "last_indexed", "next_index_at")]).write.parquet(path)
    return S.catalogue_table(spark, path).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("importance"), 6).alias("importance"))


@query("SELECT date_trunc('day', ts) AS day, 't_' || (user_id % 3)::VARCHAR AS tenant, count(*) AS n FROM events GROUP BY 1, 2")
def s8_archive(spark, sf_dir):
    path = _place(spark, "s8")
    e = V.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 3).alias("t"))
    S.write_archive(e, path, "ts", F.concat(F.lit("t/"), F.col("t").cast("string")))
    back = spark.read.schema("event_id long, event_type string, day string, tenant string").json(path)
    return back.groupBy(F.to_timestamp("day").alias("day"), "tenant").agg(F.count("*").alias("n"))


@query(f"WITH {Q.SQL_LABELLED} SELECT impression_id AS \"group\", label::VARCHAR || ' qid:' || impression_id::VARCHAR || ' 1:' || printf('%.6f', f_position) || ' 2:' || printf('%.6f', f_score) AS line FROM lab")
def s9_training_file(spark, sf_dir):
    path = _place(spark, "s9")
    S.training_lines(Q.labelled(spark, sf_dir), "impression_id", "label", ["f_position", "f_score"]).select("line").write.text(path)
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"qid:(\d+)", 1).cast("long").alias("group"), F.col("value").alias("line"))


@query("SELECT 'conversions' AS metric, count(*) FILTER (event_type = 'purchase')::VARCHAR AS value FROM events UNION ALL SELECT 'views', count(*) FILTER (event_type = 'view')::VARCHAR FROM events")
def s10_metric_export(spark, sf_dir):
    path = _place(spark, "s10")
    S.metric_table(B.a29_conversions(spark, sf_dir).select("conversions", "views")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("metric string, value string").csv(path)


@query("""WITH g AS (SELECT event_id % 3 + 1 AS run, regexp_extract(props, '([0-9]+)', 1)::BIGINT % 20 AS q, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
SELECT run, count(*) AS queries, sum(least(n, 10))::BIGINT AS hits, max(least(n, 10))::BIGINT AS deepest FROM g GROUP BY 1""")
def s2_eval_reports(spark, sf_dir):
    """Events as evaluation reports, one JSON file for each of three runs, read back into rows."""
    path = _place(spark, "s2")
    e = V.table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    hit = F.struct(F.concat(F.lit("https://d"), (V.shard() % 9).cast("string"), F.lit(".example.com/")).alias("url"), F.concat(F.lit("d"), (V.shard() % 9).cast("string"), F.lit(".example.com")).alias("domain"), F.col("value").alias("score"))
    per_query = e.groupBy((F.col("event_id") % 3 + 1).alias("run"), F.concat(F.lit("q"), (V.shard() % 20).cast("string")).alias("q")).agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("o"), F.col("event_id"), hit.alias("hit")))).alias("h"))
    hits = F.transform(F.slice("h", 1, 10), lambda x: x["hit"])
    one = F.struct(F.struct(F.col("q").alias("id")).alias("query"), F.size(hits).cast("long").alias("resultCount"), F.lit(100.0).alias("responseTimeMs"), F.lit(True).alias("passed"), F.struct(hits.alias("results")).alias("response"))
    reports = per_query.groupBy("run").agg(F.collect_list(one).alias("results"))
    for run in (1, 2, 3):  # file names are the run numbers, so each run is written on its own
        reports.where(F.col("run") == run).select("results").coalesce(1).write.json(f"{path}/parts/run={run}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for run in (1, 2, 3):
        for part in fs.globStatus(new(f"{path}/parts/run={run}/part-*.json")) or []:
            fs.rename(part.getPath(), new(f"{path}/run-{run}.json"))
    rows = S.eval_runs(spark, path)
    return rows.groupBy("run").agg(F.countDistinct("query").alias("queries"), F.count("url").alias("hits"), F.max("rank").alias("deepest"))


@query("""SELECT floor(doc_id / 10)::BIGINT AS feed, count(*) AS articles, TIMESTAMP '2024-01-15 10:00:00' AS first FROM documents WHERE length(trim(regexp_replace(text, '[<>&]', ' ', 'g'))) >= 5 GROUP BY 1""")
def s6_feeds(spark, sf_dir):
    """Documents as feed entries, ten to a feed, parsed back into articles."""
    d = V.table(spark, sf_dir, "documents")
    safe = F.regexp_replace("text", "[<>&]", " ")
    item = F.concat(F.lit("<item><title><![CDATA["), safe, F.lit("]]></title><link>https://news.example.com/"), F.col("doc_id").cast("string"), F.lit("</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>"))
    feeds = d.groupBy(F.floor(F.col("doc_id") / 10).alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.concat_ws("", F.sort_array(F.collect_list(item))), F.lit("</channel></rss>")).alias("xml"))
    return S.feed_items(feeds, "feed", "xml").groupBy("feed").agg(F.count("*").alias("articles"), F.min("published").alias("first"))


@query("SELECT regexp_extract(url, '^(https?://[^/]+)', 1) AS host, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def s7_sitemaps(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", r"^(https?://[^/]+)", 1))
    maps = S.sitemaps(p, "host", "url")
    return S.sitemap_urls(maps, "host", "xml").groupBy("host").agg(F.count("*").alias("urls"))


QUERIES, ORACLE_SQL = query.queries, query.sql
