"""Sources and sinks: catalogue tables, evaluation reports, gold maps, logs, seed lists, feeds, sitemaps, archives, training files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge import schemas


def catalogue_table(spark: SparkSession, path: str, schema=schemas.CATALOGUE) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def eval_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, query, rank, url, domain, score, n_results, latency_ms, passed) of files run-N.json; unreadable files give no rows."""
    raw = spark.read.schema(schemas.EVAL_REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/run-*.json").select("results", F.col("_metadata.file_name").alias("file"))
    run = F.regexp_extract("file", r"run-(\d+)\.json$", 1).cast("long")
    r = raw.where("results IS NOT NULL").select(run.alias("run"), F.explode("results").alias("r")).where("r.query IS NOT NULL")
    hits = r.select("run", F.col("r.query.id").alias("query"), F.col("r.resultCount").alias("n_results"), F.col("r.responseTimeMs").alias("latency_ms"), F.col("r.passed").alias("passed"), F.posexplode_outer("r.response.results").alias("pos", "hit"))
    return hits.select("run", "query", (F.col("pos") + 1).cast("long").alias("rank"), "hit.url", "hit.domain", "hit.score", "n_results", "latency_ms", "passed")


def gold_map(spark: SparkSession, path: str) -> DataFrame:
    """(query, gold_pos, gold_domain) of a JSON map; keys that begin with _ are skipped, empty lists stay as one row without a domain."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string, struct<relevantDomains: array<string>>>")
    return text.select(F.explode(m).alias("query", "g")).where(~F.startswith("query", F.lit("_"))).select("query", F.posexplode_outer("g.relevantDomains").alias("gold_pos", "gold_domain"))


def log_lines(spark: SparkSession, path: str, marker: str = r"^=== run (\d+)") -> DataFrame:
    """(file, n, run, query, line) of the last run block of each log file; the query comes from a JSON field, else from the URL's q parameter.

    Lines of one file are numbered by the offset at which Spark reads them: a file is one text, split in order.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    started = F.regexp_extract("line", marker, 1).try_cast("long")
    by = Window.partitionBy("file").orderBy("n")
    x = lines.withColumn("run", F.last(started, ignorenulls=True).over(by)).withColumn("block", F.count(started).over(by)).withColumn("last_block", F.max("block").over(Window.partitionBy("file")))
    found = F.coalesce(F.get_json_object("line", "$.query"), F.try_url_decode(F.nullif(F.regexp_extract("line", r"[?&]q=([^&\s\"]+)", 1), F.lit(""))))
    return x.where("block = last_block AND line <> ''").select("file", "n", "run", found.alias("query"), "line")


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, topic) of seed files: a JSON array, or an object a line; only http(s) URLs."""
    one = "struct<url: string, topic: string>"
    text = spark.read.text(path, wholetext=True)
    lines = F.transform(F.split("value", r"\r?\n"), lambda x: F.from_json(x, one))
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{one}>")).otherwise(lines)
    return text.select(F.explode(rows).alias("s")).select("s.url", "s.topic").where("url RLIKE '^https?://'")


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, title, link, published) of RSS items and Atom entries with a title of five characters and an http(s) link."""
    item = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"), 0)).alias("item")
    x = feeds.select(key, item)
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", ""))
    link = F.coalesce(F.nullif(inner("link"), F.lit("")), F.regexp_extract("item", r'(?is)<link[^>]*href="([^"]+)"', 1))
    when = F.coalesce(F.nullif(inner("pubDate"), F.lit("")), F.nullif(inner("published"), F.lit("")), inner("updated"))
    published = F.coalesce(F.try_to_timestamp(F.when(when.rlike(r"^\d{4}-"), when)), F.try_to_timestamp(F.regexp_extract(when, r"(\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d)", 1), F.lit("d MMM yyyy HH:mm:ss")))
    return x.select(key, inner("title").alias("title"), link.alias("link"), published.alias("published")).where((F.char_length("title") >= 5) & F.col("link").rlike("^https?://"))


#: URLs of a sitemap file on average; the format allows 50,000.
MAP_URLS = 5000


def sitemaps(pages: DataFrame, host: str, url: str) -> DataFrame:
    """(host, xml): the distinct URLs of each host as urlsets. A host of many pages has many files, so none holds a whole host."""
    urls = pages.select(host, url).where(F.col(url).isNotNull()).distinct()
    parts = max(1, -(-urls.count() // MAP_URLS))
    entry = F.concat(F.lit("<url><loc> "), F.col(url), F.lit(" </loc></url>"))
    files = urls.groupBy(host, F.pmod(F.xxhash64(url), F.lit(parts)).alias("_file")).agg(F.concat(F.lit("<urlset>"), F.concat_ws("", F.collect_list(entry)), F.lit("</urlset>")).alias("xml"))
    return files.select(host, "xml")


def sitemap_urls(maps: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, loc, is_index): page URLs of a urlset and child maps of a sitemapindex; relative locations are resolved against the map's host."""
    host = F.regexp_extract(F.col(key), r"^(https?://[^/]+)", 1)
    x = maps.select(key, host.alias("_host"), F.col(xml).rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("loc"))
    full = F.when(F.col("loc").rlike("^https?://"), F.col("loc")).otherwise(F.concat("_host", F.when(F.startswith("loc", F.lit("/")), F.col("loc")).otherwise(F.concat(F.lit("/"), F.col("loc")))))
    return x.select(key, full.alias("loc"), "is_index").distinct()


def write_archive(events: DataFrame, path: str, ts: str, tenant: Column) -> None:
    """JSON lines by day and tenant; characters that are unsafe in a folder name become _."""
    safe = F.regexp_replace(tenant, r"[^A-Za-z0-9_-]", "_")
    events.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).withColumn("tenant", safe).repartition("day", "tenant").write.mode("overwrite").partitionBy("day", "tenant").json(path)


def training_lines(rows: DataFrame, group: str, label: str, features: list[str], sparse: bool = True) -> DataFrame:
    """(group, line): 'label qid:group i:v ...' or the dense form, features to six decimals; rows of a group stand together."""
    cells = [F.format_string("%.6f", F.col(f).cast("double")) for f in features]
    shown = [F.concat(F.lit(f"{i + 1}:"), c) for i, c in enumerate(cells)] if sparse else cells
    line = F.concat_ws(" ", F.col(label).cast("string"), F.concat(F.lit("qid:"), F.col(group).cast("string")), *shown)
    return rows.select(F.col(group).alias("group"), line.alias("line")).repartition("group").sortWithinPartitions("group", "line")


def metric_table(row: DataFrame) -> DataFrame:
    """(metric, value) lines of a one-row table, for CSV or JSON."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])).alias("m")).select("m.*")
