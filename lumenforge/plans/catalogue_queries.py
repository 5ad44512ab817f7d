"""Queries over the index catalogue, pages and links."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X
from lumenforge.operators import catalogue as C
from lumenforge.operators import retrieval as R
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry

query = Registry()
K = f"WITH {V.SQL_CATALOGUE} "
AS_OF = f"TIMESTAMP '{V.AS_OF}'"


@query(K + "SELECT domain, count(*) AS documents, sum(total_chunks)::BIGINT AS chunks, round(avg(importance), 6) AS avg_importance, max(last_indexed) AS last_indexed, min(next_index_at) AS next_due FROM catalogue GROUP BY 1")
def a1_domain_stats(spark, sf_dir):
    return C.domain_stats(V.catalogue(spark, sf_dir))


@query(K + "SELECT count(*) AS documents, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, count(DISTINCT domain) AS domains, sum(total_chunks)::BIGINT AS chunks, count(*) FILTER (status = 'failed') / count(*) > 0.1 AS degraded FROM catalogue")
def a2_index_health(spark, sf_dir):
    return C.health(V.catalogue(spark, sf_dir))


@query(K + "SELECT count(*) AS documents, round(sum(total_chunks) / count(*), 6) AS chunks_per_document, (sum(total_chunks) * 768 * 4)::BIGINT AS vector_bytes FROM catalogue")
def a3_index_statistics(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    return c.agg(F.count("*").alias("documents"), F.round(F.sum("total_chunks") / F.count("*"), 6).alias("chunks_per_document"), (F.sum("total_chunks") * 768 * 4).cast("long").alias("vector_bytes"))


@query(K + f"SELECT status, count(*) AS n, count(*) FILTER (next_index_at < {AS_OF}) AS overdue, round(avg(priority), 6) AS avg_priority FROM catalogue GROUP BY 1")
def a4_schedule_stats(spark, sf_dir):
    return V.catalogue(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("next_index_at") < V.as_of()).alias("overdue"), F.round(F.avg("priority"), 6).alias("avg_priority"))


@query(K + "SELECT domain, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, round(avg(priority), 6) AS avg_priority FROM catalogue GROUP BY 1 ORDER BY pending DESC, domain LIMIT 20")
def a5_queue_domains(spark, sf_dir):
    g = V.catalogue(spark, sf_dir).groupBy("domain").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("priority"), 6).alias("avg_priority"))
    return g.orderBy(F.desc("pending"), "domain").limit(20)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def a48_store_stats(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(K + f"SELECT id, CASE WHEN status = 'stale' THEN 'stale' WHEN importance >= 0.7 THEN 'important' ELSE 'scheduled' END AS reason, priority FROM catalogue WHERE status IN ('indexed', 'stale') AND next_index_at <= {AS_OF}")
def f4_due(spark, sf_dir):
    return C.due(V.catalogue(spark, sf_dir), V.as_of()).select("id", "reason", "priority")


@query(K + f"SELECT id, importance, date_diff('day', last_indexed, {AS_OF}) AS age_days FROM catalogue WHERE status = 'stale' AND importance >= 0.6")
def f5_important_stale(spark, sf_dir):
    return V.catalogue(spark, sf_dir).where("status = 'stale' AND importance >= 0.6").select("id", "importance", F.datediff(V.as_of(), "last_indexed").cast("long").alias("age_days"))


@query(K + f"SELECT id, priority FROM catalogue WHERE status = 'pending' AND next_index_at <= {AS_OF} ORDER BY priority DESC, next_index_at, id LIMIT 100")
def f6_next_jobs(spark, sf_dir):
    return C.next_jobs(V.catalogue(spark, sf_dir), V.as_of()).select("id", "priority")


def blacklist(spark, sf_dir):
    """Domains of failed pages; every third entry expires."""
    c = V.catalogue(spark, sf_dir).where("status = 'failed'")
    g = c.groupBy("domain").agg(F.count("*").alias("strikes"), F.max("last_indexed").alias("added_at"))
    return g.withColumn("expires_at", F.when(F.char_length("domain") % 3 == 0, F.col("added_at") + F.expr("interval 20 days")))


SQL_BLACKLIST = V.SQL_CATALOGUE + ", blacklist AS (SELECT domain, count(*) AS strikes, max(last_indexed) AS added_at, CASE WHEN length(domain) % 3 = 0 THEN max(last_indexed) + INTERVAL 20 DAY END AS expires_at FROM catalogue WHERE status = 'failed' GROUP BY 1)"
L = f"WITH {SQL_BLACKLIST} "


@query(L + f"SELECT domain, strikes FROM blacklist WHERE expires_at IS NULL OR expires_at > {AS_OF}")
def f7_active_blacklist(spark, sf_dir):
    return C.active(blacklist(spark, sf_dir), V.as_of()).select("domain", "strikes")


@query(L + "SELECT domain, strikes, count(*) OVER () AS total FROM blacklist WHERE strikes >= 2 ORDER BY strikes DESC, domain LIMIT 20")
def f15_blacklist_page(spark, sf_dir):
    return C.page_slice(blacklist(spark, sf_dir).where("strikes >= 2").select("domain", "strikes"), [F.desc("strikes"), "domain"], 1, 20).drop("total_pages")


@query(L + f", a AS (SELECT domain FROM blacklist WHERE expires_at IS NULL OR expires_at > {AS_OF}) SELECT id FROM catalogue WHERE domain NOT IN (SELECT domain FROM a)")
def j9_not_blacklisted(spark, sf_dir):
    return V.catalogue(spark, sf_dir).join(C.active(blacklist(spark, sf_dir), V.as_of()), "domain", "left_anti").select("id")


@query(L + "SELECT id FROM catalogue c WHERE EXISTS (SELECT 1 FROM (VALUES ('example.com'), ('example.net')) x(d) WHERE c.domain = d OR ends_with(c.domain, '.' || d)) AND NOT EXISTS (SELECT 1 FROM (VALUES ('on.example.net'), ('ththon.example.com')) x(d) WHERE c.domain = d OR ends_with(c.domain, '.' || d))")
def f1_domain_lists(spark, sf_dir):
    c = V.catalogue(spark, sf_dir).select("id", "domain")
    include = spark.createDataFrame([("example.com",), ("example.net",)], "d string")
    exclude = spark.createDataFrame([("on.example.net",), ("ththon.example.com",)], "d string")
    return C.by_suffix(C.by_suffix(c, "domain", include, "d", "semi"), "domain", exclude, "d", "anti").select("id")


@query(K + f"SELECT id FROM catalogue WHERE last_indexed IS NULL OR last_indexed >= {AS_OF} - INTERVAL 30 DAY")
def f2_recency(spark, sf_dir):
    return V.catalogue(spark, sf_dir).where(F.col("last_indexed").isNull() | (F.col("last_indexed") >= V.as_of() - F.expr("interval 30 days"))).select("id")


@query(K + """, s AS (SELECT language, id, importance * 0.2 AS score FROM catalogue), c AS (SELECT *, count(*) FILTER (score >= 0.1) OVER w AS a, count(*) FILTER (score >= 0.05) OVER w AS b, count(*) FILTER (score >= 0.01) OVER w AS d FROM s WINDOW w AS (PARTITION BY language))
SELECT language, id FROM c WHERE score >= CASE WHEN a >= 10 THEN 0.1 WHEN b >= 10 THEN 0.05 WHEN d >= 3 THEN 0.01 ELSE -1 END""")
def f3_adaptive_threshold(spark, sf_dir):
    s = V.catalogue(spark, sf_dir).select("language", "id", (F.col("importance") * 0.2).alias("score"))
    by = Window.partitionBy("language")
    n = lambda t: F.count_if(F.col("score") >= t).over(by)
    s = s.withColumn("least", F.when(n(0.1) >= 10, 0.1).when(n(0.05) >= 10, 0.05).when(n(0.01) >= 3, 0.01).otherwise(-1.0))
    return s.where("score >= least").select("language", "id")


@query(K + f""", v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0), s AS (SELECT c.*, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM catalogue c JOIN v ON 'd' || vec_id::VARCHAR = c.id, q)
SELECT id, round(score, 6) AS score FROM s WHERE language = 'en' AND contains(lower(title), 'the') AND n_chars > 0 AND last_indexed >= {AS_OF} - INTERVAL 80 DAY AND last_indexed >= {AS_OF} - INTERVAL 75 DAY AND last_indexed <= {AS_OF} - INTERVAL 2 DAY AND round(score, 9) >= -0.05""")
def f10_metadata_filters(spark, sf_dir):
    """All filters of an index search at once; the vector score of a page is that of the embedding of its number against the first one."""
    v = V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = v.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = v.crossJoin(F.broadcast(first)).select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("id"), (dot("v", "q") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q")))).alias("score"))
    rows, day = V.catalogue(spark, sf_dir).join(scored, "id"), lambda n: V.as_of() - F.expr(f"interval {n} days")
    return C.metadata_filter(rows, V.as_of(), "en", "the", None, 80, day(75), day(2), F.round("score", 9), -0.05).select("id", F.round("score", 6).alias("score"))


@query(K + "SELECT id, (SELECT count(*) FROM catalogue) AS total, ceil((SELECT count(*) FROM catalogue) / 20)::BIGINT AS total_pages FROM catalogue ORDER BY importance DESC, id LIMIT 20 OFFSET 20")
def f12_page(spark, sf_dir):
    return C.page_slice(V.catalogue(spark, sf_dir).select("id", "importance"), [F.desc("importance"), "id"], 2, 20).select("id", "total", "total_pages")


@query(K + """, n AS (SELECT id, url, importance + 0.1 AS importance, last_indexed + to_days((priority % 3 - 1)::INT) AS last_indexed, 1 AS fresh FROM catalogue WHERE priority % 2 = 0 UNION ALL SELECT id || 'x', url, importance, last_indexed, 1 FROM catalogue WHERE priority = 1),
b AS (SELECT id, url, importance, last_indexed, 0 AS fresh FROM catalogue UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed DESC, fresh DESC) AS rn FROM b) SELECT id, round(importance, 6) AS importance, last_indexed FROM r WHERE rn = 1""")
def s11_upsert(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    old = c.select("id", "url", "importance", "last_indexed")
    moved = F.timestamp_micros(F.unix_micros(F.col("last_indexed").cast("timestamp")) + (F.col("priority") % 3 - 1) * F.lit(86400000000))
    new = c.where("priority % 2 = 0").select("id", "url", (F.col("importance") + 0.1).alias("importance"), moved.alias("last_indexed")).unionByName(c.where("priority = 1").select(F.concat("id", F.lit("x")).alias("id"), "url", "importance", "last_indexed"))
    return C.upsert(old, new, "id", "last_indexed").select("id", F.round("importance", 6).alias("importance"), "last_indexed")


@query(K + "SELECT id FROM catalogue WHERE url NOT IN (SELECT url FROM catalogue WHERE status = 'failed')")
def s12_cascade_delete(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    return C.cascade_delete([c], c.where("status = 'failed'"), "url")[0].select("id")


@query("""WITH o AS (SELECT doc_id, sha256(text) AS a FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS b FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'deleted' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def t24_change_detection(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    new = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return C.changes(d.where("doc_id % 7 <> 0"), new, "doc_id", "text")


@query(K + f"""SELECT id, round(least(1.0, 0.1 + CASE WHEN n_chars > 5000 THEN 0.3 WHEN n_chars > 2000 THEN 0.2 WHEN n_chars > 500 THEN 0.1 ELSE 0.0 END + CASE WHEN regexp_matches(lower(title), 'guide|tutorial|reference|documentation|official') THEN 0.2 ELSE 0.0 END
 + CASE WHEN date_diff('day', last_indexed, {AS_OF}) < 7 THEN 0.2 WHEN date_diff('day', last_indexed, {AS_OF}) < 30 THEN 0.1 ELSE 0.0 END + 0.3 * importance), 6) AS score FROM catalogue""")
def t25_importance(spark, sf_dir):
    age = F.datediff(V.as_of(), "last_indexed")
    return V.catalogue(spark, sf_dir).select("id", F.round(C.importance(F.col("n_chars"), F.col("title"), age, F.col("importance")), 6).alias("score"))


#: Suffixes with their weights by context: for every query, by language, by query type; negative weights are penalties.
AUTHORITY = [("all", "example.com", 0.5), ("all", "ththe.example.com", 0.9), ("all", "org", 0.3), ("en", "example.net", 0.2), ("en", "com", 0.05), ("de", "example.org", 0.25), ("fr", "com", -0.1), ("news", "blog.thernd.example.net", -0.4), ("news", "net", 0.1), ("code", "example.org", 0.35)]


@query(K + f""", a(context, suffix, weight) AS (VALUES {', '.join(f"('{c}', '{d}', {w}::DOUBLE)" for c, d, w in AUTHORITY)}), x AS (SELECT id, domain, unnest(list_distinct(['all', language, CASE WHEN priority < 5 THEN 'news' ELSE 'code' END])) AS context FROM catalogue),
h AS (SELECT id, weight, row_number() OVER (PARTITION BY id, x.context ORDER BY length(suffix) DESC) AS rn FROM x JOIN a ON a.context = x.context AND (domain = suffix OR ends_with(domain, '.' || suffix)))
SELECT id, round(coalesce((SELECT sum(weight) FROM h WHERE h.id = c.id AND rn = 1), 0), 6) AS authority FROM catalogue c""")
def j12_longest_suffix(spark, sf_dir):
    """Authority of a page's domain in its contexts: everywhere, its language, and the type of query it is shown for."""
    c = V.catalogue(spark, sf_dir).select("id", "domain", "language", "priority")
    contexts = F.array_distinct(F.array(F.lit("all"), F.coalesce("language", F.lit("")), F.when(F.col("priority") < 5, "news").otherwise("code")))
    listed = spark.createDataFrame(AUTHORITY, "context string, domain string, weight double")
    return C.context_weights(c, "domain", contexts, listed).select("id", F.round("weight", 6).alias("authority"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages")
def t1_domain(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", X.domain(F.col("url")).alias("domain"))


@query("""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://', '') AS u FROM pages), s AS (SELECT page_id, regexp_replace(regexp_replace(u, '\\?.*$', ''), '/+$', '') AS path,
list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref|ref_src)(=|$)')) AS params FROM b)
SELECT page_id, lower(CASE WHEN len(params) > 0 THEN path || '?' || array_to_string(params, '&') ELSE path END) AS key FROM s""")
def t2_canonical_url(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("key"))


@query(K + "SELECT id, substr(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')), 1, 80) AS key FROM catalogue")
def t3_title_key(spark, sf_dir):
    return V.catalogue(spark, sf_dir).select("id", X.title_key(F.col("title")).alias("key"))


SQL_LINKS = r"""x AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"#]+)', 1))) AS href FROM pages),
f AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href WHEN starts_with(href, '/') THEN host || href
  WHEN starts_with(href, '?') THEN host || path || href ELSE host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || href END AS a FROM x),
g AS (SELECT page_id, url, a, regexp_extract(a, '^(https?://[^/?#]+)', 1) AS own, string_split(regexp_extract(a, '^https?://[^/?#]+/([^?#]*)', 1), '/') AS steps FROM f),
h AS (SELECT page_id, url, CASE WHEN list_contains(steps, '.') OR list_contains(steps, '..') THEN own || '/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(steps, lambda x: [x])), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[:-2] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END)
  || CASE WHEN steps[-1] IN ('.', '..') THEN [''] ELSE [] END, '/') || regexp_extract(a, '^[^?#]*(\?.*)$', 1) ELSE a END AS dst FROM g),
links AS (SELECT DISTINCT page_id, url, dst FROM h WHERE dst IS NOT NULL AND NOT regexp_matches(dst, '(?i)\.(css|js|png|jpe?g|gif|svg|ico|pdf|zip|mp4)(\?|$)'))"""


@query("WITH " + SQL_LINKS + " SELECT DISTINCT page_id, dst FROM links")
def t21_links(spark, sf_dir):
    return C.links(V.table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query(K + """SELECT id FROM catalogue WHERE NOT (starts_with('/' || regexp_extract(url, '^https?://[^/]+/?([^#]*)', 1), '/fr/') OR starts_with('/' || regexp_extract(url, '^https?://[^/]+/?([^#]*)', 1), '/en/2'))""")
def t22_robots(spark, sf_dir):
    """Rules of a robots body for each domain, applied to the catalogue's URLs."""
    c = V.catalogue(spark, sf_dir).select("id", "url", "domain")
    body = F.concat(F.lit("User-agent: bot\nDisallow: /x\nUser-agent: *\nDisallow: /fr/\nDisallow: /en/"), F.lit("2\nCrawl-delay: 3"))
    rules = C.robots_rules(c.select("domain").distinct().withColumn("body", body), "domain", "body")
    return C.allowed(c, "url", "domain", rules).select("id")


@query(K + ", " + SQL_LINKS + r""", seeds AS (SELECT DISTINCT url, domain FROM catalogue WHERE importance >= 0.5),
e AS (SELECT l.url AS src, l.dst, s.domain FROM links l JOIN seeds s ON s.url = l.url WHERE l.dst NOT IN (SELECT url FROM pages) AND regexp_replace(lower(regexp_extract(l.dst, '^https?://(?:[^/@]*@)?([^/?#:]+)', 1)), '^www\.', '') = s.domain),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM e) SELECT src, dst FROM r WHERE rn <= 5 ORDER BY src, dst LIMIT 500""")
def j20_frontier(spark, sf_dir):
    """One hop of links from important pages to unvisited URLs."""
    p = V.table(spark, sf_dir, "pages")
    edges = p.join(C.links(p, "page_id", "url", "html"), "page_id").select(F.col("url").alias("src"), "dst")
    seeds = V.catalogue(spark, sf_dir).where("importance >= 0.5").select("url", "domain").dropDuplicates(["url"])
    return C.frontier(seeds, edges, p.select("url"), 5, 500)


@query(K + "SELECT domain, importance, priority FROM (SELECT domain, max(importance) AS importance, max(priority) AS priority FROM catalogue GROUP BY 1) x WHERE importance >= 0.5 AND domain NOT IN (SELECT domain FROM catalogue WHERE status = 'pending') ORDER BY importance + priority / 10 DESC, domain LIMIT 20")
def j10_seeds(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    g = c.groupBy("domain").agg(F.max("importance").alias("importance"), F.max("priority").alias("priority")).where("importance >= 0.5")
    return g.join(c.where("status = 'pending'"), "domain", "left_anti").orderBy(F.desc(F.col("importance") + F.col("priority") / 10), "domain").limit(20)


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0)")
def j11_incremental(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").withColumn("h", F.md5("text"))
    return d.join(d.where("doc_id % 4 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0 EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0")
def d4_unseen(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.where("page_id % 3 <> 0").select("url").subtract(p.where("page_id % 3 = 0").select("url"))


@query(K + r""", b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://', '') AS bare FROM catalogue), s AS (SELECT *, regexp_replace(regexp_replace(bare, '\?.*$', ''), '/+$', '') AS path,
  list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref|ref_src)(=|$)')) AS params FROM b),
k AS (SELECT language, id, url, importance AS score, lower(CASE WHEN len(params) > 0 THEN path || '?' || array_to_string(params, '&') ELSE path END) AS u, substr(trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')), 1, 80) AS t FROM s),
one AS (SELECT *, CASE WHEN t = '' THEN chr(1) || u ELSE t END AS o FROM (SELECT *, row_number() OVER (PARTITION BY language, u ORDER BY score DESC, url) AS rn FROM k) WHERE rn = 1)
SELECT language, id, score FROM (SELECT *, row_number() OVER (PARTITION BY language, o ORDER BY score DESC, url) AS rn2 FROM one) WHERE rn2 = 1""")
def d1_result_dedup(spark, sf_dir):
    c = V.catalogue(spark, sf_dir).select("language", "id", "url", "title", F.col("importance").alias("score"))
    return R.dedup_results(c, ["language"], "url", "title", "score").select("language", "id", "score")


@query(K + """SELECT coalesce(a.id, b.id) AS id, round(least(1.0, greatest(coalesce(a.s * 1.2, 0), coalesce(b.s, 0)) * CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1.1 ELSE 1 END), 6) AS score
FROM (SELECT id, importance AS s FROM catalogue WHERE priority % 2 = 0) a FULL JOIN (SELECT id, priority / 10.0 AS s FROM catalogue WHERE priority % 3 = 0) b ON a.id = b.id ORDER BY score DESC, id LIMIT 15""")
def j5_source_merge(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    a = c.where("priority % 2 = 0").select("id", F.col("importance").alias("a"))
    b = c.where("priority % 3 = 0").select("id", (F.col("priority") / 10.0).alias("b"))
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1.1).otherwise(1.0)
    score = F.least(F.lit(1.0), F.greatest(F.coalesce(F.col("a") * 1.2, F.lit(0.0)), F.coalesce("b", F.lit(0.0))) * both)
    return a.join(b, "id", "full_outer").select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(15)


@query(K + """, ch AS (SELECT id || '_chunk_' || n AS chunk, (priority * 7 + n) % 10 / 10.0 AS score FROM catalogue, LATERAL (SELECT unnest(range(total_chunks)) AS n))
SELECT chunk, c.id, domain, score FROM ch JOIN catalogue c ON c.id = split_part(chunk, '_chunk_', 1) WHERE status = 'indexed' AND score >= 0.5""")
def j1_chunks_documents(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_chunks") - 1)).alias("n")
    chunks = c.select("id", "priority", n).select(F.concat("id", F.lit("_chunk_"), F.col("n").cast("string")).alias("chunk"), ((F.col("priority") * 7 + F.col("n")) % 10 / 10.0).alias("score")).where("score >= 0.5")
    docs = c.where("status = 'indexed'").select("id", "domain")
    return chunks.withColumn("id", F.split_part("chunk", F.lit("_chunk_"), F.lit(1))).join(docs, "id").select("chunk", "id", "domain", "score")


QUERIES, ORACLE_SQL = query.queries, query.sql
