"""Queries of retrieval and offline evaluation: benchmark passages against documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X
from lumenforge.operators import evaluation as E
from lumenforge.operators import retrieval as R
from lumenforge.operators import substrings
from lumenforge.operators import text_index as I
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry
from lumenforge.sources.storage import exists, kept

query = Registry()
SETTINGS = [(1, 1.5, 0.75), (2, 1.2, 0.5), (3, 2.0, 0.9)]


#: Indexes of this process, by application and the files that they were built of.
_INDEXES: dict[tuple, I.TextIndex] = {}


def index_of(spark, sf_dir) -> I.TextIndex:
    """The postings index of the documents: built once for each state of the table's files, then read by every search."""
    docs = V.table(spark, sf_dir, "documents")
    files = tuple(map(tuple, docs.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).distinct().orderBy("file_path").collect()))
    key = spark.sparkContext.applicationId, sf_dir, files
    if key not in _INDEXES or not exists(spark, f"{_INDEXES[key].path}/_SUCCESS"):  # the shared folder may have been cleared
        _INDEXES[key] = I.TextIndex.build(docs, "doc_id", "text")
    return _INDEXES[key]


def query_terms(spark, sf_dir) -> DataFrame:
    """query, term: every distinct term of each benchmark passage."""
    b = V.table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))


def runs(spark, sf_dir, settings=SETTINGS) -> DataFrame:
    """run, query, doc, score, rank, domain, latency_ms of the top 10: three parameter sets stand for three runs."""
    docs = V.table(spark, sf_dir, "documents")
    best = I.search(query_terms(spark, sf_dir), index_of(spark, sf_dir), 10, settings)
    named = kept(best, "runs").join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("domain")), "doc")
    return named.withColumn("latency_ms", (F.col("query") * 37 % 900 + F.col("run") * F.col("query") % 7 * 60 + 100).cast("double"))


def gold(spark, sf_dir) -> DataFrame:
    """query, doc, gold_domain: documents that contain the whole passage. The documents with all its terms are found first."""
    docs, b = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "benchmark")
    terms = b.select(F.col("item_id").alias("query"), F.explode(X.tokens(F.col("text"))).alias("term"))
    pairs = I.all_terms(terms, index_of(spark, sf_dir))
    x = pairs.join(b.select(F.col("item_id").alias("query"), F.col("text").alias("passage")), "query").join(docs.select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("gold_domain")), "doc")
    return x.where(F.contains("text", "passage")).select("query", "doc", "gold_domain")


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
SQL_INDEX = f"""terms AS (SELECT doc_id AS doc, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))) AS term FROM documents),
idx AS (SELECT term, doc, count(*) AS tf FROM terms GROUP BY 1, 2), lens AS (SELECT doc, count(*) AS doc_len FROM terms GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM terms) / (SELECT count(*) FROM documents) AS avg_len),
qt AS (SELECT query, term, min(pos) AS pos FROM (SELECT item_id AS query, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})) AS t FROM benchmark)) GROUP BY 1, 2),
q AS (SELECT query, term FROM qt),
dfs AS (SELECT term, count(*) AS df FROM idx GROUP BY 1)"""
SQL_BM25 = SQL_INDEX + """, scored AS (SELECT s.run, q.query, idx.doc, round(sum(ln(greatest(1.0, (n_docs - df + 0.5) / (df + 0.5)) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))), 9) AS score
  FROM q JOIN idx USING (term) JOIN dfs USING (term) JOIN lens USING (doc), st, (VALUES (1::BIGINT, 1.5, 0.75), (2, 1.2, 0.5), (3, 2.0, 0.9)) s(run, k1, b) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, query ORDER BY score DESC, doc) AS rank FROM scored)"""
SQL_RUNS = SQL_BM25 + """, runs AS (SELECT run, query, doc, score, rank, source AS domain, (query * 37 % 900 + run * query % 7 * 60 + 100)::DOUBLE AS latency_ms FROM ranked JOIN documents ON doc_id = doc WHERE rank <= 10),
gold AS (SELECT item_id AS query, doc_id AS doc, source AS gold_domain FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gd AS (SELECT DISTINCT query, gold_domain FROM gold), gn AS (SELECT query, count(*) AS n FROM gd GROUP BY 1),
ideal AS (SELECT query, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) AS ideal FROM gn),
firsts AS (SELECT run, r.query, r.domain, min(rank) AS rank FROM runs r JOIN gd ON gd.query = r.query AND gd.gold_domain = r.domain GROUP BY 1, 2, 3),
metrics AS (SELECT x.run, x.query, round(coalesce((SELECT sum(1 / log2(rank + 1)) FROM firsts f WHERE f.run = x.run AND f.query = x.query), 0) / ideal, 6) AS ndcg,
  round(coalesce((SELECT 1 / min(rank) FROM firsts f WHERE f.run = x.run AND f.query = x.query), 0), 6) AS rr,
  round((SELECT count(*) FROM runs r JOIN gd ON gd.query = r.query AND gd.gold_domain = r.domain WHERE r.run = x.run AND r.query = x.query) / x.n, 6) AS precision
  FROM (SELECT run, query, count(*) AS n FROM runs GROUP BY 1, 2) x JOIN ideal USING (query))"""
W = "WITH "


@query(W + SQL_RUNS + " SELECT query, ndcg, rr, precision FROM metrics WHERE run = 1")
def bm25_ndcg(spark, sf_dir):
    """Flagship: BM25 top 10 of each passage's terms, scored against the documents that hold the passage."""
    g = gold(spark, sf_dir).select("query", "gold_domain").distinct()
    return E.ranking_metrics(runs(spark, sf_dir, SETTINGS[:1]), g, ["query"])


@query(W + SQL_INDEX + " SELECT term, count(*) AS df FROM idx GROUP BY 1")
def a33_document_frequency(spark, sf_dir):
    return index_of(spark, sf_dir).document_frequency()


@query(W + SQL_BM25 + " SELECT query, doc, score, rank FROM ranked WHERE run = 1 AND rank <= 10")
def r1_bm25(spark, sf_dir):
    return runs(spark, sf_dir, SETTINGS[:1]).select("query", "doc", "score", "rank")


@query(W + SQL_BM25 + ", t AS (SELECT query, doc, score, rank FROM ranked WHERE run = 1 AND rank <= 20) SELECT query, doc, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM t WINDOW w AS (PARTITION BY query)")
def w2_min_max(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    out = R.min_max(I.search(query_terms(spark, sf_dir), index_of(spark, sf_dir), 20), ["query"], "score", "scaled")
    return out.select("query", "doc", F.round("scaled", 6).alias("scaled"))


@query(W + SQL_BM25 + """, p AS (SELECT query, doc, 0.3 / (60 + rank) AS p, rank AS seen FROM ranked WHERE run = 1 AND rank <= 30 UNION ALL SELECT query, doc, 0.7 / (60 + rank), 1000000 + rank FROM ranked WHERE run = 3 AND rank <= 30),
f AS (SELECT query, doc, round(sum(p), 9) AS score, min(seen) AS seen FROM p GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen, doc) AS rank FROM f) SELECT query, doc, score, rank FROM n WHERE rank <= 10""")
def r4_rank_fusion(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    best = I.search(query_terms(spark, sf_dir), index_of(spark, sf_dir), 30, [SETTINGS[0], SETTINGS[2]])
    fused = R.rank_fusion([(best.where("run = 1"), 0.3), (best.where("run = 3"), 0.7)], "query", "doc")
    return fused.where("rank <= 10").select("query", "doc", "score", "rank")


SQL_VECTORS = """vq AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), vc AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
vs AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS score FROM vq a, vc b WHERE a.vec_id <> b.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM vs)"""


@query(W + SQL_VECTORS + " SELECT query, doc, round(score, 6) AS score, rank FROM vr WHERE rank <= 10")
def j6_vector_top_k(spark, sf_dir):
    """Every vector whose id is divisible by 50 is a query against all vectors."""
    e = V.table(spark, sf_dir, "embeddings")
    return R.vector_top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query(W + SQL_VECTORS + ", h AS (SELECT query, doc, score, rank FROM vr WHERE rank <= 3 AND score >= 0.5) SELECT query, doc, round(score, 6) AS score FROM h WHERE (query, rank) IN (SELECT (query, min(rank)) FROM h GROUP BY query)")
def j8_near_queries(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    near = R.vector_top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 3).where("score >= 0.5")
    return near.groupBy("query").agg(F.min(F.struct("rank", "doc", "score")).alias("h")).select("query", "h.doc", F.round("h.score", 6).alias("score"))


@query(W + SQL_INDEX + f""", {V.SQL_CATALOGUE}, n AS (SELECT query, count(*) AS n FROM q GROUP BY 1), m AS (SELECT query, doc, count(*) AS m FROM q JOIN idx USING (term) GROUP BY 1, 2), whole AS (SELECT query, 'd' || doc AS doc FROM m JOIN n USING (query) WHERE m = n),
short AS (SELECT DISTINCT item_id AS query, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+')[1:2], lambda w: length(w) >= 3)) AS term FROM benchmark),
needs AS (SELECT query, count(*) AS n FROM short GROUP BY 1), sub AS (SELECT query, id AS doc FROM short s JOIN catalogue c ON contains(lower(c.url), s.term) OR contains(lower(c.title), s.term) JOIN needs USING (query) GROUP BY query, id, n HAVING count(*) = n)
SELECT query, doc, 'terms' AS how FROM whole UNION ALL SELECT query, doc, 'substring' FROM sub WHERE query NOT IN (SELECT query FROM whole)""")
def f11_all_terms(spark, sf_dir):
    """Documents with all terms of a passage; for passages without any, the pages whose URL or title holds each of the first two words
    of three letters or more as substrings."""
    terms = query_terms(spark, sf_dir)
    whole = kept(I.all_terms(terms, index_of(spark, sf_dir)), "all-terms")
    first = F.filter(F.slice(F.split(F.lower("text"), X.WORD_GAP), 1, 2), lambda w: F.char_length(w) >= 3)
    short = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(first).alias("term")).distinct().join(whole.select("query").distinct(), "query", "left_anti")
    near = substrings.containing(short, V.catalogue(spark, sf_dir), "id", ["url", "title"])
    return whole.select("query", F.concat(F.lit("d"), F.col("doc").cast("string")).alias("doc"), F.lit("terms").alias("how")).unionByName(near.select("query", "doc", F.lit("substring").alias("how")))


@query(W + SQL_INDEX + ", m AS (SELECT query, doc, count(*) AS m FROM q JOIN idx USING (term) GROUP BY 1, 2) SELECT query, lang, count(*) AS docs, max(m) AS most FROM m JOIN documents ON doc_id = doc GROUP BY 1, 2")
def j2_postings_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("value"))
    return I.by_group(query_terms(spark, sf_dir), index_of(spark, sf_dir), docs).select("query", F.col("value").alias("lang"), "docs", "most")


@query(W + SQL_BM25 + ", t AS (SELECT * FROM ranked WHERE run = 1 AND rank <= 30), c AS (SELECT t.*, source, row_number() OVER (PARTITION BY query, source ORDER BY rank) AS rn FROM t JOIN documents ON doc_id = doc) SELECT query, doc, source, rank FROM c WHERE rn <= 2")
def w3_source_cap(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    best = I.search(query_terms(spark, sf_dir), index_of(spark, sf_dir), 30).join(docs, "doc")
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("query", "source").orderBy("rank"))).where("rn <= 2").select("query", "doc", "source", "rank")


@query(W + SQL_BM25 + ", t AS (SELECT r.*, source, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc) AS rn FROM ranked r JOIN documents ON doc_id = doc WHERE run = 1), b AS (SELECT query, source, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM t WHERE rn = 1) SELECT * FROM b WHERE place <= 5")
def w4_best_per_source(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("value"))
    best = I.by_group(query_terms(spark, sf_dir), index_of(spark, sf_dir), docs).select("query", F.col("value").alias("source"), "doc", "score")
    return R.top_k(best, ["query"], "score", "doc", 5).withColumnRenamed("rank", "place")


def metrics(spark, sf_dir, ranked: DataFrame | None = None) -> DataFrame:
    g = gold(spark, sf_dir).select("query", "gold_domain").distinct()
    return E.ranking_metrics(runs(spark, sf_dir) if ranked is None else ranked, g, ["run", "query"])


def judged(spark, sf_dir, settings=SETTINGS) -> DataFrame:
    ranked = runs(spark, sf_dir, settings)
    r = ranked.groupBy("run", "query").agg(F.count("*").alias("n_results"), F.max("latency_ms").alias("latency_ms"))
    return metrics(spark, sf_dir, ranked).join(r, ["run", "query"]).withColumn("passed", F.col("ndcg") >= 0.5)


SQL_JUDGED = SQL_RUNS + """, judged AS (SELECT m.*, n_results, latency_ms, ndcg >= 0.5 AS passed FROM metrics m JOIN (SELECT run, query, count(*) AS n_results, max(latency_ms) AS latency_ms FROM runs GROUP BY 1, 2) USING (run, query))"""


@query(W + SQL_RUNS + " SELECT run, query, ndcg, rr, precision FROM metrics")
def e1_ranking_metrics(spark, sf_dir):
    return metrics(spark, sf_dir)


@query(W + SQL_RUNS + " SELECT run, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, round(avg(precision), 6) AS precision FROM metrics GROUP BY 1")
def e7_aggregate_metrics(spark, sf_dir):
    return metrics(spark, sf_dir).groupBy("run").agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("precision"), 6).alias("precision"))


@query(W + SQL_JUDGED + """, m AS (SELECT query, count(*) AS runs, 2 * count(*) FILTER (passed) > count(*) AS passed, median(ndcg) AS mn, median(latency_ms) AS ml FROM judged GROUP BY 1),
t AS (SELECT j.query, j.run, row_number() OVER (PARTITION BY j.query ORDER BY round(abs(ndcg - mn), 9), latency_ms, run) AS rn FROM judged j JOIN m USING (query))
SELECT m.query, runs, m.passed, round(mn, 6) AS median_ndcg, round(ml, 6) AS median_latency, t.run::BIGINT AS typical_run FROM m JOIN t ON t.query = m.query AND rn = 1""")
def e8_median_of_runs(spark, sf_dir):
    return E.median_of_runs(judged(spark, sf_dir))


SQL_REGRESSIONS = SQL_JUDGED + """, base AS (SELECT query, ndcg + 0.2 AS b_ndcg, latency_ms * 0.7 AS b_latency, true AS b_passed, n_results AS b_n FROM judged WHERE run = 1),
regs AS (SELECT j.query, j.run, 'results' AS metric, b_n::DOUBLE AS before, n_results::DOUBLE AS after FROM judged j JOIN base USING (query) WHERE n_results < b_n
 UNION ALL SELECT j.query, j.run, 'latency', round(b_latency, 6), round(latency_ms, 6) FROM judged j JOIN base USING (query) WHERE latency_ms > 1.3 * b_latency
 UNION ALL SELECT j.query, j.run, 'passed', 1.0, 0.0 FROM judged j JOIN base USING (query) WHERE NOT passed
 UNION ALL SELECT j.query, j.run, 'ndcg', round(b_ndcg, 6), round(ndcg, 6) FROM judged j JOIN base USING (query) WHERE b_ndcg - ndcg > 0.05)"""


def regressed(spark, sf_dir) -> DataFrame:
    j = judged(spark, sf_dir)
    base = j.where("run = 1").select("query", (F.col("ndcg") + 0.2).alias("ndcg"), (F.col("latency_ms") * 0.7).alias("latency_ms"), F.lit(True).alias("passed"), "n_results")
    return E.regressions(j, base)


@query(W + SQL_REGRESSIONS + " SELECT query, run::BIGINT AS run, metric, before, after FROM regs")
def e10_regressions(spark, sf_dir):
    return regressed(spark, sf_dir)


@query(W + SQL_REGRESSIONS + """, w AS (SELECT *, row_number() OVER (PARTITION BY query, metric ORDER BY abs(after - before) DESC, before DESC, after DESC) AS rn, FROM regs), n AS (SELECT query, metric, count(DISTINCT run) AS runs FROM regs GROUP BY 1, 2)
SELECT n.query, n.metric, runs, before, after FROM n JOIN w ON w.query = n.query AND w.metric = n.metric AND rn = 1 WHERE runs >= 2""")
def e11_stabilised_regressions(spark, sf_dir):
    return E.stabilised(regressed(spark, sf_dir))


#: The metrics of the runs by newer gold: the sources of English or longer documents that hold the passage.
SQL_NEWER = """, g2 AS (SELECT DISTINCT g.query, g.gold_domain FROM gold g JOIN documents d ON d.doc_id = g.doc WHERE d.lang = 'en' OR length(d.text) > 4000), """
SQL_TAIL = SQL_RUNS[SQL_RUNS.index("gn AS") :]
for _old, _new in (("gd", "g2"), ("gn", "gn2"), ("ideal", "ideal2"), ("firsts", "firsts2"), ("metrics", "metrics2")):
    SQL_TAIL = re.sub(rf"\b{_old}\b", _new, SQL_TAIL)


@query(W + SQL_RUNS + SQL_NEWER + SQL_TAIL + """, two AS (SELECT coalesce(m.query, n.query) AS query, m.ndcg AS b, CASE WHEN coalesce(m.query, n.query) IN (SELECT query FROM g2) THEN coalesce(n.ndcg, 0) ELSE 0 END AS a FROM metrics m FULL JOIN metrics2 n ON m.run = n.run AND m.query = n.query),
med AS (SELECT query, median(b) AS before, median(a) AS after, median(a - b) AS delta, query IN (SELECT query FROM g2) AS held FROM two GROUP BY query),
named AS (SELECT *, CASE WHEN NOT held AND before IS NOT NULL THEN 'removed' WHEN held AND before IS NULL THEN 'added' WHEN abs(round(delta, 6)) >= 0.01 THEN 'changed' ELSE 'same' END AS drift FROM med)
SELECT query, round(before, 6) AS before, round(after, 6) AS after, round(delta, 6) AS delta, drift, drift = 'changed' AND abs(round(delta, 6)) >= 0.05 AS flips FROM named""")
def e12_gold_drift(spark, sf_dir):
    """Three runs judged by the sources of all documents that hold a passage, and again by those of English or longer documents."""
    old = kept(gold(spark, sf_dir), "gold")
    d = V.table(spark, sf_dir, "documents").where("lang = 'en' OR char_length(text) > 4000").select(F.col("doc_id").alias("doc"))
    newer = kept(old.join(d, "doc", "left_semi").select("query", "gold_domain").distinct(), "newer-gold")
    told = kept(runs(spark, sf_dir), "judged-runs")
    judged_by = lambda g: E.ranking_metrics(told, g, ["run", "query"]).select("run", "query", "ndcg")
    return E.gold_drift(judged_by(old.select("query", "gold_domain").distinct()), judged_by(newer), newer.select("query"))


SQL_SHORT = SQL_INDEX + """, short AS (SELECT query, term, run FROM (SELECT query, term, (row_number() OVER (PARTITION BY query ORDER BY pos) - 1) // 2 + 1 AS run FROM qt) WHERE run <= 3),
shorts AS (SELECT run, query, doc, round(sum(ln(greatest(1.0, (n_docs - df + 0.5) / (df + 0.5)) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score FROM short JOIN idx USING (term) JOIN dfs USING (term) JOIN lens USING (doc), st GROUP BY 1, 2, 3),
pool AS (SELECT * FROM (SELECT run, query, doc, row_number() OVER (PARTITION BY run, query ORDER BY score DESC, doc) AS rank FROM shorts) WHERE rank <= 30),
gold AS (SELECT item_id AS query, doc_id AS doc, lang, source FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def short_runs(spark, sf_dir) -> DataFrame:
    """(run, query, doc, rank): the 30 best documents for the first, second and third pair of a passage's distinct terms, as three runs."""
    b = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.posexplode(F.array_distinct(X.tokens(F.col("text")))).alias("pos", "term")).where("pos < 6")
    best = I.search(b.select((F.col("query") * 10 + F.floor(F.col("pos") / 2) + 1).alias("query"), "term"), index_of(spark, sf_dir), 30)
    return best.select((F.col("query") % 10).alias("run"), F.floor(F.col("query") / 10).alias("query"), "doc", "rank")


@query(W + SQL_SHORT + """, each AS (SELECT g.query, v.run, count(p.doc) AS size, count(p.doc) FILTER (p.doc IN (SELECT doc FROM gold x WHERE x.query = p.query)) AS held, count(p.doc) FILTER (rank <= 10 AND p.doc IN (SELECT doc FROM gold x WHERE x.query = p.query)) AS hits
  FROM (SELECT DISTINCT query FROM gold) g CROSS JOIN (VALUES (1), (2), (3)) v(run) LEFT JOIN pool p ON p.query = g.query AND p.run = v.run GROUP BY 1, 2),
kinds AS (SELECT query, median(CASE WHEN hits > 0 THEN 1 ELSE 0 END) = 0 AS zero, count(*) FILTER (held > 0) AS gold_runs, max(size) AS size FROM each GROUP BY 1),
named AS (SELECT query, zero, CASE WHEN NOT zero THEN 'found' WHEN size = 0 THEN 'empty' WHEN gold_runs = 0 THEN 'coverage' WHEN gold_runs = 3 THEN 'ranking' ELSE 'mixed' END AS kind FROM kinds),
axes AS (SELECT DISTINCT query, 'language' AS axis, lang AS value FROM gold UNION ALL SELECT DISTINCT query, 'gold source', source FROM gold UNION ALL SELECT query, 'all', 'all' FROM named)
SELECT axis, value, count(*) AS queries, count(*) FILTER (zero) AS zero, round(count(*) FILTER (zero) / count(*), 6) AS share, count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'coverage') AS coverage, count(*) FILTER (kind = 'ranking') AS ranking, count(*) FILTER (kind = 'mixed') AS mixed FROM axes JOIN named USING (query) GROUP BY 1, 2""")
def a42_zero_gold(spark, sf_dir):
    """Passages whose documents miss the first ten in most of three short searches, by cause, language and source of these documents."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source")
    g = kept(gold(spark, sf_dir).select("query", "doc").distinct(), "gold").join(docs, "doc")
    kinds = kept(E.zero_gold(short_runs(spark, sf_dir), g, g.select("query").distinct(), [1, 2, 3]), "zero-gold")
    axes = g.select("query", F.lit("language").alias("axis"), F.col("lang").alias("value")).unionByName(g.select("query", F.lit("gold source").alias("axis"), F.col("source").alias("value")))
    return E.zero_gold_report(kinds, axes)


@query(W + SQL_RUNS + """, p AS (SELECT query, domain, bool_or(run = 1) AS r1, bool_or(run = 2) AS r2, bool_or(run = 3) AS r3 FROM runs GROUP BY 1, 2)
SELECT domain, count(*) FILTER (r1 AND r2 AND r3) AS steady, count(*) FILTER (r1 AND NOT r3) AS lost, count(*) FILTER (r3 AND NOT r1) AS gained FROM p GROUP BY 1""")
def a41_availability(spark, sf_dir):
    p = runs(spark, sf_dir).groupBy("query", "domain").agg(*[F.bool_or(F.col("run") == k).alias(f"r{k}") for k in (1, 2, 3)])
    return p.groupBy("domain").agg(F.count_if(F.col("r1") & F.col("r2") & F.col("r3")).alias("steady"), F.count_if(F.col("r1") & ~F.col("r3")).alias("lost"), F.count_if(F.col("r3") & ~F.col("r1")).alias("gained"))


@query(W + SQL_RUNS + """, u AS (SELECT domain, count(*) AS used FROM runs WHERE run = 1 GROUP BY 1), h AS (SELECT r.domain, count(*) AS hits FROM runs r JOIN gd ON gd.query = r.query AND gd.gold_domain = r.domain WHERE run = 1 GROUP BY 1), e AS (SELECT gold_domain AS domain, count(*) AS expected FROM gd GROUP BY 1)
SELECT coalesce(u.domain, e.domain) AS domain, coalesce(used, 0)::BIGINT AS used, coalesce(hits, 0)::BIGINT AS hits, coalesce(expected, 0)::BIGINT AS expected FROM u FULL JOIN e ON u.domain = e.domain LEFT JOIN h ON h.domain = u.domain""")
def a43_coverage(spark, sf_dir):
    r, g = runs(spark, sf_dir, SETTINGS[:1]), gold(spark, sf_dir).select("query", F.col("gold_domain").alias("domain")).distinct()
    used = r.groupBy("domain").agg(F.count("*").alias("used"))
    hits = r.join(g, ["query", "domain"]).groupBy("domain").agg(F.count("*").alias("hits"))
    expected = g.groupBy("domain").agg(F.count("*").alias("expected"))
    out = used.join(expected, "domain", "full_outer").join(hits, "domain", "left")
    return out.select("domain", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("used", "hits", "expected")])


@query(W + SQL_RUNS + " SELECT DISTINCT query FROM runs")
def d2_query_union(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.where("run = 1").select("query").union(r.where("run = 2").select("query")).union(r.where("run = 3").select("query")).distinct()


@query(W + SQL_INDEX + f""", w AS (SELECT query, doc, count(*) AS m FROM q JOIN (SELECT DISTINCT term, doc FROM idx) i USING (term) GROUP BY 1, 2) SELECT query, doc, round(m / (SELECT count(*) FROM q q2 WHERE q2.query = w.query), 6) AS coverage FROM w WHERE m >= 2""")
def e4_term_coverage(spark, sf_dir):
    q = query_terms(spark, sf_dir)
    sizes = q.groupBy("query").agg(F.count("*").alias("n"))
    both = index_of(spark, sf_dir).postings().select("term", "doc").join(q, "term").groupBy("query", "doc").agg(F.count("*").alias("both")).where("both >= 2")
    return both.join(sizes, "query").select("query", "doc", F.round(F.col("both") / F.col("n"), 6).alias("coverage"))


@query(W + SQL_JUDGED + """ SELECT run::BIGINT AS run, query, round(0.3 * least(1.0, n_results / 10) + 0.3 * least(1.0, 500 / latency_ms) + 0.2 * CASE WHEN rr > 0 THEN 1.0 ELSE 0.0 END + 0.2 * precision, 6) AS composite,
concat_ws(',', CASE WHEN n_results < 10 THEN 'few_results' END, CASE WHEN latency_ms > 800 THEN 'slow' END, CASE WHEN ndcg < 0.5 THEN 'low_ndcg' END) AS failures FROM judged""")
def e5_composite_and_failures(spark, sf_dir):
    j = judged(spark, sf_dir)
    score = 0.3 * F.least(F.lit(1.0), F.col("n_results") / 10) + 0.3 * F.least(F.lit(1.0), 500 / F.col("latency_ms")) + 0.2 * F.when(F.col("rr") > 0, 1.0).otherwise(0.0) + 0.2 * F.col("precision")
    failed = F.concat_ws(",", F.when(F.col("n_results") < 10, "few_results"), F.when(F.col("latency_ms") > 800, "slow"), F.when(F.col("ndcg") < 0.5, "low_ndcg"))
    return j.select("run", "query", F.round(score, 6).alias("composite"), failed.alias("failures"))


QUERIES, ORACLE_SQL = query.queries, query.sql
