"""Queries that reuse the operators of other modules: gold joins, run comparison, source round trips, feature projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X
from lumenforge.operators import evaluation as E
from lumenforge.operators import learning as L
from lumenforge.operators import ranking as K
from lumenforge.operators import retrieval as R
from lumenforge.operators import text_tables as T
from lumenforge.operators.behaviour import funnel
from lumenforge.operators.sessions import ordered_fold
from lumenforge.plans import learning_queries as LQ
from lumenforge.plans import retrieval_queries as Q
from lumenforge.plans import text_queries as TQ
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry
from lumenforge.sources import readers as S
from lumenforge.sources.storage import kept, shared_dir

query = Registry()
K_ = f"WITH {V.SQL_CATALOGUE} "


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("WITH " + Q.SQL_RUNS + " SELECT query, gold_domain FROM gd")
def s3_gold_map(spark, sf_dir):
    """Gold written as one JSON map and read back; the query set bounds its size."""
    g = Q.gold(spark, sf_dir).groupBy("query").agg(F.array_sort(F.collect_set("gold_domain")).alias("d"))
    path = _place(spark, "s3")
    entry = F.struct(F.col("query").cast("string"), F.struct(F.col("d").alias("relevantDomains")))
    g.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)
    return S.gold_map(spark, path).where("gold_domain IS NOT NULL").select(F.col("query").cast("long").alias("query"), "gold_domain")


@query("""WITH e AS (SELECT user_id % 4 AS f, event_id, regexp_extract(props, '([0-9]+)', 1) AS k, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id % 4) AS n FROM events)
SELECT 'q ' || k AS query, count(*) AS lines FROM e WHERE rn > n // 2 GROUP BY 1""")
def s4_log_lines(spark, sf_dir):
    """Events as four log files of two runs each, JSON and URL lines in turn; the last run of each file is read back."""
    by = Window.partitionBy("f").orderBy("event_id")
    e = V.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("f"), "event_id", V.shard().cast("string").alias("k"))
    e = e.withColumn("rn", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy("f")))
    run = F.when(F.col("rn") == 1, "=== run 1\n").when(F.col("rn") == F.floor(F.col("n") / 2) + 1, "=== run 2\n").otherwise("")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"query": "q '), F.col("k"), F.lit('"}'))).otherwise(F.concat(F.lit("GET /search?q=q%20"), F.col("k"), F.lit("&n=1 429")))
    files = e.groupBy("f").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.concat(run, line).alias("line")))), lambda x: x["line"])).alias("value"))
    path = _place(spark, "s4")
    files.repartition(4, "f").write.partitionBy("f").text(path)
    return S.log_lines(spark, f"{path}/f=*").where("query IS NOT NULL").groupBy("query").agg(F.count("*").alias("lines"))


@query("SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS topic, count(*) AS seeds FROM pages WHERE regexp_matches(url, '^https://') GROUP BY 1")
def s5_seed_urls(spark, sf_dir):
    path = _place(spark, "s5")
    V.table(spark, sf_dir, "pages").select(F.when(F.col("url").startswith("https:"), F.col("url")).otherwise(F.regexp_replace("url", "^http:", "ftp:")).alias("url"), F.regexp_extract("url", r"^https?://([^/?#:]+)", 1).alias("topic")).write.json(path)
    return S.seed_urls(spark, path).groupBy("topic").agg(F.count("*").alias("seeds"))


@query("WITH " + TQ.SQL_CANDIDATES + " SELECT query, doc, round(least(0.05, list_sum(list_transform(['nd', 'st', 'zz'], lambda w: CASE WHEN contains(lower(title), w) THEN 0.04 WHEN contains(lower(text), w) THEN 0.02 ELSE 0.0 END)))::DOUBLE, 6) AS boost FROM cand")
def t30_expansion_boost(spark, sf_dir):
    terms = F.array(F.lit("nd"), F.lit("st"), F.lit("zz"))
    return TQ.candidates(spark, sf_dir, 20).select("query", "doc", F.round(K.expansion_boost(terms, F.col("title"), F.col("text")), 6).alias("boost"))


@query(K_ + ", g AS (SELECT DISTINCT priority AS query, regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) AS gold FROM catalogue WHERE priority < 3) SELECT id, query FROM catalogue c JOIN g ON c.domain = g.gold OR ends_with(c.domain, '.' || g.gold)")
def j13_gold_suffix(spark, sf_dir):
    c = V.catalogue(spark, sf_dir)
    gold = c.where("priority < 3").select(F.col("priority").alias("query"), F.regexp_extract("domain", r"([^.]+\.[^.]+)$", 1).alias("gold")).distinct()
    return c.select("id", F.explode(X.suffixes(F.col("domain"))).alias("gold")).join(gold, "gold").select("id", "query").distinct()


@query("WITH " + Q.SQL_JUDGED + " SELECT a.query, round(b.ndcg - a.ndcg, 6) AS ndcg_change, b.n_results - a.n_results AS result_change, round(b.latency_ms / a.latency_ms, 6) AS slower FROM judged a JOIN judged b ON a.query = b.query AND a.run = 1 AND b.run = 3")
def j14_run_diff(spark, sf_dir):
    j = kept(Q.judged(spark, sf_dir, [Q.SETTINGS[0], Q.SETTINGS[2]]), "judged")  # both sides read it
    a = j.where("run = 1").select("query", *[F.col(c).alias(f"a_{c}") for c in ("ndcg", "n_results", "latency_ms")])
    return j.where("run = 3").join(a, "query").select("query", F.round(F.col("ndcg") - F.col("a_ndcg"), 6).alias("ndcg_change"), (F.col("n_results") - F.col("a_n_results")).alias("result_change"), F.round(F.col("latency_ms") / F.col("a_latency_ms"), 6).alias("slower"))


@query("WITH " + Q.SQL_RUNS + ", p AS (SELECT DISTINCT query FROM runs WHERE run = 2 AND rank <= 3 AND query % 2 = 0) SELECT coalesce(g.query, p.query) AS query, CASE WHEN p.query IS NULL THEN 'gold only' WHEN g.query IS NULL THEN 'pool only' ELSE 'both' END AS side FROM (SELECT DISTINCT query FROM gd) g FULL JOIN p ON p.query = g.query")
def j15_gold_and_pools(spark, sf_dir):
    g = Q.gold(spark, sf_dir).select("query").distinct().withColumn("g", F.lit(1))
    p = Q.runs(spark, sf_dir, Q.SETTINGS[1:2]).where("rank <= 3 AND query % 2 = 0").select("query").distinct().withColumn("p", F.lit(1))
    return g.join(p, "query", "full_outer").select("query", F.when(F.col("p").isNull(), "gold only").when(F.col("g").isNull(), "pool only").otherwise("both").alias("side"))


@query("""WITH m AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN event_id END AS mark FROM events) SELECT event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS marker FROM m""")
def j16_latest_marker(spark, sf_dir):
    """As-of join of each event with its user's latest signup at or before it."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(by).alias("marker"))


@query("WITH " + TQ.SQL_CANDIDATES + """, x AS (SELECT query, doc, unnest(terms) AS t, text, title, length(text) / 6.0 AS len FROM cand), f AS (SELECT query, doc, t, len, 3.0 * (length(' ' || lower(title)) - length(replace(' ' || lower(title), ' ' || t, ''))) / (length(t) + 1) + (length(' ' || lower(text)) - length(replace(' ' || lower(text), ' ' || t, ''))) / (length(t) + 1) AS tf FROM x)
SELECT query, doc, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / 200.0))), 6) AS score FROM f GROUP BY 1, 2""")
def r3_index_bm25(spark, sf_dir):
    """Index-side BM25: title three times, prefix-word frequencies by plain substring counts."""

    def count(text, term):
        padded = F.concat(F.lit(" "), F.lower(text))
        return (F.char_length(padded) - F.char_length(F.replace(padded, F.concat(F.lit(" "), term), F.lit("")))) / (F.char_length(term) + 1)

    def one(term):
        tf = 3.0 * count(F.col("title"), term) + count(F.col("text"), term)
        return tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * F.char_length("text") / 6.0 / 200.0))

    total = F.aggregate("terms", F.lit(0.0), lambda a, t: a + one(t))
    return TQ.candidates(spark, sf_dir, 20).select("query", "doc", F.round(total, 6).alias("score"))


@query(f"""WITH {Q.SQL_INDEX}, {V.SQL_CATALOGUE}, x AS (SELECT id AS doc, domain, unnest(list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({Q.STOPS})))) AS term FROM catalogue),
h AS (SELECT query, doc, domain, round(0.05 + 0.6 * count(*) / (SELECT count(*) FROM q q2 WHERE q2.query = q.query), 6) AS score FROM x JOIN q USING (term) GROUP BY 1, 2, 3),
b AS (SELECT query, domain, doc, score, row_number() OVER (PARTITION BY query, domain ORDER BY score DESC, doc) AS rn FROM h WHERE score >= 0.08),
k AS (SELECT query, domain, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b WHERE rn = 1) SELECT * FROM k WHERE rank <= 10""")
def r12_feed_search(spark, sf_dir):
    """Titles of the catalogue against the benchmark's terms: best page of each domain with a score of 0.08 or more."""
    c = V.catalogue(spark, sf_dir).select(F.col("id").alias("doc"), "domain", "title")
    q = Q.query_terms(spark, sf_dir)
    sizes = q.groupBy("query").agg(F.count("*").alias("n"))
    hits = c.select("doc", "domain", F.explode(F.array_distinct(X.tokens(F.col("title")))).alias("term")).join(q, "term").groupBy("query", "doc", "domain").agg(F.count("*").alias("m"))
    scored = hits.join(sizes, "query").withColumn("score", F.round(0.05 + 0.6 * F.col("m") / F.col("n"), 6)).where("score >= 0.08")
    best = scored.groupBy("query", "domain").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc")).alias("b")).select("query", "domain", F.col("b.doc").alias("doc"), (-F.col("b.s")).alias("score"))
    return R.top_k(best, ["query"], "score", "doc", 10)


@query("WITH " + Q.SQL_RUNS + " SELECT run, count(*) FILTER (rr > 0) AS found, round(avg(rr), 6) AS mrr, round(min(rr), 6) AS worst FROM metrics GROUP BY 1")
def e2_reciprocal_rank(spark, sf_dir):
    return Q.metrics(spark, sf_dir).groupBy("run").agg(F.count_if(F.col("rr") > 0).alias("found"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.min("rr"), 6).alias("worst"))


@query("WITH " + Q.SQL_RUNS + " SELECT r.query, k, round(count(*) FILTER (gd.query IS NOT NULL AND rank <= k) / count(*) FILTER (rank <= k), 6) AS precision FROM (SELECT * FROM runs WHERE run = 1 AND query IN (SELECT query FROM gd)) r LEFT JOIN gd ON gd.query = r.query AND gd.gold_domain = r.domain, (VALUES (1), (3), (5), (10)) v(k) GROUP BY 1, 2")
def e3_precision_at_k(spark, sf_dir):
    g = Q.gold(spark, sf_dir).select("query", F.col("gold_domain").alias("domain")).distinct()
    r = Q.runs(spark, sf_dir, Q.SETTINGS[:1]).join(g.select("query").distinct(), "query", "left_semi").join(g.withColumn("hit", F.lit(1)), ["query", "domain"], "left")
    x = r.select("query", "rank", "hit", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k")).where("rank <= k")
    return x.groupBy("query", "k").agg(F.round(F.count("hit") / F.count("*"), 6).alias("precision"))


@query("WITH " + Q.SQL_JUDGED + " SELECT run, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate FROM judged GROUP BY 1")
def e6_pass_rate(spark, sf_dir):
    j = Q.judged(spark, sf_dir)
    return j.groupBy("run").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.count_if("passed") / F.count("*"), 6).alias("pass_rate"))


@query("WITH " + Q.SQL_RUNS + ", s AS (SELECT DISTINCT run, query FROM runs) SELECT s.run, s.query, round(coalesce(m.ndcg, (s.query % 10) / 10.0), 6) AS ndcg FROM s LEFT JOIN metrics m USING (run, query)")
def e9_rescored_pools(spark, sf_dir):
    """Stored pools under the current gold; the stored value where a query has no gold now."""
    stored = Q.runs(spark, sf_dir).select("run", "query").distinct().withColumn("stored", F.col("query") % 10 / 10.0)
    return stored.join(Q.metrics(spark, sf_dir).select("run", "query", "ndcg"), ["run", "query"], "left").select("run", "query", F.round(F.coalesce("ndcg", "stored"), 6).alias("ndcg"))


@query("WITH " + Q.SQL_REGRESSIONS + ", steady AS (SELECT query, metric, count(DISTINCT run) AS n FROM regs GROUP BY 1, 2 HAVING count(DISTINCT run) >= 2), ab AS (SELECT DISTINCT query FROM runs WHERE run = 2 GROUP BY query HAVING count(DISTINCT domain) < 8) SELECT steady.query, metric, CASE WHEN ab.query IS NULL THEN 'clean' ELSE 'absence' END AS cause FROM steady LEFT JOIN ab USING (query)")
def e13_regressions_and_absence(spark, sf_dir):
    st = E.stabilised(Q.regressed(spark, sf_dir))
    few = Q.runs(spark, sf_dir, Q.SETTINGS[1:2]).groupBy("query").agg(F.countDistinct("domain").alias("d")).where("d < 8").select("query", F.lit(1).alias("few"))
    return st.join(few, "query", "left").select("query", "metric", F.when(F.col("few").isNull(), "clean").otherwise("absence").alias("cause"))


@query("WITH " + Q.SQL_RUNS + ", g AS (SELECT query, doc FROM gold), f AS (SELECT r.query, min(rank) AS first, count(*) AS hits FROM runs r JOIN g ON g.query = r.query AND g.doc = r.doc WHERE run = 1 GROUP BY 1) SELECT q.query, round(coalesce(1 / first, 0), 6) AS rr, coalesce(hits, 0)::BIGINT AS hits FROM (SELECT DISTINCT query FROM g) q LEFT JOIN f USING (query)")
def e14_own_index(spark, sf_dir):
    """The own index scored by the expected documents themselves."""
    g = Q.gold(spark, sf_dir).select("query", "doc")
    f = Q.runs(spark, sf_dir, Q.SETTINGS[:1]).join(g, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("first"), F.count("*").alias("hits"))
    return g.select("query").distinct().join(f, "query", "left").select("query", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


@query("WITH " + LQ.SQL_PAIRS + " SELECT query, doc, " + ", ".join(f"round({L.LONG_FEATURES[k]}::DOUBLE, 6) AS s{n}" for n, k in enumerate(L.SHORT_PLACES)) + " FROM fx")
def m2_projected_features(spark, sf_dir):
    """The long feature vector projected to the short one of sixteen places."""
    long = kept(L.long_features(LQ.pairs(spark, sf_dir), LQ.MAJOR, LQ.NEWS, LQ.ACADEMIC).select("query", "doc", F.array(*L.LONG_FEATURES).alias("long")), "features")
    rows = long.select("query", "doc", L.projected(F.col("long")).alias("s"))
    return rows.select("query", "doc", *[F.round(F.get("s", F.lit(k)), 6).alias(f"s{k}") for k in range(len(L.SHORT_PLACES))])


@query(LQ.W + "SELECT query, count(*) AS examples, sum(label)::BIGINT AS positives FROM lab JOIN impressions i USING (impression_id) WHERE i.ts >= TIMESTAMP '2024-01-10' GROUP BY 1".replace("SELECT query", "SELECT lab.query"))
def m3_training_window(spark, sf_dir):
    recent = V.impressions(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp")).select("impression_id")
    return LQ.labelled(spark, sf_dir).join(recent, "impression_id", "left_semi").groupBy("query").agg(F.count("*").alias("examples"), F.sum("label").cast("long").alias("positives"))


@query()
def m6_sigmoid_scores(spark, sf_dir):
    """Every labelled row with the score of the trained model, and its place in its list by that score."""
    rows, model = LQ.click_model(spark, sf_dir)
    out = rows.select("impression_id", "url", "part", F.round(F.lit(0.5) if model is None else model.score(), 6).alias("p"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("impression_id").orderBy(F.desc("p"), "url")))


@query("""WITH r AS (SELECT count(DISTINCT user_id) FILTER (value > 20) AS a, count(DISTINCT user_id) FILTER (value > 95 AND event_type = 'click') AS b FROM events)
SELECT 1::BIGINT AS step, 'any' AS name, a AS users, 1.0::DOUBLE AS conversion, 0.0::DOUBLE AS drop_off, 1.0::DOUBLE AS overall FROM r UNION ALL SELECT 2, 'hot click', b, round(b / a, 6), round(1 - b / a, 6), round(b / a, 6) FROM r""")
def u1_funnel_conditions(spark, sf_dir):
    """Funnel steps given as conditions of the caller."""
    e = V.table(spark, sf_dir, "events")
    return funnel(e, "user_id", [("any", F.col("value") > 20), ("hot click", (F.col("value") > 95) & (F.col("event_type") == "click"))])


@query(K_ + """, l AS (SELECT domain, language, row_number() OVER (PARTITION BY language ORDER BY importance DESC, id) AS rank FROM catalogue), b AS (SELECT language, domain, min(rank) AS rank FROM l GROUP BY 1, 2), p AS (SELECT language, domain, 1.0 / (60 + rank) AS p, rank AS seen FROM b UNION ALL SELECT language, domain, 0.5 / (60 + rank), 1000000 + rank FROM b WHERE rank % 2 = 0),
f AS (SELECT language, domain, round(sum(p), 9) AS score, min(seen) AS seen FROM p GROUP BY 1, 2) SELECT language, domain, score, row_number() OVER (PARTITION BY language ORDER BY score DESC, seen, domain) AS rank FROM f""")
def u2_fusion_identity(spark, sf_dir):
    """Rank fusion with a caller's identity column: domains instead of documents."""
    c = V.catalogue(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("importance"), "id"))
    b = c.withColumn("r", rank).groupBy("language", "domain").agg(F.min("r").alias("rank"))
    return R.rank_fusion([(b, 1.0), (b.where("rank % 2 = 0"), 0.5)], "language", "domain").select("language", "domain", "score", "rank")


@query()
def u3_decoded_entities(spark, sf_dir):
    """Vectorised functions over columns: hashed vectors of titles after entity decoding."""
    c = V.catalogue(spark, sf_dir).select("id", X.entity_decode(F.col("title")).alias("title"))
    v = c.select("id", T.hash_embedding(F.col("title"), 16).alias("v"))
    return v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


@query()
def u4_chunk_statistics(spark, sf_dir):
    """Chunks cut in Python batches feed native aggregates."""
    ch = T.chunks(V.table(spark, sf_dir, "documents"), "doc_id", "text")
    return ch.groupBy("doc_id").agg(F.max("total").alias("chunks"), F.sum("tokens").cast("long").alias("tokens"), F.max(F.char_length("chunk")).cast("long").alias("longest"))


@query("""SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY 1""")
def u5_ordered_fold(spark, sf_dir):
    """An ordered fold with a caller's step in place of an aggregate function."""
    step = lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(">"), x))
    return ordered_fold(V.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"), F.lit(""), step).select("user_id", F.col("folded").alias("path"))


QUERIES, ORACLE_SQL = query.queries, query.sql
