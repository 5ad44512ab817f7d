"""Queries over text: cleaning, chunks, sentences, labels, entities, claims, scores and selections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X
from lumenforge.operators import dictionary as D
from lumenforge.operators import ranking as K
from lumenforge.operators import retrieval as R
from lumenforge.operators import text_index as I
from lumenforge.operators import text_tables as T
from lumenforge.plans import retrieval_queries as Q
from lumenforge.plans import views as V
from lumenforge.plans.registry import Registry
from lumenforge.sources.storage import kept

query = Registry()
STOPS = Q.STOPS


def docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


@query()
def t4_page_text(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").select("page_id", X.page_text(F.col("html")).alias("text"))
    return p.select("page_id", F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("n_chars"))


@query()
def t5_sections(spark, sf_dir):
    s = T.sections(V.table(spark, sf_dir, "pages"), "page_id", "html")
    return s.select("page_id", "n", "level", "heading", "path", F.char_length("text").cast("long").alias("n_chars"))


@query()
def t6_chunks(spark, sf_dir):
    return T.chunks(docs(spark, sf_dir), "doc_id", "text").select("doc_id", "n", "tokens", "total", F.md5("chunk").alias("digest"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 20, 1) + 1, 80)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, (i - 1) // 80 AS n, md5(array_to_string(w[i:i + 99], ' ')) AS digest FROM s""")
def t7_word_windows(spark, sf_dir):
    return T.word_windows(docs(spark, sf_dir), "doc_id", "text", 100, 20).select("doc_id", F.col("n").cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query()
def t8_paragraph_packs(spark, sf_dir):
    return T.pack_paragraphs(docs(spark, sf_dir), "doc_id", "text", 400).select("doc_id", "n", F.md5("chunk").alias("digest"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def t9_token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


#: Sentences of a text: ends are marked by chr(1), the points of abbreviations by chr(2).
SQL_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(Mr|Mrs|Dr|St|vs|etc|e\.g|i\.e)\.(\s)', '\1' || chr(2) || '\2', 'g'),
 '([.!?])\s+', '\1' || chr(1), 'g'), '([\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(replace(s, chr(2), '.'))), lambda s: s <> '')"""


@query(f"SELECT doc_id, x[1] AS n, md5(x[2]) AS digest FROM (SELECT doc_id, unnest(list_zip(range(len(s)), s)) AS x FROM (SELECT doc_id, {SQL_SENTENCES} AS s FROM documents))")
def t10_sentences(spark, sf_dir):
    return T.sentence_table(docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("n").cast("long").alias("n"), F.md5("sentence").alias("digest"))


@query("SELECT lang, CASE WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' ELSE 'en' END AS script, count(*) AS n FROM documents GROUP BY 1, 2")
def t11_script_labels(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", X.script_label(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))) AS tokens FROM documents")
def t12_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("tokens"))


@query()
def t13_dates(spark, sf_dir):
    """Dates written in several ways, derived from the events, normalised against one reference time."""
    e = V.table(spark, sf_dir, "events")
    day = F.col("ts").cast("timestamp")
    n = (F.col("event_id") % 20 + 1).cast("string")
    written = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy.M.d"), F.date_format(day, "MMM d, yyyy"), F.concat(n, F.lit(" days ago")), F.concat(n, F.lit("시간 전")), F.lit("yesterday"), F.lit("soon")), (F.col("event_id") % 7 + 1).cast("int"))
    x = e.select("event_id", written.alias("written"))
    return x.select("event_id", "written", X.parse_date(F.col("written"), F.lit(V.AS_OF).cast("timestamp")).alias("parsed"))


@query(f"SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda w: struct_pack(p := list_position(t, w), w := w)))[1:5], lambda x: x.w), ' ') AS keywords FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}) AND NOT regexp_full_match(w, '(19|20)[0-9][0-9]')) AS t FROM benchmark)")
def t14_keywords(spark, sf_dir):
    return V.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.keywords(X.clean_query(F.col("text"))), " ").alias("keywords"))


T15_LEADS = ["", "how does ", "what is ", "latest news on ", "buy cheap ", "compare ", "price of "]


def t15_text():
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in T15_LEADS]), (F.col("conv_id") % 7 + 1).cast("int")), F.coalesce("text", F.lit("")))


@query(r"""WITH u AS (SELECT ['', 'how does ', 'what is ', 'latest news on ', 'buy cheap ', 'compare ', 'price of '][conv_id % 7 + 1] || coalesce(text, '') AS t FROM conversations WHERE role = 'user'),
s AS (SELECT CASE WHEN regexp_matches(lower(t), '^(?:what|who|when|where|why|how)(?:$|[^\p{L}\p{M}\p{N}_])') THEN 2.0 ELSE 0 END + CASE WHEN contains(t, '?') THEN 1.0 ELSE 0 END AS question, CASE WHEN regexp_matches(lower(t), '(?:^|[^\p{L}\p{M}\p{N}_])(?:vs|versus|compare|better)(?:$|[^\p{L}\p{M}\p{N}_])') THEN 2.5 ELSE 0 END AS compare,
  CASE WHEN regexp_matches(lower(t), '(?:^|[^\p{L}\p{M}\p{N}_])(?:buy|price|cheap|deal)(?:$|[^\p{L}\p{M}\p{N}_])') THEN 2.0 ELSE 0 END AS buy, CASE WHEN regexp_matches(lower(t), '(?:^|[^\p{L}\p{M}\p{N}_])(?:news|latest|today)(?:$|[^\p{L}\p{M}\p{N}_])') THEN 2.0 ELSE 0 END AS news, t FROM u)
SELECT intent, CASE intent WHEN 'question' THEN CASE WHEN regexp_matches(lower(t), '^(?:how|why)(?:$|[^\p{L}\p{M}\p{N}_])') THEN 'explanation' ELSE 'fact' END WHEN 'compare' THEN 'versus' WHEN 'buy' THEN CASE WHEN regexp_matches(lower(t), '(?:^|[^\p{L}\p{M}\p{N}_])(?:price|cheap)(?:$|[^\p{L}\p{M}\p{N}_])') THEN 'price' ELSE 'purchase' END
  WHEN 'news' THEN CASE WHEN regexp_matches(lower(t), '(?:^|[^\p{L}\p{M}\p{N}_])(?:latest|today)(?:$|[^\p{L}\p{M}\p{N}_])') THEN 'latest' ELSE 'topic' END ELSE CASE WHEN words <= 3 THEN 'short' ELSE 'long' END END AS subtype,
  regexp_matches(lower(t), '^(?:what|who|when|where|why|how)(?:$|[^\p{L}\p{M}\p{N}_])') OR contains(t, '?') AS is_question, CASE WHEN load < 8 THEN 'low' WHEN load < 30 THEN 'medium' ELSE 'high' END AS complexity, count(*) AS n
FROM (SELECT *, CASE WHEN greatest(question, compare, buy, news) = 0 THEN 'search' WHEN question = greatest(question, compare, buy, news) THEN 'question' WHEN news = greatest(question, compare, buy, news) THEN 'news' WHEN compare = greatest(question, compare, buy, news) THEN 'compare' ELSE 'buy' END AS intent,
  words + 2 * len(list_filter(string_split_regex(lower(t), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w IN ('and', 'or', 'but', 'und', 'et', 'y', 'if'))) AS load FROM (SELECT *, len(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words FROM s)) GROUP BY ALL""")
def t15_intents(spark, sf_dir):
    """Mix of the user turns by label. The given turns hold no question or buying words, so each gets a lead by its number."""
    c = V.table(spark, sf_dir, "conversations").where("role = 'user'").select(t15_text().alias("text"))
    return c.groupBy(*T.query_labels(F.col("text"))).agg(F.count("*").alias("n"))


#: Names of licences and bodies for the dictionary.
NAMES = [("organization", "Apache"), ("organization", "GNU"), ("organization", "MIT"), ("product", "Apache License"), ("product", "GNU General Public License"), ("product", "General Public License"), ("product", "Creative Commons"), ("product", "BSD")]


def names(spark, sf_dir):
    """(kind, entry): names of licences, and the first two words of each benchmark passage as things to be found in documents."""
    first = V.table(spark, sf_dir, "benchmark").select(F.lit("passage").alias("kind"), F.regexp_extract("text", r"^(\S+\s\S+)", 1).alias("entry"))
    return spark.createDataFrame(NAMES, "kind string, entry string").unionByName(first.where("entry <> ''"))


@query()
def t16_entities(spark, sf_dir):
    """Entities of each document with any: counts by kind and the primary one."""
    return D.summary(D.mentions(docs(spark, sf_dir), "doc_id", "text", names(spark, sf_dir)), "doc_id")


@query(f"""WITH t AS (SELECT list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})) AS w FROM documents),
x AS (SELECT w, unnest(range(1, len(w))) AS i FROM t), pairs AS (SELECT w[i] AS a, w[i + 1] AS b, count(*) AS n FROM x GROUP BY 1, 2),
near AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM pairs) WHERE rn <= 2),
q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))) AS words FROM benchmark),
m AS (SELECT item_id, list(DISTINCT b) FILTER (NOT list_contains(words, b)) AS more FROM (SELECT item_id, words, unnest(words) AS a FROM q) JOIN near USING (a) GROUP BY 1)
SELECT item_id, coalesce(array_to_string(list_sort(more)[1:8], ' '), '') AS expansion FROM m""")
def t17_expansion(spark, sf_dir):
    """Benchmark terms expanded by the terms that most often follow them in the corpus (top two), minus those present."""
    words = F.array_distinct(X.tokens(F.col("text")))
    q = V.table(spark, sf_dir, "benchmark").select("item_id", words.alias("words"))
    asked = q.select(F.explode("words").alias("a")).distinct()
    pairs = I.following(docs(spark, sf_dir), "text").join(asked, "a", "left_semi").groupBy("a", "b").agg(F.sum("n").alias("n"))
    near = R.top_k(pairs, ["a"], "n", "b", 2)
    x = q.select("item_id", "words", F.explode("words").alias("a")).join(near, "a")
    return x.groupBy("item_id", "words").agg(F.collect_set("b").alias("more")).select("item_id", F.array_join(F.slice(F.sort_array(F.array_except("more", "words")), 1, 8), " ").alias("expansion"))


@query(r"""SELECT conv_id, turn, len(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\s+(?:vs\.?|versus|and|und|et|y)\s+|[,;]\s*'), lambda x: trim(x)), lambda x: x <> ''))) AS parts FROM conversations WHERE role = 'user' AND parts > 0""")
def t18_decomposition(spark, sf_dir):
    """Sub-queries of user turns: parts of comparisons and conjunctions."""
    c = V.table(spark, sf_dir, "conversations").where("role = 'user'")
    parts = F.array_distinct(F.filter(F.transform(F.split(F.lower("text"), r"\s+(?:vs\.?|versus|and|und|et|y)\s+|[,;]\s*"), lambda x: F.trim(x)), lambda x: x != ""))
    return c.select("conv_id", "turn", F.posexplode(parts).alias("n", "part")).groupBy("conv_id", "turn").agg(F.count("*").alias("parts"))


@query(r"""WITH s AS (SELECT role, greatest(CASE WHEN regexp_matches(text, '(?i)\b(ignore|disregard|forget)\b.{0,30}\b(previous|above|prior|all)\b.{0,20}\b(instructions?|rules?|prompts?)\b') THEN 3 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)\byou are now\b|\bact as\b.{0,20}\b(admin|root|system|developer)\b') THEN 2 ELSE 0 END,
  CASE WHEN regexp_matches(text, '(?i)\b(reveal|show|print|repeat)\b.{0,20}\b(system prompt|hidden instructions?)\b') THEN 3 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)<\|?(system|im_start|im_end)\|?>|\[/?INST\]|</s>') THEN 1 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)\b(base64|rot13)\b.{0,20}\b(decode|decrypt)\b') THEN 1 ELSE 0 END) AS severity FROM conversations)
SELECT role, severity, severity >= 3 AS quarantine, count(*) AS n FROM s GROUP BY 1, 2""")
def t19_injection_scan(spark, sf_dir):
    s = T.injection_scan(V.table(spark, sf_dir, "conversations"), "text")
    return s.groupBy("role", "severity", "quarantine").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id AS i FROM pages) SELECT i AS page_id, 'Product' AS type, 'p' || i::VARCHAR AS name, least(i % 8, 5)::DOUBLE AS rating, (i % 100)::DOUBLE AS price, 0::BIGINT AS items FROM p WHERE i % 6 = 0
UNION ALL SELECT i, 'Article', 'a' || i::VARCHAR, NULL, NULL, 0 FROM p WHERE i % 6 = 1 UNION ALL SELECT i, 'FAQPage', NULL, NULL, NULL, 2 FROM p WHERE i % 6 = 1
UNION ALL SELECT i, 'Product', 'm' || i::VARCHAR, least(i % 7, 5)::DOUBLE, (i % 90)::DOUBLE, 0 FROM p WHERE i % 6 = 2 UNION ALL SELECT i, 'article', 't' || i::VARCHAR, NULL, (i % 80)::DOUBLE, 0 FROM p WHERE i % 6 = 3
UNION ALL SELECT i, 'BreadcrumbList', NULL, NULL, NULL, 3 FROM p WHERE i % 6 = 4""")
def t20_structured_data(spark, sf_dir):
    """The pages hold no structured data of their own, so each gets a snippet by its number: JSON-LD, a graph, microdata, meta tags, a breadcrumb list or none."""
    made = [
        '<script type="application/ld+json">{"@type":"Product","name":"p%1$d","aggregateRating":{"ratingValue":%2$d},"offers":[{"price":%3$d}]}</script><meta property="og:type" content="other">',
        '<script type="application/ld+json">{"@graph":[{"@type":"Article","headline":"a%1$d"},{"@type":"FAQPage","mainEntity":[{"name":"x"},{"name":"y"}]}]}</script>',
        '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">m%1$d</b><meta itemprop="ratingValue" content="%4$d"><i itemprop="price">%5$d</i></div><meta property="og:type" content="other">',
        '<meta property="og:type" content="article"><meta property="og:title" content="t%1$d"><meta property="product:price:amount" content="%6$d">',
        '<script type="application/ld+json">[{"@type":"BreadcrumbList","itemListElement":[{"name":"a"},{"name":"b"},{"name":"c"}]}]</script>',
        "",
    ]
    i = F.col("page_id")
    snippet = F.element_at(F.array(*[F.format_string(m, i, i % 8, i % 100, i % 7, i % 90, i % 80) for m in made]), (i % 6 + 1).cast("int"))
    pages = V.table(spark, sf_dir, "pages").withColumn("html", F.concat("html", snippet))
    return T.structured_data(pages, "page_id", "html")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'software|computer|program|code|data') THEN 'technology' WHEN regexp_matches(lower(text), 'market|stock|company|price') THEN 'business' WHEN regexp_matches(lower(text), 'health|doctor|medicine|disease') THEN 'health' WHEN regexp_matches(lower(text), 'research|physics|chemistry|biology') THEN 'science' ELSE 'general' END AS topic FROM documents")
def t23_topics(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.topic(F.col("text")).alias("topic"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, round(0.25 * (CASE WHEN len(w) BETWEEN 50 AND 2000 THEN 1.0 WHEN len(w) > 0 THEN 0.5 ELSE 0 END + least(1.0, len(regexp_extract_all(text, '[.!?]')) / 5.0) + CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END + (1 - least(1.0, len(regexp_extract_all(text, '[#*$%&|<>]')) / greatest(length(text), 1) * 10))), 6) AS quality FROM w""")
def t26_content_quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(K.content_quality(F.col("text")), 6).alias("quality"))


@query()
def t28_hash_embedding(spark, sf_dir):
    v = docs(spark, sf_dir).select("doc_id", T.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"))


SQL_CLAIMS = f"""sent AS (SELECT doc_id, source, unnest(list_zip(range(len(s)), s)) AS x FROM (SELECT doc_id, source, {SQL_SENTENCES} AS s FROM documents)),
sized AS (SELECT doc_id, source, x[1] AS n, x[2] AS claim, length(x[2]) AS size, regexp_matches(x[2], '{X.CJK}') AS cjk FROM sent),
scored AS (SELECT doc_id, source, n, claim, CASE WHEN size BETWEEN 60 AND 220 THEN 35 WHEN size >= 40 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(claim, '[0-9]') THEN 30 ELSE 0 END
   + CASE WHEN cjk THEN 20 WHEN regexp_matches(claim, '[A-Z][a-z]+|[A-Z]{{2,}}') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(claim, '{T.FURNITURE}') THEN 60 ELSE 0 END
   - CASE WHEN len(list_filter(range(1, length(claim) - 4), lambda i: claim[i:i + 5] = repeat(claim[i], 6))) > 0 THEN 50 ELSE 0 END AS score
   FROM sized WHERE CASE WHEN cjk THEN size BETWEEN 20 AND 450 ELSE size BETWEEN 40 AND 300 END),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(claim), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) ORDER BY n) AS d FROM scored WHERE score > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS p FROM firsts WHERE d = 1),
claim AS (SELECT doc_id, source, doc_id || '-' || n AS id, n, claim, score, regexp_matches(claim, '{T.NEGATIONS.replace("'", "''")}') AS negated,
   list_sort(list_distinct(list_transform(regexp_extract_all(claim, '(?i)[0-9]+(?:[.,][0-9]+)*\\s*{T.UNITS}'), lambda m: {{'unit': lower(regexp_extract(m, '(?i){T.UNITS}$')), 'value': try_cast(replace(regexp_extract(m, '^[0-9.,]+'), ',', '') AS DOUBLE)}}))) AS quantities
   FROM placed WHERE p <= {{most}})"""
#: Clusters by the least id that is reached over links of a Dice overlap of 0.55, or 0.3 with a common quantity; equal sets are one node.
SQL_CLUSTERS = "RECURSIVE " + SQL_CLAIMS.replace("{most}", "100000") + f""", sets AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(lower(claim), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})))) AS w FROM claim),
class AS (SELECT w, min(id) AS c, len(w) AS size, flatten(list(quantities)) AS q FROM sets WHERE len(w) > 0 GROUP BY w),
word AS (SELECT c, size, unnest(w) AS t FROM class),
met AS (SELECT a.c AS a, b.c AS b, 2.0 * count(*) / (a.size + b.size) AS dice FROM word a JOIN word b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c, a.size, b.size),
link AS (SELECT a, b FROM met JOIN class x ON x.c = a JOIN class y ON y.c = b WHERE dice >= 0.55 OR (dice >= 0.3 AND list_has_any(x.q, y.q))),
reach AS (SELECT c AS node, c AS r FROM class UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.r),
least AS (SELECT node, min(r) AS cluster FROM reach GROUP BY node),
told AS (SELECT sets.*, coalesce(cluster, id) AS cluster FROM sets LEFT JOIN class USING (w) LEFT JOIN least ON node = c),
deny AS (SELECT cluster, 'negation' AS kind, '' AS unit, min(id) FILTER (NOT negated) AS a, min(id) FILTER (negated) AS b, count(*) FILTER (NOT negated) AS n_a, count(*) FILTER (negated) AS n_b FROM told GROUP BY cluster HAVING n_a > 0 AND n_b > 0),
amount AS (SELECT cluster, q.unit AS unit, q.value AS value, min(id) AS a, count(*) AS n_a FROM (SELECT cluster, id, unnest(quantities) AS q FROM told) GROUP BY ALL),
differ AS (SELECT x.cluster, 'numeric' AS kind, x.unit, x.a, arg_min(y.a, y.value) AS b, x.n_a, sum(y.n_a)::BIGINT AS n_b FROM amount x JOIN amount y ON x.cluster = y.cluster AND x.unit = y.unit AND y.value >= x.value + 1 AND y.value * 0.85 > x.value GROUP BY x.cluster, x.unit, x.value, x.a, x.n_a),
conflict AS (SELECT * FROM deny UNION ALL SELECT * FROM differ)"""


@query("WITH " + SQL_CLAIMS.replace("{most}", "6") + " SELECT doc_id, n, md5(claim) AS digest, round(score / 100, 6) AS score, negated, list_aggregate(list_transform(quantities, lambda q: q.value || ' ' || q.unit), 'string_agg', ', ') AS quantities FROM claim")
def t29_claims(spark, sf_dir):
    c = T.claims(docs(spark, sf_dir), "doc_id", "text")
    told = F.nullif(F.concat_ws(", ", F.transform("quantities", lambda q: F.concat_ws(" ", q.value.cast("string"), q.unit))), F.lit(""))
    return c.select("doc_id", "n", F.md5("claim").alias("digest"), F.round("score", 6).alias("score"), "negated", told.alias("quantities"))


def clustered_claims(spark, sf_dir):
    """All claims of all documents with their clusters, without their texts, kept because several results read them."""
    c = T.claims(docs(spark, sf_dir), "doc_id", "text", None, ("source",), sets=True).withColumn("claim_id", F.concat_ws("-", "doc_id", "n"))
    return T.claim_clusters(c, "claim_id")


@query("WITH " + SQL_CLUSTERS + """, stat AS (SELECT cluster, count(*) AS n_claims, count(DISTINCT source) AS n_sources, arg_min({'id': id, 'source': source}, {'s': -score, 'id': id}) AS best FROM told GROUP BY cluster),
full_ AS (SELECT s.*, (SELECT count(*) FROM told t WHERE t.cluster = s.cluster AND t.source IS NOT DISTINCT FROM s.best.source) AS own, (SELECT count(*) FROM conflict c WHERE c.cluster = s.cluster) AS conflicts FROM stat s),
v AS (SELECT *, CASE WHEN n_claims > 1 THEN (n_claims - own) / (n_claims - 1) ELSE 0.0 END AS agreement, CASE WHEN conflicts > 0 THEN 'conflicting' WHEN n_sources >= 2 THEN 'corroborated' ELSE 'single-source' END AS verdict FROM full_)
SELECT cluster, best.id AS representative, n_claims, n_sources, round(agreement, 6) AS agreement, conflicts, verdict,
 round(least(greatest(0.25 + CASE verdict WHEN 'corroborated' THEN 0.4 WHEN 'single-source' THEN 0.05 ELSE 0.0 END + 0.2 * agreement + 0.1 * least(n_sources / 4, 1.0) - 0.25 * conflicts, 0.0), 0.95), 6) AS confidence FROM v""")
def a46_corroboration(spark, sf_dir):
    """Clusters of claims that several documents state: sources, agreement, conflicts, verdict and confidence."""
    c = clustered_claims(spark, sf_dir)
    return T.corroboration(c, "claim_id", "source", T.conflicts(c, "claim_id"))


@query("WITH " + SQL_CLUSTERS + " SELECT * FROM conflict")
def j17_conflicts(spark, sf_dir):
    """Denied and stated claims, and quantities that differ, inside clusters of claims."""
    return T.conflicts(clustered_claims(spark, sf_dir), "claim_id")


def candidates(spark, sf_dir, k: int):
    """Top k documents of each benchmark passage with their texts and the tokens tt, ct of title and text; the title is the first
    line. They are kept, so that scores don't cut the texts into tokens once for each term."""
    d = docs(spark, sf_dir)
    best = I.search(Q.query_terms(spark, sf_dir), Q.index_of(spark, sf_dir), k).drop("run")
    terms = Q.query_terms(spark, sf_dir).groupBy("query").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    found = best.join(d.select(F.col("doc_id").alias("doc"), "text", "source"), "doc").join(terms, "query").withColumn("title", F.split("text", "\n")[0])
    return kept(found.withColumn("tt", X.tokens(F.col("title"))).withColumn("ct", X.tokens(F.col("text"))), "candidates")


SQL_CANDIDATES = Q.SQL_BM25 + f""", cand AS (SELECT r.query, r.doc, r.score, r.rank, d.text, d.source, string_split(d.text, chr(10))[1] AS title, (SELECT list_sort(list(DISTINCT term)) FROM q WHERE q.query = r.query) AS terms FROM ranked r JOIN documents d ON d.doc_id = r.doc WHERE run = 1 AND rank <= 20),
tok AS (SELECT *, list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})) AS tt, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}&+#]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})) AS ct FROM cand)"""


SQL_SCORED = SQL_CANDIDATES + """, tf AS (SELECT query, doc, len(terms) AS n, len(ct) + 2.0 * len(tt) AS length, unnest(list_transform(terms, lambda t: 2.0 * len(list_filter(tt, lambda w: w = t)) + len(list_filter(ct, lambda w: w = t)))) AS tf FROM tok),
bm AS (SELECT query, doc, CASE WHEN sum(tf) = 0 THEN 0.01 ELSE greatest(0.01, least(0.99, sum(tf::DOUBLE * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 150.0))) / (max(n) * 2.5))) END AS bm FROM tf GROUP BY 1, 2),
parts AS (SELECT query, doc, source, bm, least(1.0, 0.05 + 0.6 * len(list_intersect(list_distinct(terms), tt)) / len(terms) + 0.3 * len(list_intersect(list_distinct(terms), ct)) / len(terms) + 0.1 * exp(-(doc % 60) / 30.0) + 0.1 * (doc % 10 / 10.0)) AS h,
  least(0.05, list_sum(list_transform(terms, lambda w: CASE WHEN contains(lower(title), w) THEN 0.04 WHEN contains(lower(text), w) THEN 0.02 ELSE 0 END))) AS boost FROM tok JOIN bm USING (query, doc))"""


@query("WITH " + SQL_CANDIDATES + """, tf AS (SELECT query, doc, len(terms) AS n, len(ct) + 2.0 * len(tt) AS length, unnest(list_transform(terms, lambda t: 2.0 * len(list_filter(tt, lambda w: w = t)) + len(list_filter(ct, lambda w: w = t)))) AS tf FROM tok)
SELECT query, doc, round(CASE WHEN sum(tf) = 0 THEN 0.01 ELSE greatest(0.01, least(0.99, sum(tf::DOUBLE * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 150.0))) / (max(n) * 2.5))) END, 6) AS score FROM tf GROUP BY 1, 2""")
def r2_field_bm25(spark, sf_dir):
    return candidates(spark, sf_dir, 20).select("query", "doc", F.round(K.field_bm25(F.col("terms"), F.col("tt"), F.col("ct")), 6).alias("score"))


@query("WITH " + SQL_CANDIDATES + " SELECT query, doc, round(least(1.0, 0.05 + 0.6 * len(list_intersect(list_distinct(terms), tt)) / len(terms) + 0.3 * len(list_intersect(list_distinct(terms), ct)) / len(terms) + 0.1 * exp(-(doc % 60) / 30.0) + 0.1 * (doc % 10 / 10.0)), 6) AS relevance FROM tok")
def r7_relevance(spark, sf_dir):
    age, authority = F.col("doc") % 60, F.col("doc") % 10 / 10.0
    return candidates(spark, sf_dir, 20).select("query", "doc", F.round(K.relevance(F.col("terms"), F.col("tt"), F.col("ct"), age, authority), 6).alias("relevance"))


@query("WITH " + SQL_SCORED + """ SELECT query, doc, round(base + (doc % 10 / 10.0) * (1 - base) * 0.1, 6) AS score FROM (SELECT *, greatest(0.01, least(1.0, 0.7 * bm + 0.3 * h + boost)) AS base FROM parts)""")
def r8_blend(spark, sf_dir):
    """Blend of field-weighted BM25 and heuristic relevance with an expansion boost and authority head-room."""
    age, authority = F.col("doc") % 60, F.col("doc") % 10 / 10.0
    bm = K.field_bm25(F.col("terms"), F.col("tt"), F.col("ct"))
    h = K.relevance(F.col("terms"), F.col("tt"), F.col("ct"), age, authority)
    boost = K.expansion_boost(F.col("terms"), F.col("title"), F.col("text"))
    return candidates(spark, sf_dir, 20).select("query", "doc", F.round(K.blended(bm, h, boost, authority), 6).alias("score"))


@query("WITH " + SQL_SCORED + """, b AS (SELECT query, doc, source, greatest(0.01, least(1.0, 0.7 * bm + 0.3 * h)) AS base FROM parts WHERE source <> 'src3'), s AS (SELECT query, doc, least(1.0, base + (doc % 10 / 10.0) * (1 - base) * 0.1 + CASE WHEN source IN ('src1', 'src2') THEN 0.15 ELSE 0 END) AS s FROM b),
f AS (SELECT query, doc, round(s + 0.15 * exp(-(doc % 60) / 30.0) * (1 - s), 6) AS s FROM s), c AS (SELECT *, count(*) FILTER (s >= 0.10) OVER (PARTITION BY query) AS strong FROM f), k AS (SELECT query, doc, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc) AS rank FROM c WHERE s >= 0.10 OR strong < 10 AND s >= 0.01) SELECT * FROM k WHERE rank <= 10""")
def r11_ranking_pipeline(spark, sf_dir):
    """Filter, recompute, personal boost, recency sort and adaptive threshold over the candidates."""
    x = candidates(spark, sf_dir, 20).where("source <> 'src3'")
    age, authority = F.col("doc") % 60, F.col("doc") % 10 / 10.0
    s = K.blended(K.field_bm25(F.col("terms"), F.col("tt"), F.col("ct")), K.relevance(F.col("terms"), F.col("tt"), F.col("ct"), age, authority), F.lit(0.0), authority)
    x = x.withColumn("s", F.least(F.lit(1.0), s + F.when(F.col("source").isin("src1", "src2"), 0.15).otherwise(0.0)))
    x = x.withColumn("s", F.round(K.freshness_blend(F.col("s"), age), 6))
    strong = F.count_if(F.col("s") >= 0.10).over(Window.partitionBy("query"))
    return R.top_k(x.withColumn("strong", strong).where((F.col("s") >= 0.10) | ((F.col("strong") < 10) & (F.col("s") >= 0.01))), ["query"], "s", "doc", 10).select("query", "doc", "s", "rank")


@query("WITH " + SQL_CANDIDATES + " SELECT query, doc, round(score + 0.15 * exp(-(doc % 60) / 30.0) * (1 - score), 6) AS fresh FROM (SELECT query, doc, score / max(score) OVER (PARTITION BY query) AS score FROM cand)")
def w6_freshness(spark, sf_dir):
    x = R.scaled_by_max(candidates(spark, sf_dir, 20).select("query", "doc", "score"), ["query"], "score")
    return x.select("query", "doc", F.round(K.freshness_blend(F.col("score"), F.col("doc") % 60), 6).alias("fresh"))


@query()
def w5_diversity(spark, sf_dir):
    x = R.scaled_by_max(candidates(spark, sf_dir, 30), ["query"], "score").withColumn("words", F.array_distinct("ct"))
    return K.mmr(x, "query", "doc", "score", "source", "words").select("query", "doc", "place")


@query()
def a34_diversity_stats(spark, sf_dir):
    """Distinct sources and average score before and after diversification."""
    x = R.scaled_by_max(candidates(spark, sf_dir, 30), ["query"], "score").withColumn("words", F.array_distinct("ct"))
    after = K.mmr(x, "query", "doc", "score", "source", "words").join(docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "source"), "doc")
    told = lambda d, n: d.groupBy("query").agg(F.countDistinct("source").alias(f"sources_{n}"), F.round(F.avg("score"), 6).alias(f"score_{n}"))
    return told(x.where("rank <= 10"), "before").join(told(after, "after"), "query")


@query()
def w13_answers(spark, sf_dir):
    c = candidates(spark, sf_dir, 5)
    a = K.extractive_answer(c.select("query", "rank", "text"), c.select("query", "terms").distinct(), "query", "rank", "text")
    return a.select("query", "sentences", F.md5("answer").alias("digest"))


@query()
def w14_context(spark, sf_dir):
    """Packs of sentences of the ten best documents of each passage."""
    return K.context_packs(candidates(spark, sf_dir, 10).select("query", "rank", "title", "text"), "query", "rank", "title", "text").select("query", "n", "rank", F.md5("pack").alias("digest"))


@query("WITH " + SQL_CANDIDATES + """, x AS (SELECT query, terms, unnest(list_distinct(tt)) AS term FROM tok), g AS (SELECT query, term, count(*) AS n FROM x WHERE NOT list_contains(terms, term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, term) AS rank FROM g) SELECT * FROM r WHERE rank <= 8""")
def r13_related_terms(spark, sf_dir):
    """Terms that co-occur in the titles of a query's candidates."""
    x = candidates(spark, sf_dir, 20).select("query", "terms", F.explode(F.array_distinct("tt")).alias("term"))
    g = x.where(~F.array_contains("terms", F.col("term"))).groupBy("query", "term").agg(F.count("*").alias("n"))
    return R.top_k(g, ["query"], "n", "term", 8).select("query", "term", "n", "rank")


@query("WITH " + SQL_CANDIDATES + ", g AS (SELECT query, count(*) AS n, avg(score) AS s, count(DISTINCT source) AS domains FROM cand WHERE score >= 5 GROUP BY 1) SELECT query, n, round(s, 6) AS avg_score, domains, concat_ws(',', CASE WHEN domains < 3 THEN 'few_domains' END, CASE WHEN s < 8 THEN 'weak' END) AS warnings FROM g")
def f14_evidence_gate(spark, sf_dir):
    g = candidates(spark, sf_dir, 20).where("score >= 5").groupBy("query").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.countDistinct("source").alias("domains"))
    return g.select("query", "n", F.round("s", 6).alias("avg_score"), "domains", F.concat_ws(",", F.when(F.col("domains") < 3, "few_domains"), F.when(F.col("s") < 8, "weak")).alias("warnings"))


QUERIES, ORACLE_SQL = query.queries, query.sql
