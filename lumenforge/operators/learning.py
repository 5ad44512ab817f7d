"""Learning to rank: labelled features, models, blends and drift."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def importance(rows: DataFrame, features: str, label: str) -> DataFrame:
    """(feature, importance): absolute difference of the means of positives and negatives, divided by the largest."""
    x = rows.select(label, F.posexplode(features).alias("feature", "x"))
    g = x.groupBy("feature").agg((F.avg(F.when(F.col(label) > 0, F.col("x"))) - F.avg(F.when(F.col(label) <= 0, F.col("x")))).alias("gap"))
    top = g.agg(F.max(F.abs("gap")).alias("top"))
    return g.crossJoin(F.broadcast(top)).select(F.col("feature").cast("long").alias("feature"), F.round(F.abs("gap") / F.col("top"), 6).alias("importance"))


def set_stats(rows: DataFrame, query: str, domain: str, label: str) -> DataFrame:
    return rows.agg(F.count("*").alias("examples"), F.count_if(F.col(label) > 0).alias("positives"), F.count_if(F.col(label) <= 0).alias("negatives"), F.countDistinct(query).alias("queries"), F.countDistinct(domain).alias("domains"))


def split(key: Column, share: float = 0.8) -> Column:
    """train or test by a hash of the group key, so that no group is on both sides."""
    return F.when(F.pmod(F.xxhash64(key), F.lit(1000)) < int(1000 * share), "train").otherwise("test")


#: The places of the long feature vector, and those of them that the short one takes.
LONG_FEATURES = "q_len q_terms q_has_question q_has_number q_has_cjk title_len content_len snippet_len has_date date_recency has_images title_overlap content_overlap snippet_overlap title_exact_match bm25_title bm25_content tfidf_avg domain_authority domain_age_proxy is_major_domain result_source result_position is_news_source is_academic_source query_type_num is_news is_finance korean chinese user_visited user_visits_norm".split()
SHORT_PLACES = [0, 1, 5, 6, 11, 12, 18, 9, 26, 27, 28, 29, 25, 30, 31, 18]
#: Characters of a snippet; documents and frequency that stand for every term in the simplified inverse frequencies.
SNIPPET = 200


def feature_terms(text: Column) -> Column:
    """Lower-case words of letters and digits, two characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) > 1)


def query_tokens(text: Column) -> Column:
    """Distinct words of a query and the two-character pieces of its CJK text."""
    cjk = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]", "")
    n = F.char_length(cjk)
    pieces = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(cjk, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(feature_terms(text), pieces))


def counts_of():
    """A function of (terms, words): how often each term occurs among the words, in one pass over them.

    Arrow batches carry the word lists; a built-in expression would compare each term with each word of a whole text."""
    @F.pandas_udf("array<int>")
    def counted(terms: pd.Series, words: pd.Series) -> pd.Series:
        told = ({} if w is None else Counter(w) for w in words)
        return pd.Series([[n.get(t, 0) for t in ([] if own is None else own)] for own, n in zip(terms, told, strict=True)])

    return counted


def long_features(df: DataFrame, major: list[str], news: list[str], academic: list[str]) -> DataFrame:
    """df with the 32 numbers of LONG_FEATURES, each between 0 and 1 (the authority between 0 and 0.3).

    df: query_text, title, content, age_days (null without a date), has_images, domain, authority, age_proxy, source_share,
    position, visits. The word lists of a row are cut once, in columns of their own.
    """
    cut = df.withColumns({"_q": query_tokens(F.col("query_text")), "_t": feature_terms(F.col("title")), "_c": feature_terms(F.col("content")), "_lt": F.lower(F.coalesce("title", F.lit(""))), "_lc": F.lower(F.coalesce("content", F.lit("")))})
    text, one = F.lower("query_text"), lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    capped = lambda c: F.least(F.lit(1.0), c.cast("double"))
    n = F.size("_q")

    def overlap(lower: Column) -> Column:
        return F.when((n == 0) | (lower == ""), 0.0).otherwise(F.size(F.filter("_q", lambda t: F.contains(lower, t))) / n)

    counted = counts_of()

    def bm25(words: Column) -> Column:
        idf = math.log(1 + (1_000_000 - 1000 + 0.5) / (1000 + 0.5))
        tfs = counted(F.col("_q"), words)
        return capped(F.aggregate(tfs, F.lit(0.0), lambda a, tf: a + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * F.size(words) / 100.0))) / 10)

    is_news, is_finance = text.rlike(r"\b(news|latest|breaking|headline)"), text.rlike(r"\b(stock|market|price|finance|bank)")
    korean, chinese = text.rlike(r"[\x{AC00}-\x{D7AF}]"), text.rlike(r"[\x{4E00}-\x{9FFF}]")
    known = F.size(F.array_intersect("_q", "_c"))
    values = [
        capped(F.char_length("query_text") / 100), capped(n / 20), one(text.rlike(r"\?|어떻게|무엇|왜|어디|언제|누구|什么|怎么|为什么|如何")), one(text.rlike(r"\d")), one(korean | chinese | text.rlike(r"[\x{3040}-\x{30FF}]")),
        capped(F.char_length(F.coalesce("title", F.lit(""))) / 200), capped(F.char_length(F.coalesce("content", F.lit(""))) / 2000), capped(F.least(F.char_length(F.coalesce("content", F.lit(""))), F.lit(SNIPPET)) / SNIPPET),
        one(F.col("age_days").isNotNull()), F.when(F.col("age_days").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("age_days") / 365))), one(F.col("has_images")),
        overlap(F.col("_lt")), overlap(F.col("_lc")), overlap(F.substring("_lc", 1, SNIPPET)), one(F.contains(F.col("_lt"), text)), bm25(F.col("_t")), bm25(F.col("_c")), F.when(n > 0, capped(known * math.log(101) / (n * 5))).otherwise(0.0),
        F.col("authority"), F.col("age_proxy"), one(F.col("domain").isin(major)),
        F.col("source_share"), capped(F.col("position") / 20), one(F.col("domain").isin(news)), one(F.col("domain").isin(academic)),
        F.when(is_news, 1.0).when(is_finance, 2.0).otherwise(0.0) / 3, one(is_news), one(is_finance), one(korean), one(chinese),
        one(F.col("visits") > 0), capped(F.col("visits") / 10),
    ]
    return cut.withColumns(dict(zip(LONG_FEATURES, values, strict=True))).drop("_q", "_t", "_c", "_lt", "_lc")


def projected(features: Column) -> Column:
    """The short vector of a long one; a vector of another length gives its first sixteen places."""
    return F.when(F.size(features) == len(LONG_FEATURES), F.transform(F.array(*map(F.lit, SHORT_PLACES)), lambda i: F.get(features, i))).otherwise(F.slice(features, 1, len(SHORT_PLACES)))


def usable(rows: DataFrame, group: str) -> DataFrame:
    """Rows of groups with two items or more."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n >= 2").select(group)
    return rows.join(sizes, group, "left_semi")


def blend(model_score: Column, current: Column, weight: float = 0.6) -> Column:
    return weight * model_score + (1 - weight) * current


def classification_metrics(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return rows.agg(F.round(F.count_if(truth == predicted) / F.count("*"), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def drift(now: DataFrame, baseline: DataFrame, features: list[str], threshold: float = 0.1, least: int = 1000) -> DataFrame:
    """(feature, shift, drifted): mean against the baseline mean in baseline standard deviations."""

    def long(df: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p")
        return df.select(pairs).select("p.*")

    a = long(baseline).groupBy("feature").agg(F.avg("x").alias("m0"), F.stddev_samp("x").alias("s0"))
    b = long(now).groupBy("feature").agg(F.avg("x").alias("m1"), F.count("*").alias("n"))
    shift = F.abs(F.col("m1") - F.col("m0")) / F.col("s0")
    return b.join(a, "feature").select("feature", F.round(shift, 6).alias("shift"), ((F.col("n") >= least) & (shift > threshold)).alias("drifted"))
