"""Backend attribution over runs: fallbacks, matched-composition losses, availability, throughput, judged quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions import text as X


def fallback_stats(df: DataFrame, backend: str, outcome: str, query: str) -> DataFrame:
    """Attempts, fired, recovered, skipped, failures, success rate and distinct recovered queries of each backend."""
    n = lambda *names: F.count_if(F.col(outcome).isin(*names))
    fired = n("recovered", "failed")
    return df.groupBy(backend).agg(F.count("*").alias("attempts"), fired.alias("fired"), n("recovered").alias("recovered"), n("skipped").alias("skipped"), n("failed").alias("failures"), F.round(F.when(fired > 0, n("recovered") / fired).otherwise(0.0), 6).alias("success_rate"), F.countDistinct(F.when(F.col(outcome) == "recovered", F.col(query))).alias("recovered_queries"))


def composition_loss(rows: DataFrame, query: str, backends: str, quality: str) -> DataFrame:
    """(query, backend, rest, with_q, without_q, loss, recovered): average quality of result sets that differ by one backend only.

    For each backend of a row the key is the set of the others; rows of exactly that set are the ones without it. A loss of at
    most the larger of 0.1 and a fifth of the quality counts as recovered.
    """
    named = rows.withColumn("_set", F.array_sort(F.array_distinct(backends)))
    mean = F.sum(F.col(quality).cast("decimal(28,8)")).cast("double") / F.count(quality)  # decimals: the same sum in any order
    whole = named.groupBy(query, F.array_join("_set", ",").alias("rest")).agg(mean.alias("without_q"))
    used = named.select(query, quality, "_set", F.explode("_set").alias("backend")).withColumn("rest", F.array_join(F.array_except("_set", F.array("backend")), ","))
    have = used.groupBy(query, "backend", "rest").agg(mean.alias("with_q"))
    loss = F.col("with_q") - F.col("without_q")
    out = have.join(whole, [query, "rest"])
    return out.select(query, "backend", "rest", F.round("with_q", 6).alias("with_q"), F.round("without_q", 6).alias("without_q"), F.round(loss, 6).alias("loss"), (loss <= F.greatest(F.lit(0.1), 0.2 * F.col("with_q"))).alias("recovered"))


def throughput(df: DataFrame, tags: str, seconds: str) -> DataFrame:
    """(tag, n, per_second) with tag 'all' for every row."""
    every = df.select(F.explode(F.concat(F.array(F.lit("all")), F.col(tags))).alias("tag"), seconds)
    return every.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum(seconds), 6).alias("per_second"))


def judge_report(df: DataFrame, precision: str, hallucination: str, relevance: str) -> DataFrame:
    """Composite 0.35 precision + 0.35 (1 - hallucination) + 0.30 relevance: average, median, extremes."""
    c = 0.35 * F.col(precision) + 0.35 * (1 - F.col(hallucination)) + 0.30 * F.col(relevance)
    return df.withColumn("_c", c).agg(F.count("*").alias("answers"), F.round(F.avg("_c"), 6).alias("average"), F.round(F.median("_c"), 6).alias("median"), F.round(F.min("_c"), 6).alias("least"), F.round(F.max("_c"), 6).alias("most"))


def citation_precision(answers: DataFrame, results: DataFrame, key: str, position: str) -> DataFrame:
    """Share of an answer's citations whose position is a result of its key; 1 without citations."""
    cited = answers.select(key, F.explode_outer("citations").alias(position))
    hit = results.select(key, position, F.lit(1).alias("_hit")).distinct()
    g = cited.join(hit, [key, position], "left").groupBy(key).agg(F.count(position).alias("citations"), F.count("_hit").alias("right"))
    return g.select(key, "citations", F.round(F.when(F.col("citations") == 0, 1.0).otherwise(F.col("right") / F.col("citations")), 6).alias("precision"))


def over_broad(urls: DataFrame, host: str, gold: DataFrame, query: str, domain: str) -> DataFrame:
    """Two-label gold domains with the sub-domains that they also match and the queries that name them."""
    two = gold.where(F.size(F.split(domain, r"\.")) == 2).select(query, F.col(domain).alias("_gold")).distinct()
    hosts = urls.select(F.col(host).alias("_host")).distinct().select("_host", F.explode(X.suffixes(F.col("_host"))).alias("_gold")).where("_host <> _gold")
    queries = two.groupBy("_gold").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set(query)), lambda q: q.cast("string"))).alias("queries"))
    return hosts.join(queries, "_gold").groupBy(F.col("_gold").alias("domain"), "queries").agg(F.countDistinct("_host").alias("subdomains"))


def phrase_votes(titles: DataFrame, key: str, title: str, n: int = 5) -> DataFrame:
    """(key, phrase, votes): title words count 1, capitalised phrases 2; the best n of each key."""
    from lumenforge.operators.sessions import newest

    words = F.transform(X.tokens(F.col(title)), lambda w: F.struct(w.alias("phrase"), F.lit(1).alias("v")))
    names = F.transform(F.regexp_extract_all(F.col(title), F.lit(r"\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+\b"), 0), lambda p: F.struct(F.lower(p).alias("phrase"), F.lit(2).alias("v")))
    votes = titles.select(key, F.explode(F.concat(words, names)).alias("x")).groupBy(key, "x.phrase").agg(F.sum("x.v").alias("votes"))
    return newest(votes, [key], [F.desc("votes"), "phrase"], n)


def attach(results: DataFrame, images: DataFrame, key: str, domain: str, title: str, image: str, n: int = 3) -> DataFrame:
    """(key, image, how): up to n images of the result's domain; else the first image whose title shares two words of three letters or more."""
    from lumenforge.operators.sessions import newest

    firsts = newest(images.select(domain, image).where(F.col(domain).isNotNull()), [domain], [image], n).groupBy(domain).agg(F.sort_array(F.collect_list(image)).alias("_images"))
    told = results.select(key, domain, title).join(firsts, domain, "left")
    same = told.select(key, F.explode("_images").alias(image), F.lit("domain").alias("how"))
    # two words are shared if and only if a pair of words is: of each pair only the first image is kept, so no image meets all others
    found = word_pairs(told.where(F.col("_images").isNull()), key, title).join(word_pairs(images, image, title).groupBy("pair").agg(F.min(image).alias(image)), "pair")
    return same.unionByName(found.groupBy(key).agg(F.min(image).alias(image)).select(key, image, F.lit("title").alias("how")))


def word_pairs(df: DataFrame, key: str, title: str) -> DataFrame:
    """(key, pair): every two different words of three letters or more of a title; a title of w words has w * (w - 1) / 2 of them."""
    words = F.array_sort(F.array_distinct(F.filter(X.tokens(F.col(title)), lambda w: F.char_length(w) > 2)))
    later = lambda w: F.transform(F.slice("_w", F.array_position("_w", w).cast("int") + 1, F.size("_w")), lambda v: F.concat_ws(" ", w, v))
    return df.select(key, words.alias("_w")).where(F.size("_w") > 1).select(key, F.explode("_w").alias("_a"), "_w").select(key, F.explode(later(F.col("_a"))).alias("pair"))
