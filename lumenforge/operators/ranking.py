"""Scoring and selection of candidate rows: field-weighted BM25, heuristic blends, diversity, extractive answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X


def field_bm25(terms: Column, title: Column, content: Column, weight: float = 2.0, k1: float = 1.5, b: float = 0.75, usual: float = 150.0) -> Column:
    """Corpus-free BM25 of one candidate (tokens of its title and content) in [0.01, 0.99]: tf = weight * title + content with a fixed idf; 0.5 without terms, 0.01 without a match."""
    t, c = title, content
    length = F.size(c) + weight * F.size(t)

    def one(term: Column) -> Column:
        tf = weight * F.size(F.filter(t, lambda w: w == term)) + F.size(F.filter(c, lambda w: w == term))
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / usual))

    total = F.aggregate(terms, F.lit(0.0), lambda a, term: a + one(term))
    score = F.greatest(F.lit(0.01), F.least(F.lit(0.99), total / (F.size(terms) * (k1 + 1))))
    return F.when(F.size(terms) == 0, 0.5).when(total == 0, 0.01).otherwise(score)


def relevance(terms: Column, title: Column, content: Column, age_days: Column, authority: Column) -> Column:
    """Heuristic relevance of the tokens of a title and content: title hits 0.6, content hits 0.3, base 0.05, freshness and authority up to 0.1 each, capped at 1."""
    t, c = title, content
    n = F.greatest(F.size(terms), F.lit(1))
    in_title, in_text = F.size(F.array_intersect(terms, t)) / n, F.size(F.array_intersect(terms, c)) / n
    fresh = 0.1 * F.exp(-F.greatest(age_days, F.lit(0)) / 30.0)
    return F.least(F.lit(1.0), 0.05 + 0.6 * in_title + 0.3 * in_text + F.coalesce(fresh, F.lit(0.0)) + 0.1 * F.coalesce(authority, F.lit(0.0)))


def blended(bm25: Column, heuristic: Column, boost: Column, authority: Column) -> Column:
    """0.7 BM25 + 0.3 heuristic + boost, at least 0.01; authority takes a tenth of the head-room that is left."""
    base = F.greatest(F.lit(0.01), F.least(F.lit(1.0), 0.7 * bm25 + 0.3 * heuristic + boost))
    return base + authority * (1 - base) * 0.1


def expansion_boost(terms: Column, title: Column, content: Column) -> Column:
    """0.04 for each expansion term in the title, else 0.02 in the content; 0.05 at most."""
    t, c = F.lower(title), F.lower(content)
    return F.least(F.lit(0.05), F.aggregate(terms, F.lit(0.0), lambda a, w: a + F.when(F.contains(t, w), 0.04).when(F.contains(c, w), 0.02).otherwise(0.0)))


def recency(age_days: Column) -> Column:
    return F.exp(-age_days / 30.0)


def freshness_blend(score: Column, age_days: Column, weight: float = 0.15) -> Column:
    return score + weight * recency(age_days) * (1 - score)


def content_quality(text: Column) -> Column:
    """Length band, sentences, lexical diversity and special characters, each worth a quarter."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    n = F.size(words)
    band = F.when(n.between(50, 2000), 1.0).when(n > 0, 0.5).otherwise(0.0)
    lines = F.least(F.lit(1.0), F.regexp_count(text, F.lit("[.!?]")) / 5.0)
    lexical = F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(0.0)
    special = 1 - F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / F.greatest(F.char_length(text), F.lit(1)) * 10)
    return 0.25 * (band + lines + lexical + special)


def mmr(df: DataFrame, key: str, item: str, score: str, domain: str, terms: str, k: int = 10, trade: float = 0.7, per_domain: int = 3, least: int = 5) -> DataFrame:
    """Maximal marginal relevance per key over a bounded pool: token Jaccard, at most per_domain rows of a domain, -0.15 for each
    repeat of a domain; below `least` rows it is refilled in the order of scores, at 0.8 of the score. Ties by item. The pool of a key is one group, so callers bound it (top candidates)."""

    def select(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values([score, item], ascending=[False, True]).reset_index(drop=True)
        sets = [frozenset(x) for x in pool[terms]]
        names, base = pool[domain].tolist(), pool[score].to_numpy(float)
        chosen, left, used = [], list(range(len(pool))), {}
        nearest = np.zeros(len(pool))
        while left and len(chosen) < k:
            open_ = [i for i in left if used.get(names[i], 0) < per_domain]
            if not open_:
                break
            values = [(round(trade * base[i] - (1 - trade) * nearest[i] - 0.15 * used.get(names[i], 0), 9), -i) for i in open_]
            best = open_[max(range(len(open_)), key=values.__getitem__)]
            chosen.append(best)
            left.remove(best)
            used[names[best]] = used.get(names[best], 0) + 1
            for i in left:
                union = len(sets[i] | sets[best])
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / union if union else 0.0)
        filled = left[: max(0, min(least, k) - len(chosen))]  # left is in the order of scores
        out = pool.loc[chosen + filled, [key, item, score]].copy()
        out.loc[filled, score] *= 0.8
        out["place"] = np.arange(1, len(out) + 1)
        return out

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {item} {df.schema[item].dataType.simpleString()}, {score} double, place long"
    return df.select(key, item, F.col(score).cast("double"), domain, terms).groupBy(key).applyInPandas(select, schema)


def extractive_answer(results: DataFrame, queries: DataFrame, key: str, rank: str, text: str, n_results: int = 5, n_sentences: int = 5) -> DataFrame:
    """Per query: the best sentences of its top results in source order with [rank] marks; near-equal sentences are taken once.

    queries: key, terms. A sentence scores by its share of query terms, then by rank and position; one with a word Jaccard over 0.7 to a better
    one is passed over, however many there are. The sentences of one query's top results are one bounded group.
    """
    s = results.where(F.col(rank) <= n_results).select(key, rank, F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence")).join(queries.select(key, "terms"), key)
    s = s.withColumn("words", F.array_distinct(X.tokens(F.col("sentence")))).withColumn("hit", F.size(F.array_intersect("words", "terms")) / F.greatest(F.size("terms"), F.lit(1))).where("hit > 0")

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["hit", rank, "pos"], ascending=[False, True, True])
        better: dict[frozenset, None] = {}  # in the order of places; equal sets are compared once
        taken = []
        for row, words in enumerate(pool["words"]):
            own = frozenset(words)
            if own not in better and not any(len(own & w) / len(own | w) > 0.7 for w in better):
                taken.append(row)
                if len(taken) == n_sentences:
                    break
            better[own] = None
        return pool.iloc[taken][[key, rank, "pos", "sentence"]]

    kinds = s.select(key, rank, "pos", "sentence").schema
    best = s.select(key, rank, "pos", "sentence", "words", "hit").groupBy(key).applyInPandas(pick, kinds)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(rank, "pos", "sentence"))), lambda x: F.concat(x["sentence"], F.lit(" ["), x[rank].cast("string"), F.lit("]")))
    return best.groupBy(key).agg(F.concat_ws(" ", parts).alias("answer"), F.count("*").alias("sentences"))


def sentence_packs(sentences: list[str], pack_chars: int) -> list[str]:
    """Sentences joined by spaces; one that would make a pack longer than pack_chars starts the next. A longer sentence is a pack of its own."""
    packs: list[str] = []
    for sentence in sentences:
        if packs and len(packs[-1]) + len(sentence) <= pack_chars:
            packs[-1] += " " + sentence
        else:
            packs.append(sentence)
    return packs


def context_packs(results: DataFrame, key: str, rank: str, title: str, text: str, pack_chars: int = 800, packs: int = 5, limit: float = 0.65, total_chars: int = 12_000, least_chars: int = 40) -> DataFrame:
    """(key, n, rank, pack): the packs of sentences that make a query's context, in the order of their results.

    Packs of at least least_chars are taken by score, ties by rank and place: 1 less 0.08 a rank (0.3 at least), 0.15 if the pack holds the title or
    the title its start, 0.1 for 50 to 500 characters. A pack with a word Jaccard over `limit` to one already taken is passed over; the
    first that would exceed total_chars ends the choice, as do `packs` packs. A query's results are a bounded list.
    """

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        made = []
        for r, group in pool.sort_values([rank, "pos"]).groupby(rank, sort=True):
            name = group["name"].iloc[0] or ""
            for place, pack in enumerate(sentence_packs(group["sentence"].tolist(), pack_chars)):
                if len(pack) >= least_chars:
                    same = name in pack or pack[:50] in name
                    made.append((-(max(0.3, 1 - 0.08 * (r - 1)) + 0.15 * same + 0.1 * (50 <= len(pack) <= 500)), r, place, pack))
        taken, words, size = [], [], 0
        for _, r, place, pack in sorted(made):
            if len(taken) == packs or size + len(pack) > total_chars:
                break
            own = frozenset(pack.lower().split())
            if all(len(own & w) <= limit * len(own | w) for w in words):
                taken.append((r, place, pack))
                words.append(own)
                size += len(pack)
        taken.sort()
        return pd.DataFrame({key: [pool[key].iloc[0]] * len(taken), "n": range(1, len(taken) + 1), rank: [t[0] for t in taken], "pack": pd.Series([t[2] for t in taken], dtype=object)})

    sentences = results.select(key, F.col(rank).cast("long").alias(rank), F.col(title).alias("name"), F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence"))
    return sentences.groupBy(key).applyInPandas(pick, f"{key} {results.schema[key].dataType.simpleString()}, n long, {rank} long, pack string")
