"""Substring search over short columns: trigram postings give candidates, the columns themselves decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.operators.joins import block_join
from lumenforge.sources.storage import kept

#: Characters of a gram; shorter terms can't be looked up.
GRAM = 3


def grams(text: Column) -> Column:
    """The distinct grams of a lower-cased text; none if it is shorter."""
    n = F.char_length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def containing(queries: DataFrame, docs: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """(query, doc) of documents each of whose queries' terms (query, term) occurs in one of some columns, letters of either case alike.

    Terms of fewer than GRAM characters don't count; a query without others finds nothing. A term is looked up by the rarest of its grams,
    so it meets the documents with that gram only; grams that very many terms and documents share are joined in blocks.
    """
    texts = docs.select(F.col(doc).alias("doc"), *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"_c{k}") for k, c in enumerate(columns)])
    names = [f"_c{k}" for k in range(len(columns))]
    postings = kept(texts.select("doc", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, map(F.col, names)))))).alias("gram")), "gram-postings")
    df = postings.groupBy("gram").agg(F.count("*").alias("df"))
    wanted = queries.select("query", F.lower("term").alias("term")).where(F.char_length("term") >= GRAM).distinct()
    needs = wanted.groupBy("query").agg(F.count("*").alias("n"))
    terms = wanted.select("term").distinct().select("term", F.explode(grams(F.col("term"))).alias("gram"))
    rarest = kept(terms.join(df, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).where("g.df > 0").select("term", "g.gram"), "rarest-grams")
    met = block_join(rarest, postings, "gram", F.col("term"), F.col("doc")).select("term", "doc").join(texts, "doc")
    held = met.where(F.array_max(F.array(*[F.contains(F.col(c), F.col("term")) for c in names]))).select("term", "doc")
    found = wanted.join(held, "term").groupBy("query", "doc").agg(F.count("*").alias("m"))
    return found.join(needs, "query").where("m = n").select("query", "doc")
