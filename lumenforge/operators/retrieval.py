"""Retrieval of a table of queries against a corpus: BM25 of postings, vectors, rank fusion, deduplication. For the kept index see text_index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions import text as X

K1, B = 1.5, 0.75
#: Rows of a block in the exact vector search, pairs of blocks in a task at most on average: an Arrow batch may hold all of a task's pairs.
BLOCK_ROWS, TASK_PAIRS = 2048, 4


def idf(n: Column, df: Column) -> Column:
    return F.log(F.greatest(F.lit(1.0), (n - df + 0.5) / (df + 0.5)) + 1)


def bm25(queries: DataFrame, index: DataFrame, stats: DataFrame, settings: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """(run, query, doc, score) of all documents with a term of a query, for queries (query, term); for the best k see text_index.search(). Only the query terms of the index are joined and shuffled by (query, doc).

    settings: (run, k1, b) of runs that are scored over one join. The statistics are one row, so that side has one row.
    """
    settings = settings or [(1, K1, B)]
    wanted = queries.select("query", "term").distinct()
    hits = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    terms = wanted.join(df, "term").crossJoin(F.broadcast(stats)).select("query", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len")
    pairs = hits.join(terms, "term")
    runs = F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("run"), F.lit(float(k)).alias("k1"), F.lit(float(b)).alias("b")) for r, k, b in settings])).alias("s")
    x = pairs.select("query", "doc", "tf", "doc_len", "idf", "avg_len", runs)
    part = F.col("idf") * F.col("tf") * (F.col("s.k1") + 1) / (F.col("tf") + F.col("s.k1") * (1 - F.col("s.b") + F.col("s.b") * F.col("doc_len") / F.col("avg_len")))
    return x.groupBy(F.col("s.run").alias("run"), "query", "doc").agg(F.round(F.sum(part), 9).alias("score"))


def top_k(df: DataFrame, key: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The best k rows of each key with their rank from 1; ties by id."""
    by = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def scaled_by_max(df: DataFrame, key: list[str], score: str) -> DataFrame:
    return df.withColumn(score, F.col(score) / F.max(score).over(Window.partitionBy(*key)))


def min_max(df: DataFrame, key: list[str], score: str, out: str) -> DataFrame:
    """Min-max scaling inside each key; a constant key becomes 0.5."""
    by = Window.partitionBy(*key)
    low, high = F.min(score).over(by), F.max(score).over(by)
    return df.withColumn(out, F.when(high == low, 0.5).otherwise((F.col(score) - low) / (high - low)))


def rank_fusion(lists: list[tuple[DataFrame, float]], query: str, doc: str, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (query, doc, rank): sum w / (k + rank), ties by first appearance then id."""
    parts = [df.select(query, doc, (F.lit(float(w)) / (k + F.col("rank"))).alias("_p"), (F.lit(i * 1_000_000) + F.col("rank")).alias("_seen")) for i, (df, w) in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy(query, doc).agg(F.round(F.sum("_p"), 9).alias("score"), F.min("_seen").alias("_seen"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "_seen", doc)).cast("long")).drop("_seen")


def vector_blocks(df: DataFrame, id_col: str, vector: str, rows: int) -> DataFrame:
    """(block, ids, vectors): rows packed into blocks of about `rows`; the number of blocks grows with the table."""
    n = max(1, -(-df.count() // rows))
    return df.where(F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("items"))


def pair_tasks(queries: int, corpus: int, block_rows: int, cores: int) -> int:
    """Tasks for the pairs of blocks: they grow with the pairs, so that a task's memory doesn't."""
    pairs = max(1, -(-queries // block_rows)) * max(1, -(-corpus // block_rows))
    return max(1, cores, -(-pairs // TASK_PAIRS))


def vector_top_k(queries: DataFrame, corpus: DataFrame, id_col: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, doc, score, rank): exact cosine top k of each query, other than itself.

    Blocks of queries meet blocks of vectors, one matrix product for each pair of blocks; a pair returns k rows a query.
    """
    q = vector_blocks(queries, id_col, vector, block_rows).select(F.col("items").alias("q"))
    c = vector_blocks(corpus, id_col, vector, block_rows).select(F.col("items").alias("c"))
    per_block = k

    def products(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, mats = [], []
                for side in (0, 1):
                    items = batch.column(side)[row].values
                    ids.append(items.field("id").to_numpy())
                    flat = items.field("v").flatten().to_numpy(zero_copy_only=False)
                    m = flat.reshape(len(ids[-1]), -1)
                    mats.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))
                scores = np.round(mats[0] @ mats[1].T, 9)
                scores[ids[0][:, None] == ids[1][None, :]] = -2
                order = np.lexsort((np.broadcast_to(ids[1], scores.shape), -scores), axis=1)[:, :per_block]
                best = np.take_along_axis(scores, order, 1)
                good = best > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[0], order.shape[1])[good.ravel()]), pa.array(ids[1][order].ravel()[good.ravel()]), pa.array(best.ravel()[good.ravel()])], names=["query", "doc", "score"])

    pairs = c.crossJoin(q).select("q", "c").repartition(pair_tasks(queries.count(), corpus.count(), block_rows, c.sparkSession.sparkContext.defaultParallelism))
    return top_k(pairs.mapInArrow(products, "query long, doc long, score double"), ["query"], "score", "doc", k)


def dedup_results(df: DataFrame, key: list[str], url: str, title: str, score: str) -> DataFrame:
    """One row for each canonical URL, then for each non-empty title key; the higher score wins, ties by URL."""
    u, t = X.canonical_url(F.col(url)), X.title_key(F.coalesce(F.col(title), F.lit("")))
    keyed = df.withColumn("_u", u).withColumn("_t", t)
    first = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "_u").orderBy(F.desc(score), url))).where("_rn = 1")
    own = F.when(F.col("_t") == "", F.concat(F.lit("\u0001"), F.col("_u"))).otherwise(F.col("_t"))
    return first.withColumn("_o", own).withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "_o").orderBy(F.desc(score), url))).where("_rn = 1").drop("_u", "_t", "_o", "_rn")
