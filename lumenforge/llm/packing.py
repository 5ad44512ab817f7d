"""Operator 1: packing into optimal length buckets.

Dynamic programming over the global length histogram chooses the bucket boundaries with the least padding; documents of a
bucket form batches within a token budget.

The histogram has one entry per length that occurs, up to `EXACT` words; the few texts beyond lie in steps of 1/1024 of the
length, so its size is bounded whatever the corpus, and it covers every document. Boundaries lie on real maximum lengths of an
entry, so padding is counted exactly for the chosen boundaries; they are optimal if no boundary falls beyond `EXACT`, and else
within 1/1024 of the lengths there. Batches are numbered inside shards of a bucket (a document's shard comes from its hash and,
so that very many equal rows are no burden, from the partition it is read from; the number of shards grows with the bucket), so
no bucket is sorted or numbered by one task.

Defined results: a null text has 0 tokens and is packed like an empty one, into the first bucket; a document longer than the
budget is a batch of its own; equal lengths are ordered by a hash of the row; repeated rows are separate documents; an empty
table gives an empty table; further columns of any type pass unchanged, but an output replaces an old column of its name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenforge.llm.shared import cleared, free_name

BUCKETS, TOKEN_BUDGET, SHARD_ROWS = 12, 65_536, 20_000
#: Lengths up to EXACT are levels of their own; above, there are STEPS levels for each doubling.
EXACT, STEPS = 1 << 16, 1024

OUT = ["bucket", "bucket_length", "batch_id", "slot", "padding"]


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level_of(length: Column) -> Column:
    """Level of a length: itself up to EXACT, then STEPS levels for each doubling."""
    steps = F.floor((F.log2(length.cast("double")) - float(np.log2(EXACT))) * STEPS)
    return F.when(length <= EXACT, length).otherwise(F.lit(EXACT + 1) + steps).cast("long")


def hashable(kind: T.DataType) -> bool:
    """Whether Spark has a hash of this type: not of maps."""
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    return hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def histogram(df: DataFrame, length_col: str) -> list:
    """(level, longest, documents, tokens) by level; at most EXACT rows, and STEPS for each doubling beyond it."""
    rows = df.groupBy(level_of(F.col(length_col)).alias("level")).agg(F.max(length_col).alias("longest"), F.count("*").alias("n"), F.sum(length_col).alias("tokens")).collect()
    return sorted(rows, key=lambda r: r.level)


def boundaries(lengths: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Indices of the longest level of each bucket: the division into at most `buckets` with the least padding.

    cost(i, j) = length_j * documents(i..j) - tokens(i..j) satisfies the quadrangle inequality, so the best cut moves
    monotonically and each layer takes n log n steps by divide and conquer.
    """
    n = len(lengths)
    docs, held = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(tokens))
    buckets = min(buckets, n)
    best = lengths * docs[1:] - held[1:]
    cuts = []
    for layer in range(1, buckets):
        now, cut = best.copy(), np.full(n, -1)
        todo = [(layer, n - 1, layer - 1, n - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            k = np.arange(first, min(last, mid - 1) + 1)
            cost = best[k] + lengths[mid] * (docs[mid + 1] - docs[k + 1]) - (held[mid + 1] - held[k + 1])
            at = int(np.argmin(cost))
            now[mid], cut[mid] = cost[at], k[at]
            todo += [(lo, mid - 1, first, int(k[at])), (mid + 1, hi, int(k[at]), last)]
        best = now
        cuts.append(cut)
    ends, at = [n - 1], n - 1
    for cut in reversed(cuts):
        at = int(cut[at])
        if at < 0:
            break
        ends.append(at)
    return ends[::-1]


def pack(df: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS, text_col: str = "text") -> DataFrame:
    """df with n_tokens, bucket, bucket_length, batch_id, slot and padding."""
    df = cleared(df, ["n_tokens", *OUT], [text_col])
    counted = df.withColumn("n_tokens", word_count(F.col(text_col)) if length is None else length.cast("long"))
    rows = histogram(counted.select("n_tokens"), "n_tokens")
    if not rows:
        rows = [type("Row", (), {"level": 0, "longest": 0, "n": 0, "tokens": 0})()]
    lengths, counts, tokens = (np.array([getattr(r, k) for r in rows], np.int64) for k in ("longest", "n", "tokens"))
    ends = boundaries(lengths, counts, tokens, buckets)
    docs = np.append(0, np.cumsum(counts))
    level = level_of(F.col("n_tokens"))
    bucket, size, shards = F.lit(None), F.lit(None), F.lit(None)
    start = 0
    for k, end in reversed(list(enumerate(ends))):
        held = int(docs[end + 1] - docs[ends[k - 1] + 1 if k else start])
        inside = level <= int(rows[end].level)
        bucket = F.when(inside, F.lit(k)).otherwise(bucket)
        size = F.when(inside, F.lit(int(lengths[end]))).otherwise(size)
        shards = F.when(inside, F.lit(-(-held // shard_rows) or 1)).otherwise(shards)
    row_hash = free_name(df, "_row_hash")
    shard = free_name(df, "_shard")
    placed = counted.withColumn("bucket", bucket.cast("int")).withColumn("bucket_length", size.cast("long"))
    named = [F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f.dataType)] or [F.col("n_tokens")]
    placed = placed.withColumn(row_hash, F.xxhash64(*named)).withColumn(shard, F.pmod(F.xxhash64(F.col(row_hash), F.spark_partition_id()), shards.cast("long")))
    order = Window.partitionBy("bucket", shard).orderBy(F.col("n_tokens"), F.col(row_hash))
    per_batch = F.greatest(F.floor(F.lit(token_budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1))
    number = F.row_number().over(order) - 1
    place = free_name(df, "_place")
    out = placed.withColumn(place, number).withColumn("batch_id", F.concat_ws("-", F.col("bucket"), F.col(shard), F.floor(F.col(place) / per_batch))).withColumn("slot", (F.col(place) % per_batch).cast("int"))
    return out.withColumn("padding", F.col("bucket_length") - F.col("n_tokens")).select(*[f"`{c}`" for c in df.columns], "n_tokens", *OUT)
