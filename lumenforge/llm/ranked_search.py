"""Ranked lexical search: accumulator-limited term-at-a-time evaluation over blocks of documents.

1. One pass over the texts writes an index to the shared folder: for each document its number of terms and the query terms that it
   holds with their frequencies, and for each batch the counts of documents, terms and documents holding a term, which are added up.
2. Tasks read blocks of `BLOCK_DOCS` indexed documents, turn them into postings by term, and evaluate each item term at a time.
   Terms come rarest first (by their frequency in the corpus). A document that holds a term gets an accumulator, as long as the
   sum of the greatest possible contributions of this and all later terms reaches the kth best partial score known (of the block, or
   of complete scores of earlier blocks of the task). From then on no new accumulator is made, because a document without one can't
   reach the best k; documents that have one are still updated with every later posting, so their scores are exact. Equal
   scores are decided by doc_id, so creation stops only where the bound is strictly below the kth score.
3. The best k of each item of each task are merged over `MERGE_PARTS` parts of an item, then over items.

Scores are 64-bit integers, as the contract of `op11` gives them. Terms are runs of ASCII letters, digits and other characters
from U+0080, with A-Z lower-cased. Query terms are found by hashes of their bytes and compared byte by byte.

Defined results: a null text has no terms and no document without terms counts; a row of documents is a document, so repeated rows
rank one after another; an item without terms, or whose terms no document holds, has no rows; rows of one item_id are items of
their own; an empty table gives an empty result. Items are taken in blocks of `ITEM_BLOCK`, their terms in the same blocks: that
bounds what is sent to the tasks, and the index is written once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.llm import flat
from lumenforge.llm.shared import dropped, kept

#: Items and characters of a block of items, documents that are evaluated at once, parts in which candidates of an item are first merged.
ITEM_BLOCK, ITEM_CHARS, BLOCK_DOCS, MERGE_PARTS = 2048, 1 << 24, 8192, 64
#: The separators of terms: ASCII but letters and digits.
GAP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Constants of the score (fixed values of the contract).
ONE, TF_SCALE, LENGTH_SCALE, SHARE, PERCENT, WEIGHT = 1_000_000_000, 1000, 8, 75, 100, 1000


class Vocabulary:
    """The distinct terms of some items, found in texts by hash and verified by their bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b" ".join(terms) + b" ", np.uint8)
        self.words = flat.Words(data, np.array([0, len(data)]), GAP)
        self.order = np.argsort(self.words.hashes, kind="stable")
        self.hashes = self.words.hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two query terms share a hash")  # once in 2^64 pairs of long terms; never for terms up to eight bytes

    def found(self, words: flat.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words that are terms."""
        if not len(self.hashes) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, words.hashes)
        who = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == words.hashes)
        term = self.order[at[who]]
        same = words.equal_to(who, self.words, term)
        return who[same], term[same]


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = flat.Words(data, np.array([0, len(data)]), GAP, fold=True, hashed=False)
    raw = words.data.tobytes()
    return [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]


def index(docs: DataFrame, terms: list[bytes], doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, terms, tfs): documents with at least one term, their length, and the numbers and frequencies of the query terms in them."""
    given = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        vocabulary = Vocabulary(given.value)
        for batch in batches:
            for row, data, offsets in flat.text_parts(batch.column(1)):
                words = flat.Words(data, offsets, GAP, fold=True)
                word, term = vocabulary.found(words)
                doc = np.searchsorted(words.first, word, "right") - 1
                pair, tf = np.unique(doc * max(len(given.value), 1) + term, return_counts=True)
                doc, term = np.divmod(pair, max(len(given.value), 1))
                keep = np.flatnonzero(words.count)
                ends = np.searchsorted(doc, np.append(keep, len(words.count)))
                offsets = pa.array(ends.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(words.count)).take(pa.array(keep)), pa.array(words.count[keep].astype(np.int64)), *lists], names=["doc", "n", "terms", "tfs"])

    return docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>")


def statistics(indexed: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms, documents holding each query term); the counts are added up in the tasks first."""

    def run(batches):
        told, df = np.zeros(2, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            told += batch.num_rows, int(np.sum(batch.column(0).to_numpy()))
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)[:n_terms]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([told, df[held]]))], names=["term", "n"])

    rows = indexed.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(k, 0) for k in range(n_terms)], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Postings:
    """A block of documents, by term: documents and their contributions for one occurrence in an item, and the greatest of these."""

    def __init__(self, n: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, n_total: int, weight: np.ndarray):
        self.size = len(n)
        length = PERCENT - SHARE + (SHARE * n * n_docs) // n_total
        order = np.argsort(terms, kind="stable")
        self.docs, terms, tfs = docs[order], terms[order], tfs[order].astype(np.int64)
        self.gains = weight[terms] * ((ONE * tfs) // (TF_SCALE * tfs + LENGTH_SCALE * length[self.docs]))
        self.starts = np.searchsorted(terms, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gains, self.starts[held])

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents that may be among the best k, with exact scores; at least floor, and above 0.

        terms: rarest first; floor: a score that k documents elsewhere reach."""
        held = np.flatnonzero(self.most[terms])
        terms, repeats = terms[held], repeats[held]
        left = np.cumsum((self.most[terms] * repeats)[::-1])[::-1]
        scores = np.zeros(self.size, np.int64)
        creating, bar = self.size > 0, max(floor, 1)
        for j, (term, times) in enumerate(zip(terms.tolist(), repeats.tolist(), strict=True)):
            if creating and self.size >= k and left[j] < left[0] - left[j]:  # else no partial score can exceed the bound
                bar = max(bar, int(np.partition(scores, self.size - k)[self.size - k]))
            creating = creating and left[j] >= bar
            docs, gains = self.docs[self.starts[term] : self.starts[term + 1]], self.gains[self.starts[term] : self.starts[term + 1]]
            if not creating:
                survivors = scores[docs] > 0
                docs, gains = docs[survivors], gains[survivors]
            scores[docs] += times * gains
        who = np.flatnonzero(scores >= bar)
        return who, scores[who]


def _ranked(batches, items, weight, n_docs: int, n_total: int, k: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    """The best k of each item among the documents of a task."""
    kept_ids, kept_scores = [np.zeros(0, np.int64)] * len(items), [np.zeros(0, np.int64)] * len(items)

    def evaluate(batch: pa.RecordBatch) -> None:
        n = batch.column(1).to_numpy().astype(np.int64)
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = np.where(known, batch.column(0).fill_null(0).to_numpy(), np.iinfo(np.int64).min)
        postings = Postings(n, np.repeat(np.arange(len(n)), sizes), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), n_docs, n_total, weight)
        for i, (terms, repeats) in enumerate(items):
            floor = int(kept_scores[i][-1]) if len(kept_scores[i]) == k else 0
            who, scores = postings.best(terms, repeats, k, floor)
            if len(who):
                all_ids, all_scores = np.concatenate([kept_ids[i], ids[who]]), np.concatenate([kept_scores[i], scores])
                order = np.lexsort((all_ids, -all_scores))[:k]
                kept_ids[i], kept_scores[i] = all_ids[order], all_scores[order]

    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= block_docs:
            evaluate(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
            waiting, rows = [], 0
    if rows:
        evaluate(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
    sizes = [len(x) for x in kept_ids]
    part = np.full(sum(sizes), TaskContext.get().partitionId() % MERGE_PARTS, np.int64)
    ids = np.concatenate(kept_ids) if sizes else np.zeros(0, np.int64)
    found = pa.array(ids, mask=ids == np.iinfo(np.int64).min)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items)), sizes)), pa.array(part), found, pa.array(np.concatenate(kept_scores) if sizes else ids)], names=["item", "part", "doc_id", "score"])


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. The queries may be any number, a block of them is on the driver at a time."""
    spark = docs.sparkSession
    numbered = kept(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    out, last = None, -1
    while True:
        sizes = numbered.where(F.col("item") > last).select("item", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).orderBy("item").limit(ITEM_BLOCK).collect()
        if not sizes and out is not None:
            return out
        taken = max(1, int(np.searchsorted(np.cumsum([r.n for r in sizes]), ITEM_CHARS, "right")))
        before, last = last, sizes[:taken][-1].item if sizes else last
        rows = numbered.where((F.col("item") > before) & (F.col("item") <= last)).orderBy("item").collect()
        listed = [terms_of(r.text) for r in rows]
        terms = sorted({t for found in listed for t in found})
        number = {t: k for k, t in enumerate(terms)}
        indexed = kept(index(docs, terms, doc_col, text_col), "search-index")
        n_docs, n_total, df = statistics(indexed, len(terms))
        weight = weights(n_docs, df)
        plans = []
        for found in listed:
            own, repeats = np.unique(np.array([number[t] for t in found], np.int64), return_counts=True)
            order = np.lexsort((own, df[own]))  # rarest first
            plans.append((own[order], repeats[order]))
        sent = spark.sparkContext.broadcast((plans, weight))

        def run(batches, sent=sent, n_docs=n_docs, n_total=n_total):
            return _ranked(batches, *sent.value, n_docs, n_total, k, block_docs)

        best = _top(_top(indexed.mapInArrow(run, "item long, part long, doc_id long, score long"), ["item", "part"], k).drop("rank"), ["item"], k)
        # the number of a row in its block is its place in `rows`
        names = spark.createDataFrame([(place, r.item) for place, r in enumerate(rows)], "place long, item long").join(numbered.drop("text"), "item").select(F.col("place").alias("item"), "item_id")
        found = kept(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        dropped(indexed)
        out = found if out is None else out.unionByName(found)
        if len(rows) == len(sizes) < ITEM_BLOCK:
            return out
