"""Approximate nearest vectors: a coarse quantiser with product-quantised residuals, exact re-ranking of what the codes choose."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.operators.retrieval import top_k
from lumenforge.sources.storage import kept

#: Vectors of the fit (a bound on what the driver holds), coarse lists, parts of a vector, centres of a part.
SAMPLE, LISTS, PARTS, CENTRES = 8192, 64, 16, 256
#: Queries that go to the tasks at once, and the share of a query's neighbours in the sample that its probed lists must hold.
QUERY_BLOCK, HELD = 2048, 0.98


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def centres_of(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows on; an empty cluster keeps its centre. Fewer rows than k are their own centres."""
    centres = m[np.linspace(0, len(m) - 1, min(k, len(m))).astype(int)].copy()
    for _ in range(rounds if len(m) > k else 0):
        near = nearest(m, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, m)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (m @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


@dataclass
class Quantiser:
    """Coarse centres, the centres of each part of a residual, and how many lists a query probes."""

    coarse: np.ndarray
    parts: list[np.ndarray]
    probes: int = 1

    @classmethod
    def fit(cls, m: np.ndarray, k: int, lists: int = LISTS, parts: int = PARTS) -> Quantiser:
        """probes: the fewest lists that hold HELD of the k nearest rows of sampled rows."""
        m = unit(m)
        coarse = centres_of(m, lists)
        near = nearest(m, coarse)
        residual = m - coarse[near]
        q = cls(coarse, [centres_of(residual[:, s], CENTRES) for s in np.array_split(np.arange(m.shape[1]), min(parts, m.shape[1]))])
        asked = np.linspace(0, len(m) - 1, min(256, len(m))).astype(int)
        scores = m[asked] @ m.T
        scores[np.arange(len(asked)), asked] = -2
        best = np.argsort(-scores, 1)[:, : min(k, len(m) - 1)]
        place = np.argsort(np.argsort(-(m[asked] @ coarse.T), 1), 1)  # the place of each list in a query's order
        need = np.take_along_axis(place, near[best], 1).ravel() + 1
        q.probes = int(np.quantile(need, HELD, method="higher")) if len(need) else len(coarse)
        return q

    def slices(self) -> list[np.ndarray]:
        ends = np.cumsum([0, *[p.shape[1] for p in self.parts]])
        return [np.arange(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of each row, a byte for each part."""
        m = unit(m)
        near = nearest(m, self.coarse)
        residual = m - self.coarse[near]
        return near, np.stack([nearest(residual[:, s], p) for s, p in zip(self.slices(), self.parts, strict=True)], 1).astype(np.uint8)

    def scores(self, queries: np.ndarray, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate cosine of unit queries with coded rows; -2 outside a query's lists."""
        lists = queries @ self.coarse.T
        out = lists[:, near]
        for k, (s, p) in enumerate(zip(self.slices(), self.parts, strict=True)):
            out += (queries[:, s] @ p.T)[:, codes[:, k]]
        if self.probes < len(self.coarse):
            least = np.partition(lists, len(self.coarse) - self.probes, 1)[:, len(self.coarse) - self.probes]
            out[lists[:, near] < least[:, None]] = -2
        return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class VectorIndex:
    """All vectors of a table as codes, in the shared folder; vectors without an id or value are left out."""

    def __init__(self, df: DataFrame, id_col: str, vector: str, k: int, sample: int = SAMPLE):
        self.vectors = df.select(F.col(id_col).cast("long").alias("doc"), F.col(vector).cast("array<double>").alias("v")).where("doc IS NOT NULL AND v IS NOT NULL")
        rows = self.vectors.orderBy(F.xxhash64("doc"), "doc").limit(sample).toArrow().column("v").combine_chunks()
        self.model = Quantiser.fit(matrix(rows), k) if len(rows) else None
        self.k = k
        if self.model is not None:
            sent = df.sparkSession.sparkContext.broadcast(self.model)

            def code(batches):
                for batch in batches:
                    near, codes = sent.value.encode(matrix(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["doc", "list", "code"])

            self.codes = kept(self.vectors.mapInArrow(code, "doc long, list int, code binary"), "vector-codes")

    def candidates(self, queries: DataFrame, id_col: str, vector: str, n: int) -> DataFrame:
        """(query, doc): the n rows of the best approximate cosine for each query, other than itself."""
        asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v")).where("query IS NOT NULL AND v IS NOT NULL")
        blocks, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
        for b in range(blocks if self.model is not None else 0):
            rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow()
            if not rows.num_rows:
                continue
            sent = self.codes.sparkSession.sparkContext.broadcast((self.model, rows.column("query").to_numpy(), unit(matrix(rows.column("v").combine_chunks()))))

            def run(batches, sent=sent):
                model, ids, m = sent.value
                best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
                for batch in batches:
                    for row in range(0, batch.num_rows, 1024):
                        part = batch.slice(row, 1024)
                        docs = part.column(0).to_numpy()
                        codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(docs), -1)
                        scores = model.scores(m, part.column(1).to_numpy(), codes)
                        scores[ids[:, None] == docs[None, :]] = -2
                        d, s = np.concatenate([best[0], np.broadcast_to(docs, scores.shape)], 1), np.concatenate([best[1], scores], 1)
                        order = np.lexsort((d, -s), axis=1)[:, :n]
                        best = np.take_along_axis(d, order, 1), np.take_along_axis(s, order, 1)
                good = best[1] > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(1))), pa.array(best[0][good]), pa.array(best[1][good])], names=["query", "doc", "near"])

            part = self.codes.mapInArrow(run, "query long, doc long, near double")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.vectors.sparkSession.createDataFrame([], "query long, doc long")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "doc"))
        return out.withColumn("_n", place).where(F.col("_n") <= n).select("query", "doc")

    def search(self, queries: DataFrame, id_col: str, vector: str, n: int) -> DataFrame:
        """(query, doc, score, rank): the k best of n candidates of each query by their exact cosine."""
        asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("a"))
        pairs = self.candidates(queries, id_col, vector, n).join(self.vectors, "doc").join(asked, "query")

        def exact(batches):
            for batch in batches:
                a, b = unit(matrix(batch.column(2))), unit(matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((a * b).sum(1), 9))], names=["query", "doc", "score"])

        scored = pairs.select("query", "doc", "a", "v").mapInArrow(exact, "query long, doc long, score double")
        return top_k(scored, ["query"], "score", "doc", self.k)
