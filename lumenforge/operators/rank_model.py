"""A list-wise ranking model: linear scores fitted by lambda gradients, kept as a versioned table, applied as an expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.sources.storage import dropped, kept

#: Passes over the groups, share of a Newton step, weight of the penalty, rows below which nothing is fitted.
ROUNDS, STEP, PENALTY, LEAST = 15, 0.5, 0.01, 200
#: Pairs of rows that are held at once, unless one row has more.
PAIRS = 1 << 18
MODEL = "version long, place int, feature string, mean double, scale double, weight double"


def gradients(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient, curvature, NDCG), each summed over lists, whose rows lie one list after the other, with labels y under weights w.

    Each pair of a better and a worse row pulls the weights by the chance that it is misplaced, weighed by what its exchange would
    change in the list's NDCG. Ties of scores keep the order of the rows. All lists of a call are worked at once, their pairs in
    pieces of about PAIRS.
    """
    s, of = x @ w, np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    start = ends - sizes
    place = np.arange(len(y)) - start[of]
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((-s, of))] = place
    gain, discount = 2.0**y - 1, 1 / np.log2(rank + 2)
    ideal = np.bincount(of, gain[np.lexsort((-gain, of))] / np.log2(place + 2), len(sizes))
    quality = np.bincount(of, gain * discount, len(sizes))[ideal > 0] / ideal[ideal > 0]
    gradient, curvature = np.zeros_like(w), np.zeros_like(w)
    # only a list with two labels has pairs
    mixed = np.flatnonzero((np.minimum.reduceat(y, start) < np.maximum.reduceat(y, start))[of]) if len(y) else np.zeros(0, np.int64)
    done = np.cumsum(sizes[of[mixed]])
    row = 0
    while row < len(mixed):
        end = max(row + 1, int(np.searchsorted(done, (done[row - 1] if row else 0) + PAIRS, "right")))
        own = mixed[row:end]
        n = sizes[of[own]]
        better = np.repeat(own, n)
        worse = np.repeat(start[of[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        told = y[better] > y[worse]
        better, worse = better[told], worse[told]
        pull = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        weight = np.abs(gain[better] - gain[worse]) * np.abs(discount[better] - discount[worse]) / ideal[of[better]]
        gap = x[better] - x[worse]
        gradient, curvature = gradient + (weight * pull) @ gap, curvature + (weight * pull * (1 - pull)) @ (gap * gap)
        row = end
    return gradient, curvature, float(quality.sum() + np.count_nonzero(ideal <= 0))


def _lists(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, labels, rows of each list) of the whole lists of each batch; rows are sorted by list, a list that a batch cuts comes with the next."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False) | (keys[1:].is_null().to_numpy(zero_copy_only=False) & keys[:-1].is_null().to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(~same) + 1
        if held and not keys[0].equals(last):
            yield _joined(held)
            held = []
        if len(cuts):
            sizes = np.diff(np.append(0, cuts))
            held.append((x[: cuts[-1]], y[: cuts[-1]], sizes))
            yield _joined(held)
            held = []
        at = int(cuts[-1]) if len(cuts) else 0
        held.append((x[at:], y[at:], np.array([batch.num_rows - at])))
        last = keys[batch.num_rows - 1]
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of one list, and the lists that follow it in the last batch."""
    first = sum(len(h[1]) for h in held[:-1])
    sizes = held[-1][2].copy()
    sizes[0] += first
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), sizes


@dataclass
class RankModel:
    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    version: int = 1

    def margin(self) -> Column:
        parts = [(F.col(f).cast("double") - m) / s * w for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True)]
        return sum(parts[1:], parts[0])

    def score(self) -> Column:
        """Between 0 and 1, from built-in functions."""
        return 1 / (1 + F.exp(-self.margin()))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, k, *r) for k, r in enumerate(zip(self.features, self.mean, self.scale, self.weights, strict=True))]
        return spark.createDataFrame(rows, MODEL)

    @classmethod
    def read(cls, table: DataFrame, version: int | None = None) -> RankModel:
        """The newest version of a model table, or a given one."""
        wanted = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == wanted).orderBy("place").collect()
        return cls([r.feature for r in rows], [r["mean"] for r in rows], [r.scale for r in rows], [r.weight for r in rows], wanted)


def fit(rows: DataFrame, group: str, order: list[str], features: list[str], label: str, rounds: int = ROUNDS, least: int = LEAST) -> RankModel | None:
    """The model of the lists (group) of rows, or None below `least` rows.

    Rows lie in tasks by list, sorted once; a round reads them, adds up the gradients of the lists in each task, and only sums of
    the length of the features come to the driver. A list is one page of results, so it is held at once.
    """
    if rows.limit(least).count() < least:
        return None
    told = rows.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{k}") for k, f in enumerate(features)]).first()
    mean = [told[f"m{k}"] or 0.0 for k in range(len(features))]
    scale = [told[f"s{k}"] or 1.0 for k in range(len(features))]
    x = F.array(*[F.coalesce((F.col(f).cast("double") - m) / s, F.lit(0.0)) for f, m, s in zip(features, mean, scale, strict=True)])
    lists = rows.select(F.col(group).alias("g"), F.col(label).cast("double").alias("y"), x.alias("x"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    lists = kept(lists.repartition("g").sortWithinPartitions("g", *[f"_o{k}" for k in range(len(order))]).select("g", "y", "x"), "rank-lists")
    weights = np.zeros(len(features))
    for _ in range(rounds):
        gradient, curvature, n, _ = round_sums(lists, weights)
        weights = weights + STEP * (gradient / max(n, 1) - PENALTY * weights) / (curvature / max(n, 1) + PENALTY)
    dropped(lists)
    return RankModel(features, mean, scale, weights.tolist())


def round_sums(lists: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(gradient, curvature, lists, sum of NDCG) over all lists (g, y, x), each file of which is sorted by list."""

    def run(batches):
        gradient, curvature, n, quality = np.zeros(len(weights)), np.zeros(len(weights)), 0, 0.0
        for x, y, sizes in _lists(batches):
            g, h, q = gradients(x, y, sizes, weights)
            gradient, curvature, n, quality = gradient + g, curvature + h, n + len(sizes), quality + q
        yield pa.RecordBatch.from_arrays([pa.array([gradient.tolist()]), pa.array([curvature.tolist()]), pa.array([n]), pa.array([quality])], names=["g", "h", "n", "q"])

    found = lists.mapInArrow(run, "g array<double>, h array<double>, n long, q double").collect()
    zero = np.zeros(len(weights))
    return sum((np.array(r.g) for r in found), zero), sum((np.array(r.h) for r in found), zero), sum(r.n for r in found), sum(r.q for r in found)


def ndcg(rows: DataFrame, group: str, label: str, score: Column, tie: list[str]) -> DataFrame:
    """group, ndcg of each list ordered by score; 1 for a list without a positive label."""
    from pyspark.sql.window import Window

    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    placed = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), *tie))).withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(label), *tie)))
    found = placed.groupBy(group).agg(F.sum(gain / F.log2(F.col("_r") + 1)).alias("got"), F.sum(gain / F.log2(F.col("_i") + 1)).alias("ideal"))
    return found.select(group, F.when(F.col("ideal") > 0, F.col("got") / F.col("ideal")).otherwise(1.0).alias("ndcg"))
