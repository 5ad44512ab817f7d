"""A streaming learner: logistic weights, running moments and metrics, renewed at every flush and kept as a versioned table."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.sources.storage import shared_dir

STATE = "version long, n double, means array<double>, squares array<double>, weights array<double>, bias double, right double, hits double, false_hits double, misses double"


@dataclass
class Learner:
    """What all rows so far have left: count, mean and sum of squared deviations of each feature, weights, and counts of predictions
    that were made before their rows were learnt (right; true, false and missed positives)."""

    version: int
    n: float
    means: list[float]
    squares: list[float]
    weights: list[float]
    bias: float = 0.0
    right: float = 0.0
    hits: float = 0.0
    false_hits: float = 0.0
    misses: float = 0.0

    @classmethod
    def new(cls, features: int) -> Learner:
        zero = [0.0] * features
        return cls(0, 0.0, zero, zero, zero)

    def with_moments(self, n: float, means: list[float], squares: list[float]) -> Learner:
        """The moments of these and further rows together, by the sums of both parts and the gap of their means."""
        whole = self.n + n
        gaps = [b - a for a, b in zip(self.means, means, strict=True)]
        return replace(
            self,
            n=whole,
            means=[a + g * n / whole for a, g in zip(self.means, gaps, strict=True)],
            squares=[a + b + g * g * self.n * n / whole for a, b, g in zip(self.squares, squares, gaps, strict=True)],
        )

    def scaled(self, features: list[str]):
        """Features less their means, in standard deviations; a feature that does not vary is 0."""
        spread = [(s / self.n) ** 0.5 if self.n else 0.0 for s in self.squares]
        return [(F.col(f).cast("double") - m) / s if s > 0 else F.lit(0.0) for f, m, s in zip(features, self.means, spread, strict=True)]

    def chance(self, features: list[str]):
        margin = F.lit(self.bias)
        for x, w in zip(self.scaled(features), self.weights, strict=True):
            margin = margin + x * w
        return 1 / (1 + F.exp(-margin))

    def learnt(self, rows: DataFrame, features: list[str], label: str, weight: str | None, rate: float) -> Learner:
        """The next version after a flush: two passes over its rows, sums of the length of the features on the driver."""
        x = [F.col(f).cast("double") for f in features]
        told = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.var_pop(c).alias(f"v{k}") for k, c in enumerate(x)]).first()
        if not told.n:
            return self
        now = self.with_moments(told.n, [told[f"m{k}"] for k in range(len(x))], [told[f"v{k}"] * told.n for k in range(len(x))])
        given = F.col(weight).cast("double") if weight else F.lit(1.0)
        scored = rows.select(F.col(label).cast("double").alias("_y"), given.alias("_w"), now.chance(features).alias("_p"), *[c.alias(f"_x{k}") for k, c in enumerate(now.scaled(features))])
        error = (F.col("_y") - F.col("_p")) * F.col("_w")
        yes, is_one = F.col("_p") >= 0.5, F.col("_y") >= 0.5
        g = scored.agg(
            *[F.avg(error * F.col(f"_x{k}")).alias(f"g{k}") for k in range(len(x))], F.avg(error).alias("gb"), F.count_if(yes == is_one).alias("right"),
            F.count_if(yes & is_one).alias("hits"), F.count_if(yes & ~is_one).alias("false_hits"), F.count_if(~yes & is_one).alias("misses"),
        ).first()
        return replace(
            now, version=self.version + 1, weights=[w + rate * g[f"g{k}"] for k, w in enumerate(self.weights)], bias=self.bias + rate * g.gb,
            right=self.right + g.right, hits=self.hits + g.hits, false_hits=self.false_hits + g.false_hits, misses=self.misses + g.misses,
        )

    def row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], STATE)


def learn(stream: DataFrame, features: list[str], label: str, rate: float = 0.1, flush_rows: int = 1, weight: str | None = None, base: str | None = None) -> DataFrame:
    """The model table (STATE) after a run over all available rows of a stream, a version for each flush.

    A micro-batch is written to a folder of its own; once the folders that wait hold flush_rows rows, they are learnt together and a
    new version is written. Rows that wait at the end are learnt last. A repeated batch overwrites its folder and its
    version, and a restart (same base) goes on from the newest version and from the folders behind it, so no row counts twice.
    Rows without a label or with a null feature are left out.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/learner-{uuid.uuid4().hex}"
    kept_columns = [*features, label, *([weight] if weight else [])]

    def folders(name: str) -> list[int]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().split("=")[1]) for f in store.listStatus(path) if "=" in f.getPath().getName()) if store.exists(path) else []

    def newest(below: int) -> tuple[Learner, int]:
        """The model before a batch, and the last batch that it has learnt."""
        known = [v for v in folders("model") if v < below]
        if not known:
            return Learner.new(len(features)), -1
        r = spark.read.schema(STATE).parquet(f"{base}/model/upto={known[-1]}").first()
        return Learner(*r), known[-1]

    def flush(upto: int, least: int) -> None:
        model, done = newest(upto)
        waiting = [k for k in folders("rows") if done < k <= upto]
        if not waiting:
            return
        rows = spark.read.parquet(*[f"{base}/rows/batch={k}" for k in waiting])
        if least <= 1 or rows.limit(least).count() >= least:
            model.learnt(rows, features, label, weight, rate).row(spark).write.mode("overwrite").parquet(f"{base}/model/upto={upto}")

    def batch(rows: DataFrame, number: int) -> None:
        rows.select(*kept_columns).na.drop().write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        flush(number, flush_rows)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    seen, told = folders("rows"), folders("model")
    if seen and (not told or told[-1] < seen[-1]):
        flush(seen[-1], 0)
    if not folders("model"):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*[f"{base}/model/upto={v}" for v in folders("model")]).dropDuplicates(["version"])
