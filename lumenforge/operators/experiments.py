"""A/B tests: assignment, per-variant metrics and tests, all as expressions over one row per comparison."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.functions.statistics import fnv1a, normal_cdf, two_sided_p


def assign(user: Column, experiment: str, weights: list[tuple[str, float]]) -> Column:
    """Variant of a user by the 32-bit hash of 'user:experiment' and cumulative weights."""
    point = fnv1a(F.concat(user.cast("string"), F.lit(":" + experiment))) / float(1 << 32)
    total = sum(w for _, w in weights)
    edge, out = total, F.lit(weights[-1][0])
    for name, w in reversed(weights[:-1]):
        edge = sum(x for n, x in weights[: [n for n, _ in weights].index(name) + 1])
        out = F.when(point * total < edge, name).otherwise(out)
    return out


def variant_metrics(df: DataFrame, variant: str, shown: Column, clicked: Column, latency: Column, failed: Column) -> DataFrame:
    return df.groupBy(variant).agg(F.count_if(shown).alias("impressions"), F.count_if(clicked).alias("clicks"), F.round(F.count_if(clicked) / F.count_if(shown), 6).alias("ctr"), F.round(F.avg(latency), 6).alias("mean_latency"), F.round(F.count_if(failed) / F.count("*"), 6).alias("error_rate"))


def side_by_side(df: DataFrame, variant: str, a: str, b: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row with the aggregates of both variants, suffixed _a and _b."""
    picked = []
    for name, column in aggregates.items():
        picked += [F.max(F.when(F.col(variant) == v, F.col(name))).alias(f"{name}_{s}") for v, s in ((a, "a"), (b, "b"))]
    return df.groupBy(variant).agg(*[c.alias(n) for n, c in aggregates.items()]).agg(*picked)


def beta_posterior(row: DataFrame, least: int = 30) -> DataFrame:
    """P(b better) by the normal approximation of Beta(1 + clicks, 1 + misses). row: n_a, k_a, n_b, k_b."""

    def moments(n: str, k: str) -> tuple[Column, Column]:
        a, b = F.col(k) + 1, F.col(n) - F.col(k) + 1
        return a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))

    (ma, va), (mb, vb) = moments("n_a", "k_a"), moments("n_b", "k_b")
    z = (mb - ma) / F.sqrt(va + vb)
    better = normal_cdf(z)
    winner = F.when((F.col("n_a") < least) | (F.col("n_b") < least), "too few").when(better > 0.975, "b").when(better < 0.025, "a").otherwise("none")
    return row.withColumn("p_better", F.round(better, 6)).withColumn("p_value", F.round(two_sided_p(z), 6)).withColumn("winner", winner)


def welch(row: DataFrame) -> DataFrame:
    """Welch's z of two means. row: n, mean and var of a and b."""
    z = (F.col("mean_b") - F.col("mean_a")) / F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return row.withColumn("z", F.round(z, 6)).withColumn("p_value", F.round(two_sided_p(z), 6))


def two_proportions(row: DataFrame) -> DataFrame:
    """Pooled z, 95% interval of the difference, Cohen's h and an early-stop flag. row: n_a, k_a, n_b, k_b."""
    pa, pb = F.col("k_a") / F.col("n_a"), F.col("k_b") / F.col("n_b")
    pooled = (F.col("k_a") + F.col("k_b")) / (F.col("n_a") + F.col("n_b"))
    z = (pb - pa) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    half = 1.959964 * F.sqrt(pa * (1 - pa) / F.col("n_a") + pb * (1 - pb) / F.col("n_b"))
    h = 2 * F.asin(F.sqrt(pb)) - 2 * F.asin(F.sqrt(pa))
    return row.withColumn("z", F.round(z, 6)).withColumn("p_value", F.round(two_sided_p(z), 6)).withColumn("low", F.round(pb - pa - half, 6)).withColumn("high", F.round(pb - pa + half, 6)).withColumn("cohens_h", F.round(h, 6)).withColumn("stop_early", F.abs(z) > 2.797)


def chi_squared(cells: DataFrame, row: str, column: str) -> DataFrame:
    """Statistic and degrees of freedom of independence. cells: one row per pair of values with n; missing pairs count 0."""
    rows, columns = cells.groupBy(row).agg(F.sum("n").alias("r")), cells.groupBy(column).agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("t"))
    grid = rows.crossJoin(columns).crossJoin(F.broadcast(total)).join(cells, [row, column], "left")  # as many rows as the table has cells
    expected = F.col("r") * F.col("c") / F.col("t")
    diff = F.coalesce("n", F.lit(0)) - expected
    return grid.agg(F.round(F.sum(diff * diff / expected), 6).alias("statistic"), ((F.countDistinct(row) - 1) * (F.countDistinct(column) - 1)).alias("df"))


def sample_size(base: Column, effect: Column, z_alpha: float = 1.959964, z_power: float = 0.841621) -> Column:
    """Rows per arm to detect a relative effect on a base rate."""
    p2 = base * (1 + effect)
    mean = (base + p2) / 2
    top = z_alpha * F.sqrt(2 * mean * (1 - mean)) + z_power * F.sqrt(base * (1 - base) + p2 * (1 - p2))
    return F.ceil(top * top / ((p2 - base) * (p2 - base))).cast("long")


def posterior_draws(row: DataFrame, draws: int, seed: int, parts: int = 16) -> DataFrame:
    """P(b > a), expected lift and risk by Beta draws, spread over `parts` tasks with their own seeds. row: n_a, k_a, n_b, k_b."""

    @F.pandas_udf("better double, lift double, risk double")
    def drawn(part: pd.Series, n_a: pd.Series, k_a: pd.Series, n_b: pd.Series, k_b: pd.Series) -> pd.DataFrame:
        out = []
        for p, na, ka, nb, kb in zip(part, n_a, k_a, n_b, k_b, strict=True):
            rng = np.random.default_rng([seed, int(p)])
            a, b = rng.beta(1 + ka, 1 + na - ka, draws // parts), rng.beta(1 + kb, 1 + nb - kb, draws // parts)
            out.append(((b > a).mean(), ((b - a) / a).mean(), np.maximum(a - b, 0).mean()))
        return pd.DataFrame(out, columns=["better", "lift", "risk"])

    spread = row.crossJoin(F.broadcast(row.sparkSession.range(parts).withColumnRenamed("id", "part")))
    x = spread.select(drawn("part", "n_a", "k_a", "n_b", "k_b").alias("x")).select("x.*")
    return x.agg(F.round(F.avg("better"), 4).alias("p_better"), F.round(F.avg("lift"), 4).alias("lift"), F.round(F.avg("risk"), 6).alias("risk"))


def recommendation(p_value: Column, n: Column, needed: Column, lift: Column) -> Column:
    return F.when((p_value < 0.05) & (n >= 0.5 * needed), F.when(lift > 0, "ship").otherwise("stop")).when(n >= needed, "no difference").otherwise("continue")


