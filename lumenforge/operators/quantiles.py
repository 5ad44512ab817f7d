"""Exact quantiles by refined histograms: bounded state for keys of any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.operators.joins import salted_join
from lumenforge.sources.storage import dropped, kept

#: Bins of a histogram, and rows of an interval that are sorted as they are.
BINS, SORTED = 1024, 4096


def exact_quantiles(df: DataFrame, key: list[str], column: str, shares: list[float], bins: int = BINS, sorted_rows: int = SORTED) -> DataFrame:
    """key and q0, q1, ...: the quantiles of a column at some shares, with linear interpolation between neighbouring ranks.

    Each share asks for one or two ranks of a key. A pass counts the rows of every interval that still holds an asked rank in equal
    bins; the bin with the rank, with its least and greatest value, is the next interval. It ends when an interval has one value, or so few rows that
    they are sorted. A task holds counts only. Values of one order of magnitude take two or three passes; each pass divides the range by `bins`. Nulls and
    NaN have no rank; keys without a value give no row.
    """
    values = kept(df.select(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(k).alias(f"_o{i}") for i, k in enumerate(key)], F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)"), "values")
    keys = [f"_k{i}" for i in range(len(key))]
    own = [f"_o{i}" for i in range(len(key))]
    whole = kept(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), *[F.first(o).alias(o) for o in own]), "value-ranges")
    place = lambda s: (F.col("n") - 1) * float(s)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares])))
    # an asked rank: how many rows of its interval come before it
    asked = kept(whole.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.col("n").alias("rows")).withColumn("before", F.col("rank")), "ranks")
    found = asked.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
    still = asked.where("lo < hi")
    temporary = [asked]

    def met(targets: DataFrame) -> DataFrame:
        """The values of each asked rank's interval."""
        listed = targets.groupBy(*keys).agg(F.collect_list(F.struct("rank", "lo", "hi", "before")).alias("t"))
        at = salted_join(values, listed, keys, whole.select(*keys, "n"), F.col("x")) if keys else values.crossJoin(F.broadcast(listed))
        return at.select(*keys, "x", F.explode(F.filter("t", lambda t: (F.col("x") >= t.lo) & (F.col("x") <= t.hi))).alias("t")).select(*keys, "x", "t.*")

    while not still.isEmpty():
        few = still.where(F.col("rows") <= sorted_rows)
        if not few.isEmpty():
            listed = met(few).groupBy(*keys, "rank").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.first("before").alias("before"))
            found = found.unionByName(listed.select(*keys, "rank", F.get("xs", F.col("before").cast("int")).alias("v")))
        wide = still.where(F.col("rows") > sorted_rows)
        if wide.isEmpty():
            break
        step = F.least(F.floor((F.col("x") / F.lit(2.0) - F.col("lo") / F.lit(2.0)) / (F.col("hi") / F.lit(2.0) - F.col("lo") / F.lit(2.0)) * bins), F.lit(bins - 1))
        counted = met(wide).groupBy(*keys, "rank", "before", step.alias("bin")).agg(F.count("*").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("rows").over(Window.partitionBy(*keys, "rank").orderBy("bin"))
        inside = counted.withColumn("upto", upto).where((F.col("upto") > F.col("before")) & (F.col("upto") - F.col("rows") <= F.col("before")))
        now = kept(inside.select(*keys, "rank", "lo", "hi", "rows", (F.col("before") - (F.col("upto") - F.col("rows"))).alias("before")), "ranks")
        temporary.append(now)
        found = found.unionByName(now.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
        still = now.where("lo < hi")
    told = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    both = whole.join(told, keys) if keys else whole.crossJoin(F.broadcast(told))

    def value(s: float):
        low, high = F.element_at("at", F.floor(place(s))), F.element_at("at", F.ceil(place(s)))
        part = place(s) - F.floor(place(s))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    out = kept(both.select(*[F.col(o).alias(k) for o, k in zip(own, key, strict=True)], *[value(s).alias(f"q{i}") for i, s in enumerate(shares)]), "quantiles")
    for table in (values, whole, *temporary):
        dropped(table)
    return out


def median(df: DataFrame, key: list[str], column: str, out: str) -> DataFrame:
    return exact_quantiles(df, key, column, [0.5]).withColumnRenamed("q0", out)
