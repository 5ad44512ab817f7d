"""Sessions and other ordered work per key. For scans over keys of any size see scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.functions.times import micros

IDLE_MINUTES = 30


def sessionise(df: DataFrame, key: str, ts: str, tie: str, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """df with session_no: counts the rows of a key that follow more than idle_minutes without a row."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    gap = micros(ts) - micros(F.lag(ts).over(order))
    fresh = F.when(gap.isNull() | (gap > idle_minutes * 60_000_000), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("session_no", F.sum("_fresh").over(order).cast("long")).drop("_fresh")


def ordered_fold(df: DataFrame, key: list[str], order: list[str], value: Column, start: Column, step) -> DataFrame:
    """key, folded: step(accumulator, value) over the values of each key in order. The values of one key form one array."""
    items = F.sort_array(F.collect_list(F.struct(*order, value.alias("_v"))))
    return df.groupBy(*key).agg(F.aggregate(items, start, lambda a, x: step(a, x["_v"])).alias("folded"))


def newest(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
