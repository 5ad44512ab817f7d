"""Retention on tables that are partitioned by day: only the days with rows to remove are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.sources.storage import dropped, kept


def write_days(df: DataFrame, path: str, ts: Column, day: str = "day") -> None:
    """df as Parquet with one folder a day of ts (null: none)."""
    df.withColumn(day, F.date_format(ts, "yyyy-MM-dd")).repartitionByRange(day).write.partitionBy(day).parquet(path)


def prune(spark: SparkSession, path: str, remove: Column, day: str = "day") -> DataFrame:
    """(day, removed, kept, dropped) of the days that lost rows; remove says which rows go (null: stay).

    Counts of each day tell which days are touched. Days that keep rows are overwritten one by one from a copy of these rows, so a
    day is either as before or as after; days that keep none lose their folder. Files of all other days stay as they are. Run
    again, it finds nothing to do.
    """
    rows = spark.read.parquet(path)
    gone = F.coalesce(remove, F.lit(False))
    told = kept(rows.groupBy(F.col(day).cast("string").alias("day")).agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")).where("removed > 0"), "pruned-days")
    # days are as many as a calendar has
    days = [(r.day, r.kept) for r in told.collect()]
    rest = [d for d, n in days if n > 0]
    if rest:
        copy = kept(rows.where(F.col(day).cast("string").isin(rest) & ~gone), "retained")
        copy.repartitionByRange(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
        dropped(copy)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d, n in days:
        if n == 0:
            store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={d}"), True)
    return told.select("day", "removed", "kept", (F.col("kept") == 0).alias("dropped"))
