"""Streaming forms of the event operators: file streams, watermarks, windows, joins and keyed state.

Every job takes a streaming DataFrame and returns one; `drained` runs a job over all available data and returns what it wrote to
the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenforge.sources.storage import dropped, kept, shared_dir

LATENESS = "10 minutes"
#: Rows of a file of a stream.
FILE_ROWS = 100_000
#: State is kept on the executors' disks, with a fixed share of memory, not as a map of all keys in memory.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}


def stream_of(spark: SparkSession, sf_dir: str, name: str, order: str | None = None, slices: int = 4, late: Column | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """File stream over a table, one micro-batch for each slice, as a landing folder would fill up.

    With order, slices follow that column; rows for which `late` holds arrive after all others, in a slice of their own. All slices have
    the same number of files, about one for file_rows rows, so that a micro-batch takes the files of one slice.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    path = f"{shared_dir(spark)}/landing-{name}-{uuid.uuid4().hex}"
    if order is None:
        place = F.pmod(F.xxhash64(table.columns[0]), F.lit(slices))
    else:
        edges = table.select(F.percentile_approx(F.unix_micros(F.col(order).cast("timestamp")), [k / slices for k in range(1, slices)]).alias("e")).first().e or []
        place = F.lit(0)
        for e in edges:
            place = place + (F.unix_micros(F.col(order).cast("timestamp")) > F.lit(e)).cast("int")
    if late is not None:
        place = F.when(late, F.lit(slices)).otherwise(place)
    placed = kept(table.withColumn("_place", place), "slices")
    files = slice_files(placed, slices + (late is not None), file_rows)
    for k in range(slices + (late is not None)):  # one after the other: a file stream reads in the order of arrival
        part = placed.where(F.col("_place") == k).drop("_place")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    dropped(placed)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def slice_files(placed: DataFrame, slices: int, file_rows: int) -> int:
    """Files of a slice: as the largest slice needs, but so few that rows dealt in turn leave none of the least slice empty.

    A partition with as many rows as there are files gives a row to each; the fullest one has at least the mean."""
    sizes = [r.n for r in placed.groupBy("_place").agg(F.count("*").alias("n")).collect()]
    sizes += [0] * (slices - len(sizes))
    return max(1, min(-(-max(sizes) // file_rows), min(sizes) // max(1, placed.rdd.getNumPartitions())))


def events(spark: SparkSession, sf_dir: str, late: Column | None = None) -> DataFrame:
    """Stream of the events table in the order of event time, in four micro-batches (five with late rows)."""
    return stream_of(spark, sf_dir, "events", "ts", late=late).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(job: DataFrame, mode: str, name: str, each: Callable[[DataFrame, int, DataFrame | None], DataFrame] | None = None, key: list[str] | None = None) -> DataFrame:
    """Rows of a finished run. complete: the last result table; append: all rows; update: the last row of each key.

    each: transforms a batch before it is written; it gets the rows that earlier batches have written, if there are any.
    """
    spark = job.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        past = spark.read.parquet(*[f"{base}/out/batch={k}" for k in written if k != number]) if each and [k for k in written if k != number] else None
        out = each(batch, number, past) if each else batch
        # a repeated batch overwrites its own folder, so a restart leaves no row twice
        out.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")
        written.append(number)

    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        job.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.parquet(f"{base}/out")
    if key is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))).where("_n = 1").drop("_n")
    return out.drop("batch")


def tumbling(e: DataFrame, interval: str, key: list[str]) -> DataFrame:
    return e.withWatermark("ts", LATENESS).groupBy(F.window("ts", interval).alias("w"), *key).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("bucket"), *key, "requests", "errors")


def sliding(e: DataFrame, interval: str, slide: str, key: list[str]) -> DataFrame:
    return e.withWatermark("ts", LATENESS).groupBy(F.window("ts", interval, slide).alias("w"), *key).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("bucket"), *key, "requests")


def sessions(e: DataFrame, idle: str = "30 minutes") -> DataFrame:
    return e.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count("*").alias("events"), F.max("ts").alias("ended")).select("user_id", F.col("w.start").alias("started"), "ended", "events")


def clicked(shown: DataFrame, clicks: DataFrame, hours: int = 24, how: str = "inner") -> DataFrame:
    """Stream-stream join of impressions with clicks of the same user and query within `hours`."""
    s = shown.withWatermark("ts", f"{hours} hours")
    c = clicks.select(F.col("user_id").alias("c_user"), F.col("query").alias("c_query"), F.col("ts").alias("c_ts"), "click_id").withWatermark("c_ts", f"{hours} hours")
    near = (F.col("c_ts") >= F.col("ts")) & (F.col("c_ts") <= F.col("ts") + F.expr(f"interval {hours} hours"))
    return s.join(c, (F.col("user_id") == F.col("c_user")) & (F.col("query") == F.col("c_query")) & near, how).select("impression_id", "click_id")


def first_seen(e: DataFrame, key: list[str], memory: str = "7 days") -> DataFrame:
    return e.withWatermark("ts", memory).dropDuplicatesWithinWatermark(key)


def health(e: DataFrame, key: str) -> DataFrame:
    """Per key: moving averages of latency (0.8 old) and success (0.9 old) and the failure streak, kept as state over batches."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        latency, success, streak = state.get if state.exists else (0.5, 1.0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for value, failed in zip(rows["value"], rows["event_type"] == "error", strict=True):
            latency = 0.8 * latency + 0.2 * value / 100
            success = 0.9 * success + 0.1 * (not failed)
            streak = streak + 1 if failed else 0
        state.update((float(latency), float(success), int(streak)))
        yield pd.DataFrame({key: [k[0]], "latency": [round(latency, 6)], "success": [round(success, 6)], "streak": [streak]})

    return e.groupBy(key).applyInPandasWithState(update, f"{key} string, latency double, success double, streak long", "latency double, success double, streak long", "update", "NoTimeout")


def violations(e: DataFrame, key: str, limit: int, interval: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    return sliding(e, interval, slide, [key]).where(F.col("requests") > limit)


def routed(batch: DataFrame, past: DataFrame | None, ts: str, lateness_us: int) -> DataFrame:
    """Rows of a batch with late: older than the newest row of all earlier batches by more than the lateness (the watermark)."""
    if past is None:
        return batch.withColumn("late", F.lit(False))
    newest = past.agg(F.max(ts).alias("_newest"))
    micros = lambda c: F.unix_micros(F.col(c))
    return batch.crossJoin(F.broadcast(newest)).withColumn("late", F.coalesce(micros("_newest") - micros(ts) > lateness_us, F.lit(False))).drop("_newest")


def messages(batch: DataFrame, past: DataFrame | None, key: str, op: str, built: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Index messages of a batch applied: index and reindex rows are built anew with their version (one more than the key's last),
    delete rows become tombstones. The last row of a key is its state."""
    latest = batch.dropDuplicates([key])
    out = built(latest.where(F.col(op) != "delete")).join(latest.select(key, op), key, "right")
    if past is None:
        return out.withColumn("version", F.lit(1).cast("long"))
    before = past.groupBy(key).agg(F.max("version").alias("_v"))
    return out.join(before, key, "left").withColumn("version", F.coalesce("_v", F.lit(0)).cast("long") + 1).drop("_v")
