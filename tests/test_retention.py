"""Retention on day folders: which files stay, which days are written anew, and which go."""

import datetime
import os

from pyspark.sql import functions as F

from lumenforge.operators import retention


def files(path):
    """(day, file, time of writing)."""
    return {(d, f, os.stat(os.path.join(path, d, f)).st_mtime_ns) for d in os.listdir(path) if d.startswith("day=") for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")}


def test_only_touched_days_are_written(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, "error" if k % 3 else "view", start + datetime.timedelta(hours=7 * k)) for k in range(40)] + [(99, "error", None)]
    path = str(tmp_path / "events")
    retention.write_days(spark.createDataFrame(rows, "id long, kind string, ts timestamp"), path, F.col("ts"))
    before = files(path)
    cut = F.lit("2024-01-06 12:00:00").cast("timestamp")
    remove = (F.col("ts") < cut) & ~((F.col("kind") == "view") & (F.col("ts") >= F.lit("2024-01-04").cast("timestamp")))
    want = {r[0] for r in rows if r[2] is None or r[2] >= datetime.datetime(2024, 1, 6, 12) or (r[1] == "view" and r[2] >= datetime.datetime(2024, 1, 4))}
    touched = {f"{r[2]:%Y-%m-%d}" for r in rows if r[0] not in want}
    empty = touched - {f"{r[2]:%Y-%m-%d}" for r in rows if r[0] in want and r[2]}
    assert empty and touched - empty  # both kinds are there
    told = {r.day: r.dropped for r in retention.prune(spark, path, remove).collect()}
    assert told == {d: d in empty for d in touched}
    assert {r.id for r in spark.read.parquet(path).collect()} == want and spark.read.parquet(path).count() == len(want)
    after = files(path)
    same = {f for f in before if f[0][4:] not in touched}
    assert same and {f for f in after if f[0][4:] not in touched} == same
    assert not {d[4:] for d, *_ in after} & empty and not (before - same) & after
    assert retention.prune(spark, path, remove).count() == 0 and files(path) == after
