"""Landing folders of several files a slice, and where streams keep their state."""

import os

import pytest
from pyspark.sql import functions as F

from lumenforge.sources.storage import shared_dir
from lumenforge.streaming import jobs as J


def newest_landing(spark):
    root = shared_dir(spark)
    return max((os.path.join(root, d) for d in os.listdir(root) if d.startswith("landing-t-")), key=os.path.getmtime)


@pytest.mark.parametrize("rows", [400, 3, 0])
def test_a_micro_batch_takes_all_files_of_its_slice(spark, tmp_path, rows):
    table = spark.range(rows).select("id", F.timestamp_seconds("id").alias("ts")).repartition(3)
    table.write.parquet(f"{tmp_path}/t.parquet")
    stream = J.stream_of(spark, str(tmp_path), "t", "ts", late=F.col("id") % 20 == 3, file_rows=10)
    seen = []

    def each(batch, number, past):
        seen.append((sorted(r.id for r in batch.collect()), number))
        return batch

    out = J.drained(stream, "append", "t", each)
    assert sorted(r.id for r in out.collect()) == list(range(rows))
    if rows == 400:
        assert [len(ids) for ids, _ in seen] == [95, 95, 95, 95, 20] and all(a[-1] < b[0] for (a, _), (b, _) in zip(seen[:3], seen[1:4], strict=True))
        files = [r.n for r in spark.read.schema(table.schema).parquet(newest_landing(spark)).groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
        assert len(files) >= 10 and len(files) % 5 == 0 and max(files) < 95


def test_state_lies_on_disk_while_a_stream_runs_and_the_session_keeps_its_own_store(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.range(50).select("id", F.timestamp_seconds("id").alias("ts")).write.parquet(f"{tmp_path}/t.parquet")
    before, inside = spark.conf.get(name, None), []
    counted = J.stream_of(spark, str(tmp_path), "t").withWatermark("ts", "1 hour").groupBy(F.window("ts", "10 seconds")).agg(F.count("*").alias("n")).select("window.start", "n")
    out = J.drained(counted, "update", "conf", lambda b, n, past: inside.append(spark.conf.get(name)) or b, key=["start"])
    assert sum(r.n for r in out.collect()) == 50
    assert inside and all("RocksDB" in x for x in inside) and spark.conf.get(name, None) == before
