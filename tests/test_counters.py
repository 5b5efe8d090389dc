"""Counters of writes and streams against aggregates."""

import time

from pyspark.sql import functions as F

from feedloom.operators import counters

SCHEMA = "external_id string, content string, assets array<string>"
ROWS = [("a", "été", ["x", "y"]), ("b", None, None), ("c", "", []), ("d", "\U0001f600z", ["q"])]


def test_a_write_counts_what_it_writes(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = counters.written(rows, lambda df: df.write.parquet(f"{tmp_path}/out"))
    assert got == {"seen": 4, "assets": 3, "characters": 5, "bytes": 10}
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.agg(*counters.measures()).first().asDict() == got
    none = counters.written(rows.where("false"), lambda df: df.write.parquet(f"{tmp_path}/none"))
    assert none == {"seen": 0, "assets": 0, "characters": 0, "bytes": 0}
    assert counters.written(rows, lambda df: df.write.format("noop").mode("overwrite").save(), F.max("external_id").alias("last")) == {"last": "d"}


def test_a_streams_batches_are_added_up(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(ROWS[k:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    total = counters.StreamCounters("records")
    spark.streams.addListener(total)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = counters.counting(stream, "records").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        want = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").agg(*counters.measures()).first().asDict()
        for _ in range(50):  # events come after the batch
            if total.total == want:
                break
            time.sleep(0.2)
        assert total.total == want and want["seen"] == 9
    finally:
        spark.streams.removeListener(total)
