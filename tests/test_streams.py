"""Streams against their batch twins."""

from pyspark.sql import functions as F

from ragmill.streaming import streams


def test_failure_stream_keeps_the_last_calls_whatever_their_order(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, failed int"
    at = f"file://{tmp_path}/calls"
    calls = spark.sql("select id as event_id, timestamp_seconds(1000 + id) as ts, 1L as user_id, cast(id >= 25 as int) as failed from range(30)")
    calls.orderBy("failed", "event_id").coalesce(1).write.parquet(at)
    calls.where("false").unionByName(calls.where("event_id < 15").withColumn("ts", calls.ts - F.expr("interval 1 hour"))).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    got = streams.drain(streams.failure_stream(stream), "update").collect()
    assert len(got) == 2 and {(r.n, r.failures, r.open) for r in got} == {(10, 5, True)}
