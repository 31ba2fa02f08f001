"""Structured Streaming twins: ingestion, dedup, audits and feedback with event time.

Every function takes a streaming DataFrame and returns one, or writes with foreachBatch; drain() runs a stream over what
is there and returns the sink's rows, which is what the queries and tests use.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import jobs


def source(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table as a stream of its files, `files` to a micro-batch; ts becomes a timestamp, which watermarks need.

    The last letter of the path is a pattern, so that the table may be a file or a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    df = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parque[t]")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder for sinks and checkpoints: under spark.checkpoint.dir where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = (), at: str | None = None) -> DataFrame:
    """Run a stream over all there is and return its result.

    That is the appended rows, the last state of a complete one, or of an updating one every update, with `keys` only
    the last of each key. With `at`, the folder of an earlier run, the stream goes on from where that ended, and what
    it returned then is part of the result.
    """
    spark = stream.sparkSession
    at = at or folder(spark, "stream")

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")  # a batch that runs again replaces its rows

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    out = spark.read.schema(schema).parquet(f"{at}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*").select(*stream.columns)
    return out.drop("batch")


def replayed(rows: DataFrame, step: Column, steps: int, flow: Callable[[DataFrame], DataFrame], mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """The result of flow(stream of rows) when the rows arrive in `steps` runs of the stream: those of `step` 0 first.

    Each run takes in all of its step's files before the next ones are written, so the watermark has moved in between.
    """
    spark, at = rows.sparkSession, folder(rows.sparkSession, "replay")
    stream = flow(_arrivals(spark, rows, step, 0, at))
    out = drain(stream, mode, keys, at)
    for k in range(1, steps):
        _arrivals(spark, rows, step, k, at)
        out = drain(stream, mode, keys, at)
    return out


def _arrivals(spark: SparkSession, rows: DataFrame, step: Column, k: int, at: str) -> DataFrame:
    rows.where(step == k).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{at}/in")


def redelivered(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events without those whose keys came before, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_audit(calls: DataFrame, limit: int, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return jobs.rate_audit(calls.withWatermark("ts", late), limit, window)


def daily_feedback(events: DataFrame, late: str = "1 day", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rating counts by event-time window; rows older than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("rating") > 0).alias("positive"), F.count_if(F.col("rating") < 0).alias("negative"))
    return out.select(F.col("w.start").alias("start"), "total", "positive", "negative")


def failure_stream(calls: DataFrame, last: int = 10, share: float = 0.5) -> DataFrame:
    """user_id, n, failures, open after each batch: each user's last calls by (ts, event_id), in whatever order they arrive, are kept as state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            rows = zip(batch["ts"].astype("int64"), batch["event_id"], batch["failed"], strict=True)
            held = sorted(held + [tuple(map(int, r)) for r in rows])[-last:]
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        failures = sum(h[2] for h in held)
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(held)], "failures": [failures], "open": [len(held) >= last and failures / last >= share]})

    return calls.groupBy("user_id").applyInPandasWithState(step, "user_id long, n int, failures int, open boolean", "ts array<long>, event_id array<long>, failed array<int>", "update", GroupStateTimeout.NoTimeout)
