"""Job state: outbox claims and retries, call audits, token streams, reply logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def claim(outbox: DataFrame, now: str, batch: int = 50, lease: str = "5 minutes") -> DataFrame:
    """The next `batch` events to send: due, and pending or with an expired lease; marked as processing until the lease ends."""
    at = F.lit(now).cast("timestamp_ntz")
    due = (F.col("next_attempt_at") <= at) & ((F.col("status") == "PENDING") | ((F.col("status") == "PROCESSING") & (F.col("locked_until") < at)))
    return outbox.where(due).orderBy("created_at", "id").limit(batch).withColumn("status", F.lit("PROCESSING")).withColumn("locked_until", at + F.expr(f"interval {lease}"))


def reschedule(claimed: DataFrame, failed: DataFrame, now: str, most: int = 10, longest: int = 300) -> DataFrame:
    """Claimed events after an attempt: PUBLISHED, or attempts + 1 and PENDING after min(longest, 2^min(attempts, 8)) seconds, or DEAD from `most` attempts."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = claimed.join(failed.select("id").distinct().withColumn("_failed", F.lit(True)), "id", "left")
    bad = F.coalesce("_failed", F.lit(False))
    tries = F.col("attempts") + 1
    wait = F.least(F.lit(longest), F.pow(F.lit(2), F.least(tries, F.lit(8))).cast("int"))
    status = F.when(~bad, "PUBLISHED").when(tries >= most, "DEAD").otherwise("PENDING")
    return rows.select("id", status.alias("status"), F.when(bad, tries).otherwise(F.col("attempts")).alias("attempts"), F.when(bad & (tries < most), wait).alias("delay_s"), F.when(bad & (tries < most), at + F.make_dt_interval(secs=wait)).alias("next_attempt_at"))


def rate_audit(calls: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """user_id, start, n, over: calls of each user in each window, and whether they exceed the limit. Batch or stream."""
    return calls.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def failure_audit(calls: DataFrame, last: int = 10, share: float = 0.5, key: str = "user_id") -> DataFrame:
    """Calls with the share of failures among a key's last `last` calls, and whether that opens the breaker (never before `last` calls)."""
    recent = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(-(last - 1), 0)
    rate, n = F.avg("failed").over(recent), F.count("*").over(recent)
    return calls.select("event_id", key, F.round(rate, 4).alias("failure_rate"), ((n >= last) & (rate >= share)).alias("open"))


def assemble_stream(events: DataFrame) -> DataFrame:
    """request_id, text, sources, failed of stream events (request_id, seq, type, payload): tokens in order, up to an error; the last sources."""
    stop = F.min(F.when(F.col("type") == "error", F.col("seq"))).over(Window.partitionBy("request_id"))
    rows = events.withColumn("stop", stop)
    live = F.col("stop").isNull() | (F.col("seq") < F.col("stop"))
    token = F.when((F.col("type") == "token") & live, F.struct("seq", "payload"))
    return rows.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["payload"]), "").alias("text"), F.max_by("payload", F.when((F.col("type") == "sources") & live, F.col("seq"))).alias("sources"), F.max(F.col("type") == "error").alias("failed"))


def response_text(raw: str = "raw"):
    """Text of a model's reply in any of the known JSON shapes; null if none has it."""
    paths = ("$.choices[0].delta.content", "$.choices[0].message.content", "$.output.text", "$.output.choices[0].message.content", "$.text")
    return F.coalesce(*[F.get_json_object(raw, p) for p in paths])


def parse_sse(log: DataFrame) -> DataFrame:
    """request_id, text of log lines (request_id, seq, line): `data: ` lines up to [DONE], in order; what isn't JSON is skipped."""
    data = log.where(F.startswith("line", F.lit("data: "))).select("request_id", "seq", F.trim(F.expr("substr(line, 7)")).alias("raw"))
    end = F.min(F.when(F.col("raw") == "[DONE]", F.col("seq"))).over(Window.partitionBy("request_id"))
    rows = data.withColumn("end", end)
    piece = F.when(F.col("end").isNull() | (F.col("seq") < F.col("end")), F.struct("seq", response_text("raw").alias("t")))
    return rows.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "").alias("text"))
