"""Feedback of users on messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(events: DataFrame) -> DataFrame:
    """message_id, user_id and the last rating and type; the last comment that isn't empty."""
    last = F.struct("ts", "event_id")
    filled = F.when(F.col("comment") != "", last)
    return events.groupBy("message_id", "user_id").agg(F.max_by("rating", last).alias("rating"), F.max_by("feedback_type", last).alias("feedback_type"), F.coalesce(F.max_by("comment", filled), F.lit("")).alias("comment"))


def stats(events: DataFrame, since: str, *keys: str) -> DataFrame:
    """Counts of ratings since a time, their mean and the share of positive ones; zeros if there are none."""
    rows = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    total = F.count("*")
    ratio = lambda x: F.coalesce(F.round(x, 3), F.lit(0.0))
    return rows.groupBy(*keys).agg(total.alias("total"), F.count_if(F.col("rating") > 0).alias("positive"), F.count_if(F.col("rating") < 0).alias("negative"), F.count_if(F.col("rating") == 0).alias("neutral"), ratio(F.avg("rating")).alias("avg_rating"), ratio(F.count_if(F.col("rating") > 0) / F.nullif(total, F.lit(0))).alias("positive_rate"))


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce(F.nullif(F.col("feedback_type"), F.lit("")), F.lit("unknown")).alias("feedback_type")).agg(F.count("*").alias("n"))


def of_kb(events: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Events with the knowledge base of their message's conversation."""
    return events.join(messages.select("message_id", "conv_id"), "message_id").join(conversations.select("conv_id", "kb_id"), "conv_id")


def current(messages: DataFrame, ratings: DataFrame, user_id: int) -> DataFrame:
    """message_id, rating of a user, 0 where none."""
    mine = ratings.where(F.col("user_id") == user_id).select("message_id", "rating")
    return messages.select("message_id").join(mine, "message_id", "left").select("message_id", F.coalesce("rating", F.lit(0)).alias("rating"))
