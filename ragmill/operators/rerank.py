"""Rerank arithmetic: score replies, normalisation, cuts, tag boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORES = "struct<scores:array<struct<id:string,score:double>>>"


def of_query():
    return Window.partitionBy("query_id")


def sigmoid(cands: DataFrame, steep: float = 0.8) -> DataFrame:
    """Candidates with norm = 1 / (1 + exp(-steep * z)), z by the query's population deviation; 0.5 where that is 0."""
    mean, dev = F.avg("raw").over(of_query()), F.stddev_pop("raw").over(of_query())
    return cands.withColumn("norm", F.when(dev < 1e-6, 0.5).otherwise(F.round(1 / (1 + F.exp(-steep * (F.col("raw") - mean) / dev)), 4)))


def parse_scores(replies: DataFrame, most: float = 100.0, default: float = 50.0, digits: str = "[0-9]{1,3}", scale: float = 1.0) -> DataFrame:
    """query_id, id, score of replies (query_id, raw, ids: array<struct<short,full>>).

    The reply's JSON object with "scores" gives a score for each id it names, held between 0 and `most`. Without one,
    each id takes the first number after its short form in the reply, or `default`.
    """
    data = F.from_json(F.regexp_extract("raw", r'(?s)\{[^{}]*"scores"[^{}]*\[.*?\][^{}]*\}', 0), SCORES)["scores"]
    rows = replies.withColumn("data", data).withColumn("ok", F.coalesce(F.size("data") > 0, F.lit(False)))
    named = rows.where("ok").select("query_id", "ids", F.explode("data").alias("s"))
    some = F.filter("ids", lambda x: x["short"] == F.col("s.id"))
    by_json = named.select("query_id", F.when(F.size(some) > 0, F.get(some, F.lit(0))["full"]).otherwise(F.col("s.id")).alias("id"), F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce("s.score", F.lit(default)))).alias("score"))
    loose = rows.where("not ok").select("query_id", "raw", F.explode("ids").alias("x"))
    after = F.expr(f"regexp_extract(substr(raw, instr(raw, x.short) + length(x.short)), '({digits})', 1)")
    by_text = loose.select("query_id", F.col("x.full").alias("id"), F.when((F.expr("instr(raw, x.short)") > 0) & (F.length(after) > 0), after.cast("double")).otherwise(F.lit(default)).alias("score"))
    return by_json.unionByName(by_text).withColumn("score", F.col("score") / scale)


def rerank(cands: DataFrame, top_k: int = 5, always: bool = False) -> DataFrame:
    """query_id, id, rerank_score, rank of candidates (query_id, id, rank, score, raw).

    A query with top_k candidates or fewer keeps its order and its scores (0.5 where missing), unless `always`; others
    go by the normalised raw score and are cut. Without any raw score the first top_k stay.
    """
    marked = sigmoid(cands).withColumn("n", F.count("*").over(of_query())).withColumn("rated", F.count("raw").over(of_query()))
    passed = F.lit(False) if always else (F.col("n") <= top_k)
    keep = passed | (F.col("rated") == 0)
    by_score = F.row_number().over(of_query().orderBy(F.desc("norm"), "id"))
    out = marked.withColumn("by", by_score).select("query_id", "id", F.when(keep, F.coalesce("score", F.lit(0.5))).otherwise(F.col("norm")).alias("rerank_score"), F.when(keep, F.col("rank")).otherwise(F.col("by")).cast("int").alias("rank"))
    return out.where(F.col("rank") <= top_k)


def tag_boost(results: DataFrame, queries: DataFrame, tags: DataFrame, step: float = 0.15, most: float = 1.3) -> DataFrame:
    """Results (query_id, document_id, score, rank) with boosted = score * min(1 + step * m, most), m tags of the document in the query's text.

    Order and rank stay as they are.
    """
    joined = results.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(tags.select("document_id", "name").distinct(), "document_id", "left")
    hits = joined.groupBy("query_id", "document_id", "rank").agg(F.first("score").alias("score"), F.count_if(F.contains("_q", "name")).alias("m"))
    factor = F.least(1 + step * F.col("m"), F.lit(most))
    return hits.withColumn("boosted", F.round(F.col("score") * factor, 6))
