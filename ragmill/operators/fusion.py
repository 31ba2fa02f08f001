"""Fusion of ranked lists (query_id, list_id, rank, id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, id, rrf, score: sum of 1 / (k + rank); the score is that of the first list with the id."""
    out = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("rrf"), F.min_by("score", F.struct("list_id", "rank")).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")))


def min_max(lists: DataFrame) -> DataFrame:
    """Lists with `norm`, the score scaled to 0..1 in each list; 1 if all scores are equal."""
    of_list = Window.partitionBy("query_id", "list_id")
    low, high = F.min("score").over(of_list), F.max("score").over(of_list)
    return lists.withColumn("norm", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def linear(semantic: DataFrame, bm25: DataFrame, w_semantic: float = 0.7, w_bm25: float = 0.3) -> DataFrame:
    """query_id, id, fused, rank: weighted sum of both lists' scaled scores, a missing one 0."""
    side = lambda df, name: min_max(df.withColumn("list_id", F.lit(0))).select("query_id", "id", F.col("norm").alias(name))
    both = side(semantic, "s").join(side(bm25, "b"), ["query_id", "id"], "full_outer")
    fused = F.round(w_semantic * F.coalesce("s", F.lit(0.0)) + w_bm25 * F.coalesce("b", F.lit(0.0)), 4)
    out = both.select("query_id", "id", fused.alias("fused"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")))


def hybrid(semantic: DataFrame, bm25: DataFrame, top_k: int = 5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of both lists (query_id, id, score, rank); a query without a BM25 hit keeps the semantic list."""
    s, b = (df.select("query_id", F.lit(i).alias("list_id"), "rank", "id", "score") for i, df in ((0, semantic), (1, bm25)))
    fused = reciprocal_rank(s.unionByName(b), k)
    has = b.select("query_id").distinct().withColumn("has", F.lit(True))
    out = fused.join(has, "query_id", "left").join(s.select("query_id", "id", F.col("rank").alias("own")), ["query_id", "id"], "left")
    final = F.when(F.col("has"), F.col("rank")).otherwise(F.col("own"))
    return out.select("query_id", "id", F.when(F.col("has"), F.col("rrf")).alias("rrf"), "score", final.alias("rank")).where(F.col("rank") <= top_k)


def multi_query(lists: DataFrame, k: int = 60) -> DataFrame:
    """Fusion of the lists of a query's variants, the first non-empty one twice; a single list stays as it is (rrf null)."""
    first = Window.partitionBy("query_id")
    marked = lists.withColumn("first", F.min("list_id").over(first)).withColumn("last", F.max("list_id").over(first))
    again = marked.where("list_id = first").withColumn("list_id", F.lit(1 << 20))
    many = reciprocal_rank(marked.unionByName(again).where("first < last").select("query_id", "list_id", "rank", "id", "score"), k)
    one = marked.where("first = last").select("query_id", "id", F.lit(None).cast("double").alias("rrf"), "score", "rank")
    return many.unionByName(one)


def variants(queries: DataFrame, expansions: DataFrame) -> DataFrame:
    """query_id, variant, text: the query's text first, then its expansions (query_id, expansions), each once."""
    both = queries.join(expansions, "query_id", "left")
    texts = F.array_distinct(F.concat(F.array("text"), F.coalesce("expansions", F.array().cast("array<string>"))))
    return both.select("query_id", F.posexplode(texts).alias("variant", "text"))
