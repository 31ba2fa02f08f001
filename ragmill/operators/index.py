"""A stored BM25 index: built once for all knowledge bases, rebuilt for those that change, searched without reading a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import written
from ..sources.versions import Store, bucket
from . import bm25

TABLES = {
    "postings": "kb_id int, term string, chunk_id string, tf long, len long",
    "terms": "kb_id int, term string, df long, tf long",
    "stats": "kb_id int, n long, avgdl double",
}


def open_index(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES).create()


def term_part(buckets: int) -> Column:
    """A knowledge base's terms lie in `buckets` partitions, so a frequent base is several, and a search reads a few."""
    return F.concat_ws("-", F.col("kb_id").cast("string"), bucket("term", buckets))


def build(store: Store, toks: DataFrame, kbs: DataFrame | None = None, buckets: int = 4) -> int:
    """Index all chunks (bm25.tokens(), a stored table), or of knowledge bases `kbs` (kb_id) only, which are replaced.

    Partitions of other knowledge bases keep their files; one of `kbs` without chunks is left without an index.
    """
    gone = None
    if kbs is not None:
        kbs = kbs.select("kb_id").distinct()
        mine = kbs.agg(F.collect_set("kb_id").alias("mine")).first()["mine"]
        toks = toks.withColumn("kbs", F.array_intersect("kbs", F.array(*map(F.lit, mine)).cast("array<int>"))).where(F.size("kbs") > 0)
        names = kbs.select(F.col("kb_id").cast("string").alias("kb"))
        old = store.entries().withColumn("kb", F.split("part", "-")[0]).join(names, "kb", "left_semi")
        gone = {n: old.where(F.col("name") == n).select("part") for n in TABLES}
    part = term_part(buckets)
    post = store.stage("postings", bm25.token_postings(toks), part)
    df = store.stage("terms", post.rows.groupBy("kb_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), part)
    stat = store.stage("stats", bm25.token_stats(toks), F.col("kb_id").cast("string"))
    return store.publish([post, df, stat], gone)


def search(store: Store, queries: DataFrame, top_k: int = 5, buckets: int = 4, **weights: float) -> DataFrame:
    """bm25.search() of a stored index: only partitions that hold a term some query asks for are read."""
    asked = written(bm25.asked_terms(queries), "asked")
    parts = asked.select(term_part(buckets).alias("part")).distinct()
    version = store.version()[0]
    own = queries.select(F.col("kb_id").cast("string").alias("part")).distinct()
    return bm25.ranked(asked, store.read("postings", parts, version), store.read("terms", parts, version).drop("tf"), store.read("stats", own, version), top_k, **weights)
