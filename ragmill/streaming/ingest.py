"""Ingestion of arriving documents: chunks, vectors and states, each micro-batch all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, vectors
from ..operators.catalog import ACCEPTED
from ..sources.versions import Store, bucket, kb_part

TABLES = {
    "chunks": "document_id long, parent_index int, chunk_index int, content string, token_count int",
    "vectors": "kb_id int, id string, document_id long, parent_index int, chunk_index int, cells array<struct<bucket: int, weight: double>>",
    "states": "document_id long, seq int, status string, chunk_count long, message string, batch long",
}


def open_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES).create()


def chunk_vectors(chunks: DataFrame, kbs: DataFrame) -> DataFrame:
    """One sparse vector for each chunk, the stand-in for a model's, under its document's knowledge base (document_id, kb_id)."""
    keyed = chunks.withColumn("id", F.concat(F.lit("doc-"), F.col("document_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string")))
    cells = vectors.hashed_terms(keyed.select("id", F.col("content").alias("text")))
    cells = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("cells"))
    none = F.array().cast("array<struct<bucket: int, weight: double>>")
    out = keyed.join(kbs, "document_id").join(cells, "id", "left")
    return out.select("kb_id", "id", "document_id", "parent_index", "chunk_index", F.coalesce("cells", none).alias("cells"))


def refused() -> Column:
    """Why a document (file_type, text) can't be read; null if it can."""
    blank = F.coalesce(F.length(F.btrim("text", F.lit(" \t\r\n"))), F.lit(0)) == 0
    return F.when(~F.coalesce(F.lower("file_type"), F.lit("")).isin(*ACCEPTED), "unsupported type").when(blank, "no extractable text")


def transitions(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """document_id, seq, status, chunk_count, message: the states that each document goes through.

    uploading and parsing, then failed for a type that isn't read or a text without anything but blanks, or else
    chunking, embedding and completed, with the number of chunks.
    """
    good, bad = (F.array(*map(F.lit, ["uploading", "parsing", *more])) for more in (["chunking", "embedding", "completed"], ["failed"]))
    rows = docs.select("document_id", refused().alias("message")).join(counts, "document_id", "left")
    rows = rows.select("*", F.posexplode(F.when(F.col("message").isNull(), good).otherwise(bad)).alias("seq", "status"))
    count = F.when(F.col("status") == "completed", F.coalesce("chunk_count", F.lit(0)))
    return rows.select("document_id", "seq", "status", count.alias("chunk_count"), F.when(F.col("status") == "failed", F.col("message")).alias("message"))


def current(states: DataFrame) -> DataFrame:
    """document_id, status, chunk_count, message: the latest state of each document."""
    return states.groupBy("document_id").agg(F.max_by(F.struct("status", "chunk_count", "message"), F.struct("batch", "seq")).alias("s")).select("document_id", "s.*")


def take_in(store: Store, docs: DataFrame, batch: int, buckets: int = 8) -> None:
    """One micro-batch of documents (document_id, kb_id, file_type, text) into the store, as one version.

    Documents that are completed, or twice in the batch, are taken once; failed ones are tried again. A batch that the
    store already holds is left alone, so a rerun after a crash adds nothing twice. Only the states of the buckets
    that the batch touches are read.
    """
    version, last = store.version()
    if last is not None and last >= batch:
        return
    own = bucket("document_id", buckets)
    docs = docs.where("document_id is not null").dropDuplicates(["document_id"]).persist()
    touched = docs.select(own.alias("part")).distinct()
    done = current(store.read("states", touched, version)).where("status = 'completed'").select("document_id")
    fresh = docs.join(done, "document_id", "left_anti").persist()
    readable = fresh.where(refused().isNull())
    chunks = store.stage("chunks", chunk.two_level_windows(readable), own)
    kbs = fresh.where("kb_id is not null").select("document_id", "kb_id")
    vecs = store.stage("vectors", chunk_vectors(chunks.rows.drop("part"), kbs), kb_part(buckets))
    counts = chunks.rows.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    states = transitions(fresh, counts).withColumn("batch", F.lit(batch))
    store.publish([chunks, vecs, store.stage("states", states, own)], batch=batch)
    fresh.unpersist()
    docs.unpersist()


def ingest(docs: DataFrame, store: Store, checkpoint: str, buckets: int = 8) -> None:
    """A stream of documents into the store, until all that is there has been taken in."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda df, batch: take_in(store, df, batch, buckets)).start().awaitTermination()
