"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, pieces; counted as part of ragmill.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm import mixing, neardup, pieces, quality, repeats
from ragmill.llm.common import LOW, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_id(*columns: str):
    """The document's id; null as the least, as the operators have it."""
    return F.coalesce(F.col(columns[0]).cast("long"), F.lit(LOW).cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, trained on all labels, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    kept = quality.score(docs, model, carry=tuple(COLUMNS)).where("predicted = 1")
    return kept.select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of those kept under its least id, that with the most shingles, then the least hash."""
    row = F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])
    kept = neardup.near_duplicates(docs, mark=row).where("kept")
    kept = kept.groupBy(row_id("doc_id").alias("_kept")).agg(F.min(F.struct((-F.col("n_shingles")).alias("n"), "row"))["row"].alias("_row"))
    kept = stored(kept, "pipeline-kept")
    out = docs.join(kept.hint("merge"), (row_id("doc_id") == F.col("_kept")) & (row == F.col("_row")))
    return out.dropDuplicates(["_kept", "_row"]).select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of 400-byte strings that start elsewhere too."""
    out = repeats.remove_repeats(docs, carry=("doc_id", "lang", "source"), keep_text=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources 3:1:2 to 150 % of all words; a document taken twice is two rows."""
    mix = mixing.pareto_mix(docs, doc_weight=F.length(F.col("size").cast("string")))
    copies = stored(mix.where("copies > 0").select(row_id("doc_id").alias("_id"), "copies").groupBy("_id").agg(F.max("copies").cast("int").alias("copies")), "pipeline-copies")
    out = docs.join(copies.hint("merge"), row_id("doc_id") == F.col("_id")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces: doc_id, source, n_pieces, ids."""
    out = pieces.encode(docs, carry=("doc_id", "source"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeats_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]
#: SQL has no Bradley-Terry training; tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
