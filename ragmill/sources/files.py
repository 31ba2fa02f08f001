"""Files as tables: whole text files, and evaluation datasets as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA = "question string, answer string, source_document_id long, source_chunk_index int, source_filename string"


def text_files(spark: SparkSession, folder: str, pattern: str = "*.{txt,md,markdown}") -> DataFrame:
    """path, text, format, line_count, file_size of every text file; bytes that aren't UTF-8 become replacement marks."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    rows = rows.select("path", F.expr("make_valid_utf8(cast(content as string))").alias("text"), F.col("length").alias("file_size"))
    return rows.select("path", "text", F.upper(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"), F.size(F.split("text", "\n")).alias("line_count"), "file_size")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written under spark.checkpoint.dir and read back, so that what follows uses it many times and computes it once.

    Where no such folder is set, df as it is.
    """
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_dataset(pairs: DataFrame, folder: str, kb_id: int, stamp: str, label: str = "") -> str:
    """Write question-answer pairs as JSON under kb_{id}_{stamp}[_label]; returns the folder."""
    path = f"{folder.rstrip('/')}/kb_{kb_id}_{stamp}" + (f"_{label}" if label else "")
    pairs.write.mode("overwrite").json(path)
    return path


def save_datasets(pairs: DataFrame, folder: str, stamp: str) -> None:
    """Write the pairs of every knowledge base (column kb_id) as its own dataset kb_{id}_{stamp}, in one job."""
    name = F.concat(F.lit("kb_"), F.col("kb_id").cast("string"), F.lit(f"_{stamp}"))
    pairs.withColumn("dataset", name).drop("kb_id").write.mode("overwrite").partitionBy("dataset").json(folder)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QA).json(path, mode="PERMISSIVE")


def list_datasets(spark: SparkSession, folder: str, kb_id: int | None = None) -> DataFrame:
    """name, pair_count, modified of saved datasets, newest first; rows that can't be read count as none."""
    rows = spark.read.schema(QA + ", _broken string").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").json(folder, mode="PERMISSIVE")
    rows = rows.select("question", "_metadata.file_path", "_metadata.file_modification_time")
    out = rows.groupBy(F.regexp_extract("file_path", "([^/=]+)/[^/]+$", 1).alias("name")).agg(F.count("question").alias("pair_count"), F.max("file_modification_time").alias("modified"))
    return (out if kb_id is None else out.where(F.startswith("name", F.lit(f"kb_{kb_id}_")))).orderBy(F.desc("modified"), F.desc("name"))
