"""Queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, chunking, language, mixing, neardup, neighbours, pieces, quality, repeats, secrets, sql, warc, whitening
from .common import table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 3:1:2 to 150 % of their words; longer documents (by digits of their size) are likelier."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.pareto_mix(docs, doc_weight=F.length(F.col("size").cast("string")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against a copy whose later assistant turns are spoilt: prompt, completions and loss spans."""
    pairs = chat.degraded_pairs(chat.gather_turns(table(spark, sf_dir, "conversations")))
    out = chat.preference_format(pairs).withColumnRenamed("pair_id", "conv_id")
    return out.withColumns({c: chat.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a Bradley-Terry ranker that learns from three folds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = quality.fit(docs, labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document and its edited text, and what they share with each other and the next one."""
    return chunking.next_and_edited(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its 400-byte strings that start anywhere else."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, similarity 0.75 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; the text model counts trigrams of all documents."""
    model = language.fit_text_model(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    out = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces: their ids, how many of them and of units there are, and whether they decode to the text."""
    out = pieces.encode(table(spark, sf_dir, "documents"), check=True)
    return out.select("doc_id", "n_units", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other embeddings of each one whose id is divisible by 100."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the first 16 components of the distinct ones, a row for each component."""
    rows = whitening.whole_entries(table(spark, sf_dir, "embeddings"))
    model = whitening.fit(rows)
    share = F.element_at(F.array(*[F.lit(float(x)) for x in model.explained], F.lit(None).cast("double")), F.col("component"))
    out = whitening.whiten(rows, model).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    out = out.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened")
    return out.select("*", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: how many of each base kind, a digest of their places, and the places of all kinds."""
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    counts = {f"n_{r.kind}": F.size(secrets.of_kinds(F.col("spans"), r.kind)).cast("long") for r in secrets.BASE}
    base = secrets.spans_text(secrets.of_kinds(F.col("spans"), *[r.kind for r in secrets.BASE]))
    return spans.select("doc_id", *[v.alias(k) for k, v in counts.items()], F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters of all documents interact, by language, order and step; documents arrive in about eight micro-batches."""
    docs, groups = audit.stream_of(spark, f"{sf_dir}/documents.parquet")
    return audit.audit(docs, table(spark, sf_dir, "labels"), groups)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items() if k in queries()}
