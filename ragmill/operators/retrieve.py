"""Assembly of retrieval results: parents, sources, compression, truncation, context and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import written
from . import bm25, fusion, rerank
from .vectors import hashed_terms, text_search

SUFFIX = "\n\n...(内容已截断)"


def parents_of(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, document_id, parent_index, content, filename of the distinct parents of hits; order is by parent_index, then document."""
    wanted = hits.where("parent_index is not null").select("query_id", "document_id", "parent_index").distinct()
    rows = wanted.join(chunks, ["document_id", "parent_index"]).join(docs.select("document_id", "original_filename"), "document_id", "left")
    name = F.coalesce("original_filename", F.concat(F.lit("Doc#"), F.col("document_id").cast("string")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("parent_index", "document_id"))
    return rows.select("query_id", "document_id", "parent_index", "content", name.alias("filename"), order.alias("pos"))


def sources(hits: DataFrame, docs: DataFrame, tags: DataFrame) -> DataFrame:
    """The first hit of each (query, document, page) with filename and tag names; its score is rerank_score unless 0 or missing."""
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "document_id", "page").orderBy("rank"))).where("_r = 1").drop("_r")
    names = tags.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    score = F.coalesce(F.nullif(F.col("rerank_score"), F.lit(0.0)), "score")
    return first.join(docs.select("document_id", "original_filename"), "document_id", "left").join(names, "document_id", "left").select("query_id", "document_id", "page", score.alias("score"), F.col("original_filename").alias("filename"), F.coalesce("tags", F.lit("")).alias("tags"))


def compress(parents: DataFrame, queries: DataFrame, threshold: float = 0.3, short: int = 30, most: int = 200, dim: int = 256) -> DataFrame:
    """Parents with their sentences cut to those near the query: query_id, pos, content, kept, total, original_length.

    Sentences of up to `short` characters always stay, of the others those whose hashed vector has a cosine of
    `threshold` or more with the query's. With one sentence or none, or none kept, the text stays. Kept sentences are
    joined without a separator. Only the first `most` sentences are judged, which is the reference's own rule.
    """
    sents = parents.select("query_id", "pos", F.posexplode(F.slice(T.sentences(F.col("content")), 1, most)).alias("i", "s"))
    vec = hashed_terms(sents.select(F.struct("query_id", "pos", "i").alias("id"), F.col("s").alias("text")), dim)
    asked = hashed_terms(queries.select(F.col("query_id").alias("id"), "text"), dim).select(F.col("id").alias("query_id"), "bucket", F.col("weight").alias("w"))
    near = vec.select("id.*", "bucket", "weight").join(asked, ["query_id", "bucket"]).groupBy("query_id", "pos", "i").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("cos"))
    judged = sents.join(near, ["query_id", "pos", "i"], "left").withColumn("keep", (F.length("s") <= short) | (F.coalesce("cos", F.lit(0.0)) >= threshold))
    cut = judged.groupBy("query_id", "pos").agg(F.count("*").alias("total"), F.count_if("keep").alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("i", "s")))), lambda x: x["s"]), "").alias("short_text"))
    out = parents.join(cut, ["query_id", "pos"], "left")
    use = (F.col("total") > 1) & (F.col("kept") > 0)
    return out.select("query_id", "pos", F.when(use, F.col("short_text")).otherwise(F.col("content")).alias("content"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"), F.length("content").alias("original_length"))


def hard_truncate(parts: DataFrame, most: int = 20_000, least: int = 200) -> DataFrame:
    """Parts (query_id, pos, content) up to `most` characters for each query: whole while they fit; the first that doesn't is cut if more than `least` are left, and nothing follows."""
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("left", most - before)
    whole = F.length("content") <= F.col("left")
    return rows.where(whole | (F.col("left") > least)).withColumn("content", F.when(whole, F.col("content")).otherwise(F.expr("substr(content, 1, cast(left as int))"))).drop("left")


def context_text(parts: DataFrame, queries: DataFrame, empty: str = "(无相关文档)") -> DataFrame:
    """query_id, context: parts (query_id, pos, filename, content, compressed) with their sources, in order; `empty` without any."""
    head = F.concat(F.lit("[来源: "), F.col("filename"), F.when(F.col("compressed"), " (已压缩)").otherwise(""), F.lit("]\n"))
    rows = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(head, "content").alias("t")))), lambda x: x["t"]), "\n\n---\n\n").alias("context"))
    return queries.select("query_id").join(rows, "query_id", "left").select("query_id", F.coalesce("context", F.lit(empty)).alias("context"))


def budget(rows: DataFrame, total: int = 30_000, context: int = 20_000) -> DataFrame:
    """Rows (query_id, context, message_length) with the context cut if all messages exceed `total` and it exceeds `context` characters."""
    over = (F.col("message_length") > total) & (F.length("context") > context)
    return rows.withColumn("context", F.when(over, F.concat(F.substring("context", 1, context), F.lit(SUFFIX))).otherwise(F.col("context")))


def prompt_rows(messages: DataFrame, system: str, history: int = 20) -> DataFrame:
    """conv_id, pos, role, content: a system row, the last `history` messages before the newest, and the newest."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("message_id")))
    recent = messages.withColumn("back", back).where(F.col("back") <= history + 1).select("conv_id", (-F.col("back")).alias("o"), "role", "content")
    first = messages.select("conv_id").distinct().select("conv_id", F.lit(-(1 << 30)).alias("o"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("o"))
    return first.unionByName(recent).select("conv_id", pos.alias("pos"), "role", "content")


def guard(requests: DataFrame, kbs: DataFrame) -> DataFrame:
    """Requests (request_id, user_id, kb_id) with status 404 (no such knowledge base), 403 (another user's) or 200."""
    owner = kbs.select("kb_id", F.col("user_id").alias("owner"))
    joined = requests.join(owner, "kb_id", "left")
    return joined.withColumn("status", F.when(F.col("owner").isNull(), 404).when(F.col("owner") != F.col("user_id"), 403).otherwise(200)).drop("owner")


def validate(requests: DataFrame) -> DataFrame:
    """Requests (text, kb_id, top_k, threshold) with the first reason to reject them, or null."""
    n = F.length(F.coalesce("text", F.lit("")))
    reason = F.when((n < 1) | (n > 2000), "query").when(F.coalesce(F.col("kb_id") < 1, F.lit(True)), "kb_id").when(~F.col("top_k").between(1, 50), "top_k").when(~F.col("threshold").between(0, 1), "threshold")
    return requests.withColumn("reject_reason", reason)


def enhanced_lists(variants: DataFrame, chunks: DataFrame, images: DataFrame, fetch: int = 15, threshold: float = 0.5) -> DataFrame:
    """query_id, list_id, rank, id, score: one list for each variant (query_id, kb_id, variant, text) that has a vector hit.

    A list is the hybrid of the variant's vector and BM25 hits in `chunks` (kb_id, chunk_id, text), `fetch` of them at
    most, then its hits in `images` (same columns) in their own order. Both may be bm25.tokens() of such, a stored table. A variant without a vector hit has no list, so its
    BM25 hits don't count. Null texts have no terms and no list.
    """
    asked = variants.select(F.struct("query_id", "variant").alias("query_id"), "kb_id", "text")

    def near(df: DataFrame) -> DataFrame:
        return text_search(asked, df, fetch).where(F.col("score") >= threshold)

    semantic, pictures = written(near(chunks), "semantic"), written(near(images), "pictures")
    alive = semantic.select("query_id").unionByName(pictures.select("query_id")).distinct()
    words = bm25.search(asked.join(alive, "query_id", "left_semi"), chunks, fetch).withColumnRenamed("bm25_rank", "rank")
    words = written(words, "words")
    fused = fusion.hybrid(semantic, words, fetch).select("query_id", F.lit(0).alias("part"), "rank", "id", "score")
    both = fused.unionByName(pictures.select("query_id", F.lit(1).alias("part"), "rank", "id", "score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank"))
    return both.withColumn("rank", order).select("query_id.query_id", F.col("query_id.variant").alias("list_id"), "rank", "id", "score")


def enhanced(lists: DataFrame, raw: DataFrame, basic: DataFrame, failed: DataFrame, top_k: int = 5) -> DataFrame:
    """query_id, id, score, rank, stage: results of enhanced retrieval.

    `lists` of enhanced_lists() are fused over a query's variants, reranked by the model's scores `raw` (query_id, id,
    raw; missing ones leave the order) and cut. Queries in `failed` take the first of `basic` (query_id, id, score, rank).
    """
    merged = fusion.multi_query(lists).join(failed, "query_id", "left_anti").join(raw, ["query_id", "id"], "left")
    good = rerank.rerank(merged, top_k).select("query_id", "id", F.col("rerank_score").alias("score"), "rank", F.lit("enhanced").alias("stage"))
    plain = basic.join(failed, "query_id", "left_semi").where(F.col("rank") <= top_k)
    return good.unionByName(plain.select("query_id", "id", "score", F.col("rank").cast("int").alias("rank"), F.lit("basic").alias("stage")))


def details(variants: DataFrame, lists: DataFrame, results: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each query: stages, variants, merged_from_variants, candidates_before_rerank, final_count, parent_chunks_used, sources_count.

    `places` (id, document_id, parent_index, page) says where a result is; one without a parent counts as a source only.
    Counts of stages that a query didn't reach are 0.
    """
    asked = variants.groupBy("query_id").agg(F.count("*").alias("variants"))
    found = lists.groupBy("query_id").agg(F.count_distinct("list_id").alias("lists"), F.count_distinct("id").alias("candidates"))
    at = results.join(places, "id", "left")
    final = at.groupBy("query_id").agg(
        F.count_distinct("id").alias("final_count"), F.max(F.col("stage") == "basic").alias("basic"),
        F.count_distinct("document_id", "parent_index").alias("parent_chunks_used"),
        F.count_distinct(F.when(F.col("document_id").isNotNull(), F.struct("document_id", "page"))).alias("sources_count"))
    rows = asked.join(found, "query_id", "left").join(final, "query_id", "left").na.fill(0).na.fill(False)
    stages = F.array_compact(F.concat(
        F.array(F.when(F.col("variants") > 1, "query_rewrite")), F.array_repeat(F.lit("hybrid_search"), F.col("lists").cast("int")),
        F.array(F.when(F.col("lists") > 1, "multi_query_fusion"), F.when(F.col("basic"), "fallback_basic").when(F.col("lists") == 0, "no_results").otherwise("rerank"),
                F.when(~F.col("basic") & (F.col("lists") > 0), "complete"))))
    merged = F.when(F.col("lists") > 1, F.col("lists")).otherwise(0)
    before = F.when(F.col("basic"), 0).otherwise(F.col("candidates"))
    return rows.select(
        "query_id", F.array_join(stages, ",").alias("stages"), "variants", merged.alias("merged_from_variants"), before.alias("candidates_before_rerank"),
        "final_count", "parent_chunks_used", "sources_count")
