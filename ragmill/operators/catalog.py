"""Documents, knowledge bases and conversations as relations; deletes return what is left of every table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED = ("pdf", "docx", "doc", "txt", "md", "markdown")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def gate(files: DataFrame, accepted: tuple[str, ...] = ACCEPTED, most: int = 50 << 20) -> DataFrame:
    """Files (original_filename, file_size) with a safe name and the reason to reject them, or null."""
    ext = extension(F.col("original_filename"))
    reason = F.when(~ext.isin(*accepted), "extension").when(F.col("file_size") > most, "size")
    return files.withColumn("safe_name", F.regexp_replace("original_filename", r"[/\\]", "_")).withColumn("reject_reason", reason)


def raw_documents(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Files (original_filename, text) and web pages (url, title, text) in one shape: source_type, source_identifier, display_name, file_type, file_size, content."""
    f = files.select(F.lit("file").alias("source_type"), F.col("original_filename").alias("source_identifier"), F.col("original_filename").alias("display_name"), extension(F.col("original_filename")).alias("file_type"), F.octet_length("text").cast("long").alias("file_size"), F.col("text").alias("content"))
    w = pages.select(F.lit("web").alias("source_type"), F.col("url").alias("source_identifier"), F.coalesce(F.nullif(F.col("title"), F.lit("")), "url").alias("display_name"), F.lit("web").alias("file_type"), F.octet_length("text").cast("long").alias("file_size"), F.col("text").alias("content"))
    return f.unionByName(w)


def url_outcome(urls: DataFrame, known: DataFrame) -> DataFrame:
    """Urls (user_id, url, id) with ok, duplicate (in the batch or known) or error (not valid)."""
    from ..functions.text import normal_url, valid_url

    rows = urls.withColumn("valid", F.coalesce(valid_url(F.col("url")), F.lit(False))).withColumn("url", normal_url(F.col("url")))
    seen = known.select("user_id", "url").distinct().withColumn("seen", F.lit(True))
    first = F.row_number().over(Window.partitionBy("user_id", "url").orderBy("id"))
    rows = rows.withColumn("nth", first).join(seen, ["user_id", "url"], "left")
    return rows.select("id", "user_id", "url", F.when(~F.col("valid"), "error").when((F.col("nth") > 1) | F.col("seen"), "duplicate").otherwise("ok").alias("outcome"))


def membership(docs: DataFrame, doc_kb: DataFrame) -> DataFrame:
    """document_id, kb_id by the direct column or the bridge table."""
    return docs.where("kb_id is not null").select("document_id", "kb_id").union(doc_kb.select("document_id", "kb_id")).distinct()


def list_documents(docs: DataFrame, user_id: int, doc_kb: DataFrame | None = None, kb_id: int | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """A user's documents, newest (greatest id) first; of a knowledge base by the bridge table alone; holding all tags of `tagged`."""
    out = docs.where(F.col("user_id") == user_id)
    if doc_kb is not None:
        out = out.join(doc_kb.where(F.col("kb_id") == kb_id).select("document_id"), "document_id", "left_semi")
    if tagged is not None:
        out = out.join(tagged, "document_id", "left_semi")
    return out.orderBy(F.desc("document_id"))


def not_in_kb(docs: DataFrame, doc_kb: DataFrame, user_id: int, kb_id: int) -> DataFrame:
    inside = doc_kb.where(F.col("kb_id") == kb_id).select("document_id")
    return docs.where((F.col("user_id") == user_id) & (F.col("status") == "completed")).join(inside, "document_id", "left_anti")


def count_links(docs: DataFrame, kbs: DataFrame, doc_kb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Knowledge bases of each document, and documents of each knowledge base; 0 where there are none."""
    of = lambda df, key: df.join(doc_kb.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    return of(docs, "document_id"), of(kbs, "kb_id")


def delete_documents(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in `gone`."""
    return {name: df.join(gone, "document_id", "left_anti") for name, df in tables.items()}


def delete_kb(gone: DataFrame, docs: DataFrame, conversations: DataFrame, doc_kb: DataFrame, kbs: DataFrame) -> dict[str, DataFrame]:
    """Documents and conversations keep their rows and lose the link; relations and the knowledge base's row go."""
    mark = gone.select("kb_id").distinct().withColumn("_gone", F.lit(True))
    unlink = lambda df: df.join(mark, "kb_id", "left").withColumn("kb_id", F.when(F.col("_gone"), None).otherwise(F.col("kb_id"))).drop("_gone")
    return {"docs": unlink(docs), "conversations": unlink(conversations), "doc_kb": doc_kb.join(mark, "kb_id", "left_anti"), "kbs": kbs.join(mark, "kb_id", "left_anti")}


def link(doc_kb: DataFrame, new: DataFrame) -> DataFrame:
    return doc_kb.select("document_id", "kb_id").union(new.select("document_id", "kb_id")).dropDuplicates(["document_id", "kb_id"])


def unlink(doc_kb: DataFrame, gone: DataFrame) -> DataFrame:
    """The bridge without the pairs in `gone`; pairs that aren't there change nothing."""
    return doc_kb.select("document_id", "kb_id").join(gone.select("document_id", "kb_id"), ["document_id", "kb_id"], "left_anti")


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """kb_id of the knowledge bases whose membership changed, each once: those whose index must be built again."""
    side = lambda df, n: df.select("document_id", "kb_id").distinct().withColumn("n", F.lit(n))
    both = side(before, 1).unionByName(side(after, -1)).groupBy("document_id", "kb_id").agg(F.sum("n").alias("n"))
    return both.where("n <> 0").select("kb_id").distinct()


def page_of(rows: DataFrame, page: int, size: int, order: str = "document_id") -> DataFrame:
    """One page, newest first, with total and total_pages; page and size are held to 1 and 1..100.

    Only the rows up to the page's end are sorted (a top-k), the count is an aggregate beside them.
    """
    page, size = max(1, page), min(100, max(1, size))
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(F.desc(order)).limit(page * size)
    nth = F.row_number().over(Window.orderBy(F.desc(order)))
    return top.withColumn("nth", nth).where(F.col("nth") > (page - 1) * size).crossJoin(F.broadcast(total)).withColumn("total_pages", F.ceil(F.col("total") / size))


def progress(status: Column) -> Column:
    #: Progress of a document's states.
    steps = {"uploading": 0, "parsing": 20, "chunking": 45, "embedding": 75, "completed": 100}
    out = F.lit(0)
    for name, value in steps.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def conversation_titles(messages: DataFrame, conversations: DataFrame, most: int = 50) -> DataFrame:
    """conv_id, title (first user message, cut), mode (rag with a knowledge base, else chat)."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("content", "turn").alias("first"))
    rows = conversations.join(first, "conv_id", "left")
    title = F.when(F.length("first") > most, F.concat(F.substring("first", 1, most), F.lit("..."))).otherwise(F.coalesce("first", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))))
    return rows.select("conv_id", title.alias("title"), F.when(F.col("kb_id").isNotNull(), "rag").otherwise("chat").alias("mode"))
