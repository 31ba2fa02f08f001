"""Chunking: segments, token packing with overlap, parents, character windows, boundary groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FENCE = "```"


def paragraphs(docs: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    """document_id, pos, text: paragraphs between blank lines, trimmed, without empties."""
    parts = F.filter(F.transform(F.split("text", separator), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: F.length(x) > 0)
    return docs.select("document_id", F.posexplode(parts).alias("pos", "text"))


def segments(parts: DataFrame) -> DataFrame:
    """document_id, pos, text, type of paragraphs: code blocks joined between fences, tables marked.

    A paragraph that starts with a fence opens or closes a block; one that does both at once only opens. Paragraphs
    between join by line feed; a block that never closes ends with the document. Two lines or more with a bar in
    at least two make a table.
    """
    order = Window.partitionBy("document_id").orderBy("pos")
    fence = F.startswith("text", F.lit(FENCE)).cast("int")
    marked = parts.withColumn("fences", F.sum(fence).over(order)).withColumn("fence", fence)
    inside = (F.col("fences") % 2 == 1) | (F.col("fence") == 1)
    block = F.when(inside, F.floor((F.col("fences") + 1) / 2)).otherwise(F.lit(None))
    marked = marked.withColumn("key", F.when(inside, -block).otherwise(F.col("pos").cast("long")))
    whole = marked.groupBy("document_id", "key").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max(inside).alias("code"))
    lines = F.split("text", "\n")
    table = (F.size(lines) >= 2) & (F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))) >= 2)
    return whole.select("document_id", "pos", "text", F.when(F.col("code"), "code_block").when(table, "table").otherwise("paragraph").alias("type"))


def attach_pages(segs: DataFrame, pages: DataFrame, head: int = 100) -> DataFrame:
    """The first page (document_id, page, page_text) that contains a segment's first `head` characters; null if none."""
    found = segs.join(pages, "document_id").where(F.expr(f"instr(page_text, substr(text, 1, {head})) > 0"))
    first = found.groupBy("document_id", "pos").agg(F.min("page").alias("page"))
    return segs.join(first, ["document_id", "pos"], "left")


def split_long(text: Column, most: int) -> Column:
    """Sentences of a long text packed greedily to `most` tokens, joined without a separator; the text itself if none."""
    sents = F.filter(F.transform(F.split(text, T.SENTENCE_END), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: F.length(x) > 0)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        n = T.token_count(s)
        full = (a["n"] + n > most) & (F.length(a["held"]) > 0)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"), F.when(full, s).otherwise(F.concat(a["held"], s)).alias("held"), F.when(full, n).otherwise(a["n"] + n).alias("n"))

    end = lambda a: F.when(F.length(a["held"]) > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"])
    parts = F.aggregate(sents, start, step, end)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


CHUNK = "array<struct<content:string,token_count:int,type:string,page:int>>"


def pack(segs: DataFrame, target: int = 256, overlap: int = 50, joiner: str = "\n\n") -> DataFrame:
    """Pack segments (document_id, pos, text, type, page) greedily: document_id, chunk_index, content, token_count, type, page.

    One fold over each document's segments. Tables and code of up to twice the target stay whole, after what is held
    has been emitted. A segment that doesn't fit first emits what is held, with the next segment's type and page, and
    carries over the head of the last text held if that is longer than the overlap; the last chunk has neither. Longer
    segments are split at sentences and emitted part by part, while the carried text stays held.
    """
    seg = F.struct("pos", "text", "type", "page")
    rows = segs.groupBy("document_id").agg(F.array_sort(F.collect_list(seg)).alias("segs"))
    texts, chunks = F.array().cast("array<string>"), F.array().cast(CHUNK)
    start = F.struct(texts.alias("held"), F.lit(0).alias("n"), chunks.alias("out"))

    def chunk(content: Column, kind: Column, page: Column, count: Column | None = None) -> Column:
        return F.struct(content.alias("content"), (T.token_count(content) if count is None else count).alias("token_count"), kind.cast("string").alias("type"), page.cast("int").alias("page"))

    def step(a: Column, s: Column) -> Column:
        n = T.token_count(s["text"])
        holding = F.size(a["held"]) > 0
        held = F.array(chunk(F.array_join(a["held"], joiner), s["type"], s["page"]))
        whole = s["type"].isin("table", "code_block") & (n <= 2 * target)
        alone = F.struct(texts.alias("held"), F.lit(0).alias("n"), F.concat(a["out"], F.when(holding, held).otherwise(chunks), F.array(chunk(s["text"], s["type"], s["page"]))).alias("out"))
        full = (a["n"] + n > target) & holding
        out = F.when(full, F.concat(a["out"], held)).otherwise(a["out"])
        last = F.element_at(a["held"], -1)
        carried = F.when((F.lit(overlap) > 0) & (T.token_count(last) > overlap), F.array(T.token_truncate(last, overlap))).otherwise(texts)
        left = F.when(full, carried).otherwise(a["held"])
        left_n = F.when(full, F.when(F.size(carried) > 0, T.token_count(F.element_at(carried, 1))).otherwise(0)).otherwise(a["n"])
        parts = F.filter(split_long(s["text"], target), lambda p: F.length(F.trim(p)) > 0)
        long = F.struct(left.alias("held"), left_n.alias("n"), F.concat(out, F.transform(parts, lambda p: chunk(F.btrim(p, F.lit(" \t\r\n")), s["type"], s["page"], T.token_count(p)))).alias("out"))
        more = F.struct(F.concat(left, F.array(s["text"])).alias("held"), (left_n + n).alias("n"), out.alias("out"))
        return F.when(whole, alone).when(n > target, long).otherwise(more)

    none = F.lit(None)
    end = lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(chunk(F.array_join(a["held"], joiner), none, none)))).otherwise(a["out"])
    packed = rows.select("document_id", F.posexplode(F.aggregate("segs", start, step, end)).alias("chunk_index", "c"))
    return packed.select("document_id", "chunk_index", "c.content", "c.token_count", "c.type", "c.page")


def parents(subs: DataFrame, per_parent: int = 4, most: int = 1024, joiner: str = "\n\n") -> DataFrame:
    """Each `per_parent` consecutive sub-chunks as one parent: document_id, parent_index, content, token_count, pages, sub_count."""
    rows = subs.groupBy("document_id", F.floor(F.col("chunk_index") / per_parent).cast("int").alias("parent_index")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), joiner).alias("content"),
        F.array_sort(F.collect_set(F.when(F.col("page") != 0, F.col("page")))).alias("pages"), F.count("*").alias("sub_count"))
    n = T.token_count(F.col("content"))
    return rows.select("document_id", "parent_index", F.when(n > most, T.token_truncate(F.col("content"), most)).otherwise(F.col("content")).alias("content"), F.least(n, F.lit(most)).alias("token_count"), "pages", "sub_count")


def windows(docs: DataFrame, size: int = 700, overlap: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """document_id, the `carry` columns, chunk_index, content: character windows of each text."""
    starts = docs.select("document_id", *carry, "text", F.posexplode(T.window_starts(F.length("text"), size, overlap)).alias("chunk_index", "start"))
    return starts.select("document_id", *carry, "chunk_index", F.expr(f"substr(text, start + 1, {size})").alias("content"))


def two_level_windows(docs: DataFrame, parent: tuple[int, int] = (2200, 250), sub: tuple[int, int] = (700, 100)) -> DataFrame:
    """Windows of windows: document_id, parent_index, chunk_index (over the whole document), content, token_count."""
    up = windows(docs, *parent).withColumnsRenamed({"chunk_index": "parent_index", "content": "text"})
    low = up.select("document_id", "parent_index", "text", F.posexplode(T.window_starts(F.length("text"), *sub)).alias("k", "start"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("parent_index", "k")) - 1
    content = F.expr(f"substr(text, start + 1, {sub[0]})")
    return low.select("document_id", "parent_index", index.cast("int").alias("chunk_index"), content.alias("content")).withColumn("token_count", T.token_count(F.col("content")))


def boundary_indices(replies: DataFrame) -> DataFrame:
    """document_id, boundaries of replies (document_id, batch_offset, batch_len, raw): the first list of numbers, those within the batch, sorted, each once."""
    numbers = F.from_json(F.regexp_extract("raw", r"\[[0-9,\s]*\]", 0), "array<int>")
    inside = F.transform(F.filter(F.coalesce(numbers, F.array().cast("array<int>")), lambda x: (x >= 0) & (x <= F.col("batch_len") - 2)), lambda x: (x + F.col("batch_offset")).cast("int"))
    return replies.groupBy("document_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(inside)))).alias("boundaries"))


def by_boundaries(segs: DataFrame, bounds: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """Segments cut after each boundary index: document_id, group_id, content, page (first not 0), type (commonest, ties by name)."""
    rows = segs.join(bounds, "document_id", "left").withColumn("group_id", F.size(F.filter(F.coalesce("boundaries", F.array().cast("array<int>")), lambda b: b < F.col("pos"))))
    kinds = rows.groupBy("document_id", "group_id", "type").count().groupBy("document_id", "group_id").agg(F.min_by("type", F.struct(-F.col("count"), "type")).alias("type"))
    merged = rows.groupBy("document_id", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), joiner).alias("content"), F.min_by("page", F.when(F.col("page") != 0, F.col("pos"))).alias("page"))
    return merged.join(kinds, ["document_id", "group_id"])


def pseudo_pages(docs: DataFrame, lines: int = 200) -> DataFrame:
    """document_id, page, page_text: every `lines` lines of a text."""
    parts = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / lines).cast("int"))
    return docs.select("document_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice(parts, i * lines + 1, lines), "\n"))).alias("page", "page_text")).withColumn("page", F.col("page") + 1)
