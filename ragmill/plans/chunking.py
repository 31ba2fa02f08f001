"""Queries of chunking and file intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, chunk, vectors
from ..sources import files, versions
from ..streaming import streams
from .base import query

PARA = "para as (select document_id, cast(i as int) - 1 as pos, p as text from (select document_id, unnest(l) as p, unnest(range(1, len(l) + 1)) as i from (select document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: length(x) > 0) as l from docs)))"
#: parts of paragraphs `para` (text) of over {most} tokens: sentences packed greedily, in a fold over a list.
LONG = r"""cut as (select *, regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+') as raw from {source}),
    sents as (select * exclude (raw), list_filter(list_transform(range(1, len(raw) + 1), lambda i: case when i = 1 then raw[i] else regexp_replace(raw[i], '^\s+', '') end), lambda x: length(trim(x, ' ' || chr(9) || chr(13) || chr(10))) > 0) as sents from cut),
    folded as (select *, list_reduce(list_transform(sents, lambda x: {{'done': []::varchar[], 'held': '', 'n': 0::bigint, 's': x}}), lambda a, x: {{
        'done': case when a.n + length(x.s) // 4 > {most} and a.held <> '' then list_append(a.done, a.held) else a.done end,
        'held': case when a.n + length(x.s) // 4 > {most} and a.held <> '' then x.s else a.held || x.s end,
        'n': case when a.n + length(x.s) // 4 > {most} and a.held <> '' then length(x.s) // 4 else a.n + length(x.s) // 4 end, 's': ''}}, {{'done': []::varchar[], 'held': '', 'n': 0::bigint, 's': ''}}) as f from sents),
    long as (select * exclude (sents, f), case when f.held <> '' then list_append(f.done, f.held) else [text] end as parts from folded)"""
#: The fold that packs paragraphs (pos, text, parts) of `long` into chunks of 256 tokens with an overlap of 50; every one is a paragraph on page 1.
PACK = """rows as (select document_id, list({'held': []::varchar[], 'n': 0::bigint, 'out': []::struct(c varchar, t bigint, k varchar, p int)[], 'text': text, 'parts': parts} order by pos) as l from long group by document_id),
    packed as (select document_id, list_reduce(l, lambda a, s: {
        'held': list_concat(case when a.n + length(s.text) // 4 > 256 and len(a.held) > 0 then case when length(a.held[-1]) // 4 > 50 then [substr(a.held[-1], 1, 200)] else []::varchar[] end else a.held end,
            case when length(s.text) // 4 > 256 then []::varchar[] else [s.text] end),
        'n': case when a.n + length(s.text) // 4 > 256 and len(a.held) > 0 then case when length(a.held[-1]) // 4 > 50 then length(substr(a.held[-1], 1, 200)) // 4 else 0 end else a.n end
            + case when length(s.text) // 4 > 256 then 0 else length(s.text) // 4 end,
        'out': list_concat(a.out, list_concat(case when a.n + length(s.text) // 4 > 256 and len(a.held) > 0 then [{'c': array_to_string(a.held, chr(10) || chr(10)), 't': length(array_to_string(a.held, chr(10) || chr(10))) // 4, 'k': 'paragraph', 'p': 1}] else []::struct(c varchar, t bigint, k varchar, p int)[] end,
            case when length(s.text) // 4 > 256 then list_transform(list_filter(s.parts, lambda p: length(trim(p)) > 0), lambda p: {'c': trim(p, ' ' || chr(9) || chr(13) || chr(10)), 't': length(p) // 4, 'k': 'paragraph', 'p': 1}) else []::struct(c varchar, t bigint, k varchar, p int)[] end)),
        'text': '', 'parts': []::varchar[]}, {'held': []::varchar[], 'n': 0::bigint, 'out': []::struct(c varchar, t bigint, k varchar, p int)[], 'text': '', 'parts': []::varchar[]}) as f from rows),
    chunked as (select document_id, case when len(f.held) > 0 then list_append(f.out, {'c': array_to_string(f.held, chr(10) || chr(10)), 't': length(array_to_string(f.held, chr(10) || chr(10))) // 4, 'k': null, 'p': null}) else f.out end as l from packed)"""
#: Sentences of texts `{source}` (text): pieces of 5 characters or more, those under 10 appended to the one before.
SENTENCES = r"""bits as (select *, list_filter(list_transform(string_split(regexp_replace(text, '([。！？；\n]|[.!?;]\s)\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: length(x) >= 5) as bits from {source}),
    said as (select * exclude (bits), list_reduce(list_transform(bits, lambda x: [x]), lambda a, x: case when length(x[1]) < 10 and len(a) > 0 then list_append(a[:len(a) - 1], a[len(a)] || x[1]) else list_append(a, x[1]) end, []::varchar[]) as said from bits)"""
WIN2 = """up as (select document_id, cast(i as int) as parent_index, substr(text, cast(i * 1950 + 1 as bigint), 2200) as text from (select document_id, text, unnest(range(0, cast(ceil(greatest(length(text) - 2200, 0) / 1950.0) as bigint) + 1)) as i from docs where length(text) > 0)),
low as (select document_id, parent_index, i as k, substr(text, cast(i * 600 + 1 as bigint), 700) as content from (select document_id, parent_index, text, unnest(range(0, cast(ceil(greatest(length(text) - 700, 0) / 600.0) as bigint) + 1)) as i from up)),
subs as (select document_id, parent_index, cast(row_number() over (partition by document_id order by parent_index, k) - 1 as int) as chunk_index, content from low)"""


def lines(t):
    """Paragraphs; the given texts have no blank lines, so a line feed parts them."""
    return chunk.paragraphs(t.docs, "\n")


@query("src02_pseudo_pages", "select document_id, page, md5(array_to_string(l[page * 20 - 19 : page * 20], chr(10))) as text_md5 from (select document_id, l, cast(unnest(range(1, (len(l) - 1) // 20 + 2)) as int) as page from (select document_id, string_split(text, chr(10)) as l from docs))")
def src02(t):
    return chunk.pseudo_pages(t.docs, 20).select("document_id", "page", F.md5("page_text").alias("text_md5"))


@query("src03_gate", "select document_id, replace(replace(original_filename, '/', '_'), chr(92), '_') as safe_name, case when lower(regexp_extract(original_filename, '\\.([^.]+)$', 1)) not in ('pdf', 'docx', 'doc', 'txt', 'md', 'markdown') then 'extension' when file_size > 10000 then 'size' end as reject_reason from docs")
def src03(t):
    return catalog.gate(t.docs, most=10_000).select("document_id", "safe_name", "reject_reason")


@query("src04_raw_documents", "select 'file' as source_type, original_filename as source_identifier, original_filename as display_name, lower(regexp_extract(original_filename, '\\.([^.]+)$', 1)) as file_type, octet_length(encode(text)) as file_size, md5(text) as content_md5 from docs union all select 'web', url, coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), ''), url), 'web', octet_length(encode(html)), md5(html) from pages")
def src04(t):
    web = t.pages.select("url", T.html_title(F.col("html")).alias("title"), F.col("html").alias("text"))
    return catalog.raw_documents(t.docs, web).withColumn("content_md5", F.md5("content")).drop("content")


@query("src05_tables", "select 'docs' as name, count(*) as n from docs union all select 'kbs', count(*) from kbs union all select 'doc_kb', count(*) from doc_kb union all select 'messages', count(*) from messages union all select 'feedback', count(*) from feedback union all select 'outbox', count(*) from outbox union all select 'conversations', count(*) from conversations_v")
def src05(t):
    parts = [getattr(t, v).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, v in (("docs", "docs"), ("kbs", "kbs"), ("doc_kb", "doc_kb"), ("messages", "messages"), ("feedback", "feedback"), ("outbox", "outbox"), ("conversations", "conversations_v"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("src06_upsert", "select vec_id, kb_id, 0 as version from vectors where vec_id % 3 <> 0 union all select vec_id, kb_id, 2 from vectors where vec_id % 3 = 0")
def src06(t):
    old = t.vectors.select("vec_id", "kb_id").withColumn("version", F.lit(0))
    new = old.where("vec_id % 3 = 0")
    both = new.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)))
    return vectors.upsert(old, both, ("kb_id", "vec_id"))


@query("src07_delete", "select vec_id, kb_id from vectors where not (kb_id = 3 and vec_id % 4 = 1)")
def src07(t):
    rows = t.vectors.select("vec_id", "kb_id", (F.col("vec_id") % 4).alias("document_id"))
    gone = rows.where("kb_id = 3 and document_id = 1").select("kb_id", "document_id").distinct()
    return vectors.delete(rows, gone).select("vec_id", "kb_id")


@query("src08_drop_collection", "select vec_id, kb_id from vectors where kb_id <> 5")
def src08(t):
    return t.vectors.where("kb_id <> 5").select("vec_id", "kb_id")


def kept_vectors(t):
    """A store with the vectors as its first version; a vector's document is its id modulo 4."""
    schema = "kb_id int, id long, document_id long, embedding array<float>, version int"
    store = versions.Store(t._spark, streams.folder(t._spark, "vectors"), {"text": schema}).create()
    rows = t.vectors.select("kb_id", F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("document_id"), "embedding", F.lit(0).alias("version"))
    store.publish([store.stage("text", rows, versions.kb_part(8))])
    return store


@query("src06_stored_upsert", "select vec_id, kb_id, case when vec_id % 3 = 0 and kb_id < 5 then 2 else 0 end as version, case when vec_id % 3 = 0 and kb_id < 5 then 1 else len(embedding) end as size from vectors union all select vec_id + 1000000, 3, 1, len(embedding) from vectors where vec_id % 7 = 0")
def src06_stored(t):
    """Vectors put in the place of others, or added, in the stored table; then read back from it."""
    store = kept_vectors(t)
    rows = store.read("text")
    new = rows.where("id % 3 = 0 and kb_id < 5").withColumn("embedding", F.slice("embedding", 1, 1))
    new = new.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)))
    more = rows.where("id % 7 = 0").withColumns({"id": F.col("id") + 1_000_000, "kb_id": F.lit(3), "version": F.lit(1)})
    versions.upsert(store, "text", new.unionByName(more))
    return store.read("text").select(F.col("id").alias("vec_id"), "kb_id", "version", F.size("embedding").alias("size"))


@query("src07_stored_delete", "select vec_id, kb_id from vectors where not (kb_id = 3 and vec_id % 4 = 1) and not (kb_id = 6 and vec_id % 4 = 2)")
def src07_stored(t):
    """The vectors of two documents deleted from the stored table."""
    store = kept_vectors(t)
    gone = store.read("text").where("(kb_id = 3 and document_id = 1) or (kb_id = 6 and document_id = 2)")
    versions.delete_documents(store, ["text"], gone)
    return store.read("text").select(F.col("id").alias("vec_id"), "kb_id")


@query("src08_stored_drop", "select vec_id, kb_id from vectors where kb_id <> 5")
def src08_stored(t):
    """A knowledge base left out of the stored table."""
    store = kept_vectors(t)
    versions.drop_collection(store, ["text"], 5)
    return store.read("text").select(F.col("id").alias("vec_id"), "kb_id")


@query("src09_counts", "select k.kb_id, coalesce(n, 0) as n from kbs k left join (select kb_id, count(*) as n from vectors group by kb_id) v using (kb_id)")
def src09(t):
    return vectors.counts(t.kbs, t.vectors)


@query("chk01_paragraphs", PARA + " select document_id, pos, text from para")
def chk01(t):
    return lines(t)


@query("chk02_03_segments", PARA + """, f as (select *, cast(starts_with(text, 'The') as int) as fence, sum(cast(starts_with(text, 'The') as int)) over (partition by document_id order by pos) as fences from para),
    g as (select *, fences % 2 = 1 or fence = 1 as inside, case when fences % 2 = 1 or fence = 1 then -((fences + 1) // 2) else pos end as key from f),
    s as (select document_id, min(pos) as pos, string_agg(text, chr(10) order by pos) as text, bool_or(inside) as code from g group by document_id, key)
    select document_id, pos, md5(text) as text_md5, case when code then 'code_block' when len(string_split(text, chr(10))) >= 2 and len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) >= 2 then 'table' else 'paragraph' end as type from s""")  # fmt: skip
def chk02(t):
    """Fences stand in as paragraphs that begin with 'The', since no given text has code."""
    rows = lines(t).withColumn("text", F.when(F.startswith("text", F.lit("The")), F.concat(F.lit(chunk.FENCE), "text")).otherwise(F.col("text")))
    return chunk.segments(rows).select("document_id", "pos", F.md5(F.replace("text", F.lit(chunk.FENCE), F.lit(""))).alias("text_md5"), "type")


@query("chk04_pages", PARA + ", pg as (select document_id, page, array_to_string(l[page * 20 - 19 : page * 20], chr(10)) as page_text from (select document_id, l, cast(unnest(range(1, (len(l) - 1) // 20 + 2)) as int) as page from (select document_id, string_split(text, chr(10)) as l from docs))) select p.document_id, pos, min(page) as page from para p left join pg on pg.document_id = p.document_id and contains(page_text, substr(text, 1, 100)) group by p.document_id, pos")
def chk04(t):
    return chunk.attach_pages(lines(t), chunk.pseudo_pages(t.docs, 20)).select("document_id", "pos", "page")


@query("chk05_06_tokens", "select document_id, cast(length(text) // 4 as int) as tokens, substr(text, 1, 400) as head from docs")
def chk05(t):
    return t.docs.select("document_id", T.token_count(F.col("text")).alias("tokens"), T.token_truncate(F.col("text"), 100).alias("head"))


@query("chk07_split_long", LONG.format(source="docs", most=256) + " select document_id, cast(i - 1 as int) as pos, md5(parts[i]) as part_md5 from (select document_id, parts, unnest(range(1, len(parts) + 1)) as i from long)")
def chk07(t):
    return t.docs.select("document_id", F.posexplode(chunk.split_long(F.col("text"), 256)).alias("pos", "part")).select("document_id", "pos", F.md5("part").alias("part_md5"))


@query("chk08_10_pack", PARA + ", " + LONG.format(source="para", most=256) + ", " + PACK + """ select document_id, cast(i - 1 as int) as chunk_index, md5(l[i].c) as content_md5, cast(l[i].t as int) as token_count, l[i].k as type, l[i].p as page
    from (select document_id, l, unnest(range(1, len(l) + 1)) as i from chunked)""")  # fmt: skip
def chk08(t):
    return packed(t).select("document_id", "chunk_index", F.md5("content").alias("content_md5"), "token_count", "type", "page")


def packed(t):
    return chunk.pack(chunk.segments(lines(t)).withColumn("page", F.lit(1)))


@query("chk11_parents", WIN2 + """ select document_id, cast(chunk_index // 4 as int) as parent_index, md5(substr(string_agg(content, chr(10) || chr(10) order by chunk_index), 1, 4096)) as content_md5, cast(least(length(string_agg(content, chr(10) || chr(10) order by chunk_index)) // 4, 1024) as int) as token_count, count(*) as sub_count
    from subs group by document_id, chunk_index // 4""")  # fmt: skip
def chk11(t):
    subs = chunk.two_level_windows(t.docs).withColumn("page", F.lit(1))
    return chunk.parents(subs).select("document_id", "parent_index", F.md5("content").alias("content_md5"), "token_count", "sub_count")


@query("chk12_by_boundaries", PARA + """, k as (select *, case when pos % 3 = 0 then 'table' else 'paragraph' end as type, pos // 5 as group_id from para), c as (select document_id, group_id, type, row_number() over (partition by document_id, group_id order by count(*) desc, type) as r from k group by document_id, group_id, type)
    select k.document_id, cast(k.group_id as int) as group_id, md5(string_agg(text, chr(10) || chr(10) order by pos)) as content_md5, any_value(c.type) as type from k join c on c.document_id = k.document_id and c.group_id = k.group_id and r = 1 group by k.document_id, k.group_id""")  # fmt: skip
def chk12(t):
    rows = lines(t).withColumn("type", F.when(F.col("pos") % 3 == 0, "table").otherwise("paragraph")).withColumn("page", F.lit(1))
    bounds = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos") % 5 == 4, F.col("pos")))).alias("boundaries"))
    return chunk.by_boundaries(rows, bounds).select("document_id", "group_id", F.md5("content").alias("content_md5"), "type")


@query("chk13_parse_boundaries", "select document_id, array_to_string(list_sort(list_distinct(list_filter([b1, b2], lambda x: x <= 38))), ',') as boundaries from (select document_id, document_id % 45 as b1, document_id % 7 as b2 from docs)")
def chk13(t):
    raw = F.concat(F.lit("cut at ["), (F.col("document_id") % 45).cast("string"), F.lit(", "), (F.col("document_id") % 7).cast("string"), F.lit("]"))
    replies = t.docs.select("document_id", F.lit(0).alias("batch_offset"), F.lit(40).alias("batch_len"), raw.alias("raw"))
    return chunk.boundary_indices(replies).select("document_id", F.array_join("boundaries", ",").alias("boundaries"))


@query("chk14_windows", WIN2 + " select document_id, parent_index, chunk_index, md5(content) as content_md5, cast(length(content) // 4 as int) as token_count from subs")
def chk14(t):
    return chunk.two_level_windows(t.docs).select("document_id", "parent_index", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


@query("chk15_sentences", SENTENCES.format(source="docs") + " select document_id, cast(i - 1 as int) as pos, md5(said[i]) as sentence_md5 from (select document_id, said, unnest(range(1, len(said) + 1)) as i from said)")
def chk15(t):
    return t.docs.select("document_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("document_id", "pos", F.md5("sentence").alias("sentence_md5"))


@query("chk16_ids", "select 'chunk_' || document_id || '_0' as chunk_id, 'image_' || document_id || '_0' as image_id, 'doc-' || document_id || '-0' as vector_id from docs")
def chk16(t):
    name = lambda kind, sep: F.concat_ws(sep, F.lit(kind), "document_id", F.lit("0"))
    return t.docs.select(name("chunk", "_").alias("chunk_id"), name("image", "_").alias("image_id"), name("doc", "-").alias("vector_id"))


@query("chk17_previews", "select document_id, md5(case when length(text) > 500 then substr(text, 1, 250) || chr(10) || '...' || chr(10) || right(text, 250) else text end) as middle_md5, md5(case when length(text) > 1500 then substr(text, 1, 1500) || '...' else text end) as head_md5, '[' || document_id || '] ' || replace(substr(text, 1, 400), chr(10), ' ') as line from docs")
def chk17(t):
    text = F.col("text")
    line = F.concat(F.lit("["), F.col("document_id").cast("string"), F.lit("] "), F.replace(F.substring(text, 1, 400), F.lit("\n"), F.lit(" ")))
    return t.docs.select("document_id", F.md5(T.clip_middle(text, 500, 250)).alias("middle_md5"), F.md5(T.clip(text, 1500, "...")).alias("head_md5"), line.alias("line"))


# ---- files --------------------------------------------------------------------------------------------------------------


@query("src01_text_files", r"select lang, 'TXT' as format, cast(sum(1 + length(text) - length(replace(text, chr(10), ''))) as bigint) as lines, cast(sum(1 + octet_length(encode(text))) as bigint) as bytes from documents group by lang")
def src01(t):
    """Texts written as files of 1,000 documents at most and read back whole; a file's last line feed opens no line here."""
    at = streams.folder(t._spark, "texts")
    t.documents.select("lang", F.col("text").alias("value")).write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(at)
    rows = files.text_files(t._spark, f"{at}/lang=*")
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1)
    return rows.groupBy(lang.alias("lang"), "format").agg(F.sum(F.col("line_count") - 1).alias("lines"), F.sum("file_size").alias("bytes"))


@query("src10_datasets", "select 'kb_' || kb_id || '_20240101' as name, count(*) as pair_count from docs where kb_id is not null group by kb_id")
def src10(t):
    """A dataset of question and answer for every knowledge base, saved as JSON and listed."""
    at = streams.folder(t._spark, "datasets")
    pairs = t.docs.where("kb_id is not null").select(
        "kb_id", F.substring("text", 1, 60).alias("question"), F.substring("text", 61, 200).alias("answer"), F.col("document_id").alias("source_document_id"),
        F.lit(0).alias("source_chunk_index"), F.col("original_filename").alias("source_filename"))
    files.save_datasets(pairs, at, "20240101")
    return files.list_datasets(t._spark, at).select("name", "pair_count")
