"""Queries of tags, catalog, conversations, feedback and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bm25, catalog, feedback, jobs, tags
from .base import TERMS, query

# ---- tags ---------------------------------------------------------------------------------------------------------------


@query("tag01_content_sample", "select doc_id, md5(case when length(text) >= 50 then substr(text, 1, 1500) || case when length(text) > 3000 then chr(10) || chr(10) || '---' || chr(10) || chr(10) || substr(text, cast(length(text) // 2 + 1 as bigint), 1500) else '' end || case when length(text) > 6000 then chr(10) || chr(10) || '---' || chr(10) || chr(10) || substr(text, cast(length(text) * 2 // 3 + 1 as bigint), 1000) else '' end end) as sample_md5 from documents")
def tag01(t):
    return t.documents.select("doc_id", F.md5(tags.content_sample(F.col("text"))).alias("sample_md5"))


GOOD = "good as (select doc_id, list_filter(" + TERMS + ", lambda x: lower(x) not in (" + ", ".join(f"'{w}'" for w in tags.BANNED) + ") and length(x) > 1 and not regexp_matches(x, '^[0-9]+$')) as l from documents)"


@query("tag03_quality_filter", GOOD + " select doc_id, array_to_string(list_slice(list_filter(list_transform(range(1, len(l) + 1), lambda i: case when list_position(l, l[i]) = i then l[i] end), lambda x: x is not null), 1, 5), '|') as tags from good")
def tag03(t):
    from ..functions.text import terms

    return t.documents.select("doc_id", F.array_join(tags.quality_filter(terms(F.col("text"))), "|").alias("tags"))


MERGED = "old as (select document_id, name, source from doc_tags where source = 'manual'), new as (select document_id, case when document_id % 3 = 0 then lang else 'topic' || document_id % 7 end as name from docs)"


@query("tag04_merge_auto", MERGED + ", u as (select document_id, name, source from old union all select n.document_id, n.name, 'auto' from new n where not exists (select 1 from old o where o.document_id = n.document_id and o.name = n.name)) select document_id, string_agg(source || ':' || name, ',' order by case source when 'manual' then 0 else 1 end, name) as tags from u group by document_id")
def tag04(t):
    new = t.docs.select("document_id", F.array(F.when(F.col("document_id") % 3 == 0, F.col("lang")).otherwise(F.concat(F.lit("topic"), (F.col("document_id") % 7).cast("string")))).alias("names"))
    return flat(new.join(tags.gathered(t.doc_tags), "document_id").select("document_id", tags.merge_auto(F.col("tags"), F.col("names")).alias("tags")))


def flat(df):
    return df.select("document_id", F.array_join(F.transform("tags", lambda x: F.concat(x["source"], F.lit(":"), x["name"])), ",").alias("tags"))


BASE = "base as (select document_id, list({'s': source, 'n': name} order by name, source) as l from doc_tags group by document_id)"


@query("tag05_add_manual", BASE + " select document_id, array_to_string(list_transform(case when len(list_filter(l, lambda x: x.n = 'tag' || document_id % 3)) > 0 or document_id % 5 = 0 then l else list_append(l, {'s': 'manual', 'n': 'tag' || document_id % 3}) end, lambda x: x.s || ':' || x.n), ',') as tags from base")
def tag05(t):
    name = F.when(F.col("document_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" tag"), (F.col("document_id") % 3).cast("string")))
    return flat(tags.gathered(t.doc_tags).select("document_id", tags.add_manual(F.col("tags"), name).alias("tags")))


@query("tag06_remove", BASE + " select document_id, nullif(array_to_string(list_transform(list_filter(l, lambda x: x.n <> 'en'), lambda x: x.s || ':' || x.n), ','), '') as tags, len(list_filter(l, lambda x: x.n = 'en')) > 0 as removed from base")
def tag06(t):
    g = tags.gathered(t.doc_tags).select("document_id", tags.remove(F.col("tags"), F.lit("en")).alias("tags"), F.exists("tags", lambda x: x["name"] == "en").alias("removed"))
    return flat(g).join(g.select("document_id", "removed"), "document_id")


@query("tag07_usage", "select name, count(*) as n, string_agg(distinct source, ',' order by source) as sources from doc_tags group by name")
def tag07(t):
    return tags.usage(t.doc_tags)


@query("tag08_having_all", "select document_id from doc_tags where name in ('en', 'quality') group by document_id having count(distinct name) = 2")
def tag08(t):
    return tags.having_all(t.doc_tags, ["en", "quality"])


@query("tag09_normalise", "select doc_id, case when doc_id % 3 = 0 then 'manual:' || lang when doc_id % 3 = 1 then 'auto:' || lang || ',manual:plain' else 'manual:' || lang || ',manual:plain' end as tags from documents")
def tag09(t):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('["'), "lang", F.lit('"]'))).when(k == 1, F.concat(F.lit('[{"name":"'), "lang", F.lit('","source":"auto"},"plain"]'))).otherwise(F.concat(F.lit('[{"name":"'), "lang", F.lit('"},"plain"]')))
    return t.documents.select("doc_id", F.array_join(F.transform(tags.normalise(raw), lambda x: F.concat(x["source"], F.lit(":"), x["name"])), ",").alias("tags"))


@query("tag10_keywords", """w as (select doc_id, unnest(""" + TERMS + r""") as term from documents), p as (select doc_id, term, count(*) as tf from w group by all),
    d as (select term, count(*) as df from p group by term), n as (select count(*) as n from documents),
    s as (select doc_id, term, round(tf * ln((n - df + 0.5) / (df + 0.5) + 1), 6) as s from p join d using (term), n where length(term) > 1 and not regexp_matches(term, '^[0-9]+$') and lower(term) not in ('document', 'report', 'guide', 'tutorial', 'introduction', 'technology', 'software', 'programming', 'development'))
    select doc_id as chunk_id, row_number() over (partition by doc_id order by s desc, term) as pos, term from s qualify pos <= 5""")  # fmt: skip
def tag10(t):
    rows = t.documents.select(F.lit(0).alias("kb_id"), F.col("doc_id").alias("chunk_id"), "text")
    post = bm25.postings(rows)
    return tags.keywords(post, bm25.term_stats(post, bm25.stats(rows))).select("chunk_id", "pos", "term")


# ---- catalog ------------------------------------------------------------------------------------------------------------


@query("rel01_list_documents", "select document_id, original_filename from docs where user_id = 2 and document_id in (select document_id from doc_kb where kb_id = 7) and document_id in (select document_id from doc_tags where name = 'en')")
def rel01(t):
    return catalog.list_documents(t.docs, 2, t.doc_kb, 7, tags.having_all(t.doc_tags, ["en"])).select("document_id", "original_filename")


@query("rel02_membership", "select document_id, kb_id from docs where kb_id is not null union select document_id, kb_id from doc_kb")
def rel02(t):
    return catalog.membership(t.docs, t.doc_kb)


@query("rel03_not_in_kb", "select document_id from docs where user_id = 1 and status = 'completed' and document_id not in (select document_id from doc_kb where kb_id = 6)")
def rel03(t):
    return catalog.not_in_kb(t.docs, t.doc_kb, 1, 6).select("document_id")


@query("rel04_link_counts", "select 'doc' as kind, d.document_id as id, count(k.kb_id) as n from docs d left join doc_kb k on k.document_id = d.document_id group by d.document_id union all select 'kb', b.kb_id, count(k.document_id) from kbs b left join doc_kb k on k.kb_id = b.kb_id group by b.kb_id")
def rel04(t):
    d, k = catalog.count_links(t.docs, t.kbs, t.doc_kb)
    return d.select(F.lit("doc").alias("kind"), F.col("document_id").alias("id"), "n").unionByName(k.select(F.lit("kb").alias("kind"), F.col("kb_id").cast("long").alias("id"), "n"))


@query("rel05_list_kbs", "select kb_id, trim('  ' || name || ' ') as name from kbs where user_id = 3")
def rel05(t):
    return t.kbs.where("user_id = 3").select("kb_id", F.trim(F.concat(F.lit("  "), "name", F.lit(" "))).alias("name")).orderBy(F.desc("kb_id"))


@query("rel06_delete_documents", "select 'docs' as name, count(*) as n from docs where document_id % 10 <> 3 union all select 'doc_kb', count(*) from doc_kb where document_id % 10 <> 3 union all select 'doc_tags', count(*) from doc_tags where document_id % 10 <> 3")
def rel06(t):
    gone = t.docs.where("document_id % 10 = 3").select("document_id")
    left = catalog.delete_documents(gone, docs=t.docs, doc_kb=t.doc_kb, doc_tags=t.doc_tags)
    return union([df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in left.items()])


def union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("rel07_delete_kb", "select 'docs' as name, count(*) as n, count(case when kb_id = 4 then null else kb_id end) as linked from docs union all select 'conversations', count(*), count(case when kb_id = 4 then null else kb_id end) from conversations_v union all select 'doc_kb', count(*), count(*) from doc_kb where kb_id <> 4 union all select 'kbs', count(*), count(*) from kbs where kb_id <> 4")
def rel07(t):
    left = catalog.delete_kb(t.kbs.where("kb_id = 4"), t.docs, t.conversations_v, t.doc_kb, t.kbs)
    return union([df.agg(F.count("*").alias("n"), F.count("kb_id").alias("linked")).select(F.lit(k).alias("name"), "n", "linked") for k, df in left.items()])


@query("rel08_link", "select document_id, kb_id from doc_kb union select document_id, 9 from docs where document_id % 6 = 0")
def rel08(t):
    return catalog.link(t.doc_kb, t.docs.where("document_id % 6 = 0").select("document_id", F.lit(9).alias("kb_id")))


RELINK = """new_kb as (select document_id, kb_id from doc_kb where not (kb_id = 7 and document_id % 2 = 0) union select document_id, 9 from docs where document_id % 6 = 0),
    members as (select document_id, kb_id from new_kb union select document_id, kb_id from docs where kb_id is not null),
    diff as (select distinct kb_id from ((select * from doc_kb except select * from new_kb) union all (select * from new_kb except select * from doc_kb))),
    words as (select kb_id, document_id, unnest(""" + TERMS + """) as term from members join (select document_id, text from docs) using (document_id) where kb_id in (select kb_id from diff))"""


@query("rel08_relink_rebuild", RELINK + " select kb_id, term, count(distinct document_id) as df, count(*) as tf from words group by all")
def rel08_rebuild(t):
    """Documents linked to one knowledge base and unlinked from another; the terms of the touched ones are counted again."""
    gone = t.doc_kb.where("kb_id = 7 and document_id % 2 = 0")
    new = t.docs.where("document_id % 6 = 0").select("document_id", F.lit(9).alias("kb_id"))
    after = catalog.link(catalog.unlink(t.doc_kb, gone), new)
    members = catalog.membership(t.docs.select("document_id", F.col("kb_id")), after).join(catalog.touched(t.doc_kb, after), "kb_id", "left_semi")
    rows = members.join(t.docs.select("document_id", "text"), "document_id").select("kb_id", F.col("document_id").alias("chunk_id"), "text")
    return bm25.postings(rows).groupBy("kb_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("rel09_page", "select document_id, row_number() over (order by document_id desc) as nth, (select count(*) from docs where user_id = 2) as total, cast(ceil((select count(*) from docs where user_id = 2) / 15.0) as bigint) as total_pages from docs where user_id = 2 order by document_id desc limit 15 offset 15")
def rel09(t):
    return catalog.page_of(t.docs.where("user_id = 2"), 2, 15).select("document_id", "nth", "total", "total_pages")


@query("rel10_progress", "select document_id, case status when 'completed' then 100 when 'parsing' then 20 else 0 end as progress from docs")
def rel10(t):
    return t.docs.select("document_id", catalog.progress(F.col("status")).alias("progress"))


@query("rel11_import_summary", "select lang, count(*) filter (status = 'completed') as ok, count(*) filter (status = 'parsing') as duplicate, count(*) filter (status = 'failed') as error from docs group by lang")
def rel11(t):
    return t.docs.groupBy("lang").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("completed", "ok"), ("parsing", "duplicate"), ("failed", "error"))])


@query("rel12_lookup", "select document_id, original_filename from docs where document_id in (select document_id from doc_kb where kb_id = 3) and user_id = 0")
def rel12(t):
    return t.docs.join(t.doc_kb.where("kb_id = 3").select("document_id"), "document_id", "left_semi").where("user_id = 0").select("document_id", "original_filename")


@query("rel13_upload_dedup", "select distinct lang, n_chars from documents")
def rel13(t):
    return t.documents.dropDuplicates(["lang", "n_chars"]).select("lang", "n_chars")


@query("rel14_conversations", "select m.conv_id, message_id, row_number() over (partition by m.conv_id order by turn, message_id) as pos from messages m join conversations_v c on c.conv_id = m.conv_id and c.user_id = 3")
def rel14(t):
    mine = t.conversations_v.where("user_id = 3").select("conv_id")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "message_id"))
    return t.messages.join(mine, "conv_id", "left_semi").select("conv_id", "message_id", pos.alias("pos"))


@query("rel15_titles", "f as (select conv_id, arg_min(content, turn) as f from messages where role = 'user' group by conv_id) select c.conv_id, case when length(f) > 50 then substr(f, 1, 50) || '...' else coalesce(f, 'Conversation ' || c.conv_id) end as title, case when kb_id is not null then 'rag' else 'chat' end as mode from conversations_v c left join f on f.conv_id = c.conv_id")
def rel15(t):
    return catalog.conversation_titles(t.messages, t.conversations_v)


@query("rel16_delete_conversation", "select 'conversations' as name, count(*) as n, max(conv_id) as newest from conversations_v where conv_id % 9 <> 2 union all select 'messages', count(*), max(conv_id) from messages where conv_id % 9 <> 2 union all select 'feedback', count(*), max(message_id // 1000) from feedback f where message_id in (select message_id from messages where conv_id % 9 <> 2)")
def rel16(t):
    gone = t.conversations_v.where("conv_id % 9 = 2").select("conv_id")
    left = t.messages.join(gone, "conv_id", "left_anti")
    marks = t.feedback.join(left.select("message_id"), "message_id", "left_semi").withColumn("conv_id", F.floor(F.col("message_id") / 1000))
    parts = {"conversations": t.conversations_v.join(gone, "conv_id", "left_anti"), "messages": left, "feedback": marks}
    return union([df.agg(F.count("*").alias("n"), F.max("conv_id").cast("long").alias("newest")).select(F.lit(k).alias("name"), "n", "newest") for k, df in parts.items()])


# ---- feedback -----------------------------------------------------------------------------------------------------------


@query("fbk01_upsert", "select message_id, user_id, arg_max(rating, (ts, event_id)) as rating, arg_max(feedback_type, (ts, event_id)) as feedback_type, coalesce(arg_max(comment, (ts, event_id)) filter (comment <> ''), '') as comment from feedback group by message_id, user_id")
def fbk01(t):
    return feedback.upsert(t.feedback)


STATS = "count(*) as total, count(*) filter (rating > 0) as positive, count(*) filter (rating < 0) as negative, count(*) filter (rating = 0) as neutral, coalesce(round(avg(rating), 3), 0) as avg_rating, coalesce(round(count(*) filter (rating > 0) / nullif(count(*), 0), 3), 0) as positive_rate"


@query("fbk02_stats", f"select {STATS} from feedback where ts >= timestamp '2024-01-20'")
def fbk02(t):
    return feedback.stats(t.feedback, "2024-01-20 00:00:00")


@query("fbk03_by_type", "select coalesce(nullif(feedback_type, ''), 'unknown') as feedback_type, count(*) as n from feedback group by 1")
def fbk03(t):
    return feedback.by_type(t.feedback)


@query("fbk04_by_kb", f"select kb_id, {STATS} from feedback f join messages m using (message_id) join conversations_v c on c.conv_id = m.conv_id where f.ts >= timestamp '2024-01-10' group by kb_id")
def fbk04(t):
    return feedback.stats(feedback.of_kb(t.feedback, t.messages, t.conversations_v), "2024-01-10 00:00:00", "kb_id")


@query("fbk05_current", "select m.message_id, coalesce(r, 0) as rating from messages m left join (select message_id, arg_max(rating, (ts, event_id)) as r from feedback where user_id = 7 group by message_id) f using (message_id)")
def fbk05(t):
    return feedback.current(t.messages, feedback.upsert(t.feedback), 7)


# ---- jobs ---------------------------------------------------------------------------------------------------------------

CLAIM = """claimed as (select id, attempts from outbox where next_attempt_at <= timestamp '2024-01-15' and (status = 'PENDING' or (status = 'PROCESSING' and locked_until < timestamp '2024-01-15')) order by created_at, id limit 50)"""
NOW = "2024-01-15 00:00:00"


@query("str03_claim", CLAIM + " select id, attempts, 'PROCESSING' as status from claimed")
def str03(t):
    return jobs.claim(t.outbox, NOW).select("id", "attempts", "status")


@query("str04_reschedule", CLAIM + " select id, case when id % 3 <> 0 then 'PUBLISHED' when attempts + 1 >= 10 then 'DEAD' else 'PENDING' end as status, case when id % 3 = 0 then attempts + 1 else attempts end as attempts, case when id % 3 = 0 and attempts + 1 < 10 then cast(least(300, pow(2, least(attempts + 1, 8))) as int) end as delay_s from claimed")
def str04(t):
    claimed = jobs.claim(t.outbox, NOW)
    return jobs.reschedule(claimed, claimed.where("id % 3 = 0"), NOW).select("id", "status", "attempts", "delay_s")


STREAM = "e as (select event_id // 20 as request_id, event_id as seq, case when event_type = 'error' then 'error' when event_type = 'signup' then 'sources' else 'token' end as type, case when event_type = 'signup' then 's' || event_id else event_type || ' ' end as payload from events)"


@query("str05_assemble", STREAM + ", s as (select *, min(seq) filter (type = 'error') over (partition by request_id) as stop from e) select request_id, coalesce(string_agg(payload, '' order by seq) filter (type = 'token' and (stop is null or seq < stop)), '') as text, arg_max(payload, seq) filter (type = 'sources' and (stop is null or seq < stop)) as sources, bool_or(type = 'error') as failed from s group by request_id")
def str05(t):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "sources").otherwise("token")
    load = F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), F.col("event_id").cast("string"))).otherwise(F.concat("event_type", F.lit(" ")))
    return jobs.assemble_stream(t.events.select(F.floor(F.col("event_id") / 20).cast("long").alias("request_id"), F.col("event_id").alias("seq"), kind.alias("type"), load.alias("payload")))


@query("str06_sse", "e as (select event_id // 20 as request_id, event_id as seq, event_type, min(event_id) filter (event_id % 17 = 0) over (partition by event_id // 20) as stop from events) select request_id, coalesce(string_agg(event_type, '' order by seq) filter (seq % 7 not in (5, 6) and (stop is null or seq < stop)), '') as text from e where seq % 17 = 0 or seq % 7 <> 6 group by request_id")
def str06(t):
    """Log lines written from events in three vendor shapes, some not JSON, some without the prefix, some ending the stream."""
    k, e = F.col("event_id") % 7, F.col("event_type")
    line = F.when(F.col("event_id") % 17 == 0, F.lit("data: [DONE]")).when(k.isin(0, 1), F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), e, F.lit('"}}]}'))).when(k.isin(2, 3), F.concat(F.lit('data: {"output":{"text":"'), e, F.lit('"}}'))).when(k == 4, F.concat(F.lit('data: {"text":"'), e, F.lit('"}'))).when(k == 5, F.lit("data: {broken")).otherwise(F.lit("event: ping"))
    return jobs.parse_sse(t.events.select(F.floor(F.col("event_id") / 20).cast("long").alias("request_id"), F.col("event_id").alias("seq"), line.alias("line")))


@query("str07_response_text", "select event_id, event_type as text from events")
def str07(t):
    k, e = F.col("event_id") % 3, F.col("event_type")
    raw = F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), e, F.lit('"}}]}'))).when(k == 1, F.concat(F.lit('{"output":{"text":"'), e, F.lit('"}}'))).otherwise(F.concat(F.lit('{"text":"'), e, F.lit('"}')))
    return t.events.select("event_id", raw.alias("raw")).select("event_id", jobs.response_text("raw").alias("text"))


@query("str08_rate_audit", "select user_id, time_bucket(interval '1 hour', ts) as start, count(*) as n, count(*) > 2 as over from call_log group by all".replace(" as over", ' as "over"'))
def str08(t):
    return jobs.rate_audit(t.call_log.withColumn("ts", F.col("ts").cast("timestamp")), 2, "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str09_failure_audit", "select event_id, user_id, round(avg(failed) over w, 4) as failure_rate, count(*) over w >= 10 and avg(failed) over w >= 0.5 as open from call_log window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)")
def str09(t):
    return jobs.failure_audit(t.call_log)


@query("str10_daily_feedback", f"select cast(ts as date) as day, {STATS} from feedback where ts >= timestamp '2024-01-01' group by 1")
def str10(t):
    return feedback.stats(t.feedback.withColumn("day", F.to_date("ts")), "2024-01-01 00:00:00", "day")
