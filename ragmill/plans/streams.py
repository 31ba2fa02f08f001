"""Queries that run the streams over the given tables; their SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest, streams, timed
from .base import query


def events(t):
    return streams.source(t._spark, t._dir, "events")


@query("str01_ingest_stream", "up as (select document_id, cast(i as int) as parent_index, substr(text, cast(i * 1950 + 1 as bigint), 2200) as text from (select doc_id as document_id, text, unnest(range(0, cast(ceil(greatest(length(text) - 2200, 0) / 1950.0) as bigint) + 1)) as i from documents where length(text) > 0)) select document_id, sum(cast(ceil(greatest(length(text) - 700, 0) / 600.0) as bigint) + 1) as chunks from up group by document_id")
def str01(t):
    return ingested(t).read("chunks").groupBy("document_id").agg(F.count("*").alias("chunks"))


def ingested(t, file_type="txt", kb_id=None):
    """The store after the documents' files have been streamed into it."""
    docs = streams.source(t._spark, t._dir, "documents")
    kind = F.lit(file_type) if isinstance(file_type, str) else file_type
    docs = docs.select(F.col("doc_id").alias("document_id"), (F.lit(None).cast("int") if kb_id is None else kb_id).alias("kb_id"), kind.alias("file_type"), "text")
    root = streams.folder(t._spark, "ingest")
    store = ingest.open_store(t._spark, f"{root}/store")
    ingest.ingest(docs, store, f"{root}/state")
    return store


@query("str01_ingest_states", """up as (select document_id, text, kb, ok, cast(i as int) as parent_index, substr(text, cast(i * 1950 + 1 as bigint), 2200) as part from (select *, unnest(range(0, cast(ceil(greatest(length(text) - 2200, 0) / 1950.0) as bigint) + 1)) as i
    from (select doc_id as document_id, text, cast(substr(source, 4) as int) as kb, doc_id % 5 <> 2 and length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 as ok from documents) d)),
    n as (select document_id, sum(cast(ceil(greatest(length(part) - 700, 0) / 600.0) as bigint) + 1) as n from up where ok and length(text) > 0 group by document_id)
    select d.doc_id as document_id, case when n is null then 'uploading,parsing,failed' else 'uploading,parsing,chunking,embedding,completed' end as states, cast(coalesce(n, 0) as bigint) as chunks, cast(coalesce(n, 0) as bigint) as vectors,
    case when doc_id % 5 = 2 then 'unsupported type' when n is null then 'no extractable text' end as message from documents d left join n on n.document_id = d.doc_id""")
def str01_states(t):
    """Every document's states, chunks and vectors, as the stream has left them in the store's three tables."""
    kind = F.when(F.col("doc_id") % 5 == 2, "exe").otherwise("txt")
    store = ingested(t, kind, F.substring("source", 4, 9).cast("int"))
    count = lambda name: store.read(name).groupBy("document_id").agg(F.count("*").alias(name))
    history = store.read("states").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "status"))), lambda s: s["status"]), ",").alias("states"), F.max("message").alias("message"))
    out = history.join(count("chunks"), "document_id", "left").join(count("vectors"), "document_id", "left")
    return out.select("document_id", "states", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors"), "message")


@query("str02_redelivery", "select event_id from events")
def str02(t):
    """Every event delivered twice; one of each comes out."""
    e = events(t)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return streams.drain(streams.redelivered(twice, ["event_id"], "60 days").select("event_id"))


@query("str08_rate_stream", "select user_id, time_bucket(interval '1 hour', ts) as start, count(*) as n, count(*) > 2 as \"over\" from events group by all")
def str08(t):
    out = streams.drain(streams.rate_audit(events(t).select("user_id", "ts"), 2, "1 hour", "60 days"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str09_failure_stream", "l as (select user_id, failed, row_number() over (partition by user_id order by ts desc, event_id desc) as r from call_log) select user_id, cast(count(*) as int) as n, cast(sum(failed) as int) as failures, count(*) >= 10 and sum(failed) / 10.0 >= 0.5 as open from l where r <= 10 group by user_id")
def str09(t):
    calls = events(t).select("event_id", "ts", "user_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failed"))
    return streams.drain(streams.failure_stream(calls), "update", ("user_id",))


@query("str10_feedback_stream", "select cast(date_trunc('day', ts) as timestamp) as start, count(*) as total, count(*) filter (rating > 0) as positive, count(*) filter (rating < 0) as negative from feedback group by 1")
def str10(t):
    rating = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    out = streams.drain(streams.daily_feedback(events(t).select("ts", rating.alias("rating"))), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


LATE = """arrived as (select *, case when event_id % 10 = 0 then least(2, cast(datediff('day', timestamp '2024-01-01', ts) // 10 as int) + 1) when event_id % 97 = 1 then 2 else least(2, cast(datediff('day', timestamp '2024-01-01', ts) // 10 as int)) end as step from feedback),
    passed as (select step, (select max(ts) from arrived b where b.step < s.step) - interval 1 day as mark from (select distinct step from arrived) s),"""


def arrival(ts, i):
    """Which of three runs an event arrives in: its ten days', a run later for each tenth, the last for a few of any time."""
    own = F.least(F.lit(2), F.floor(F.datediff(ts, F.lit("2024-01-01")) / 10))
    return F.when(i % 10 == 0, F.least(F.lit(2), own + 1)).when(i % 97 == 1, 2).otherwise(own)


def late_feedback(t, window, slide=None):
    e = t.feedback.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "rating")
    flow = lambda df: streams.daily_feedback(df, "1 day", window, slide)
    out = streams.replayed(e, arrival(F.col("ts"), F.col("event_id")), 3, flow, "update", ("start",))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str10_late_feedback", LATE + """
    kept as (select date_trunc('day', ts) as start, rating from arrived join passed using (step) where mark is null or date_trunc('day', ts) + interval 1 day > mark)
    select cast(start as timestamp) as start, count(*) as total, count(*) filter (rating > 0) as positive, count(*) filter (rating < 0) as negative from kept group by 1""")
def str10_late(t):
    """Feedback by day where a part of it arrives late: days that the watermark has passed take no more."""
    return late_feedback(t, "1 day")


@query("str10_sliding_feedback", LATE + """
    slides as (select date_trunc('day', ts) - to_days(cast(k as int)) as start, rating, step from arrived, (select unnest(range(0, 7)) as k)),
    kept as (select start, rating from slides join passed using (step) where mark is null or start + interval 7 day > mark)
    select cast(start as timestamp) as start, count(*) as total, count(*) filter (rating > 0) as positive, count(*) filter (rating < 0) as negative from kept group by 1""")
def str10_sliding(t):
    """The same for the seven days from each day."""
    return late_feedback(t, "7 days", "1 day")


def clock_of(rows, columns):
    """A row without ids, three hours after the last."""
    end = rows.agg((F.max("ts") + F.expr("interval 3 hours")).alias("ts"))
    return end.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c != "ts" else F.col("ts") for c in columns])


@query("str03_job_stream", """r as (select event_id as id, event_id % 4 as c from events),
    m as (select id, unnest(case c when 0 then ['0 PROCESSING', '60 PUBLISHED'] when 1 then ['0 PROCESSING', '60 PENDING', '62 PROCESSING', '120 PUBLISHED']
    when 2 then ['0 PROCESSING', '301 PROCESSING', '602 PROCESSING', '700 PUBLISHED'] else ['0 PROCESSING', '60 PENDING', '62 PROCESSING', '100 PENDING', '104 PROCESSING', '200 DEAD'] end) as x from r)
    select id, split_part(x, ' ', 2) as status, epoch(date_trunc('second', ts) + case when ts > date_trunc('second', ts) then interval 1 second else interval 0 second end) * 1000 + cast(split_part(x, ' ', 1) as bigint) * 1000 as at_ms from m join events e on e.event_id = m.id""")
def str03_jobs(t):
    """Jobs of all events in sixteen queues: sent, failed and sent, sent after two leases ran out, or failed until dead."""
    start = F.timestamp_seconds(F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    e = t.events.select(F.pmod("event_id", F.lit(16)).cast("int").alias("queue"), F.col("event_id").alias("id"), start.alias("ts"))
    plans = {0: [(60, "sent")], 1: [(60, "failed"), (120, "sent")], 2: [(700, "sent")], 3: [(60, "failed"), (100, "failed"), (200, "failed")]}
    pick = None
    for k, results in plans.items():
        rows = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(kind).alias("kind")) for s, kind in [(0, "added"), *results]])
        pick = F.when(F.col("id") % 4 == k, rows) if pick is None else pick.when(F.col("id") % 4 == k, rows)
    rows = e.select("queue", "id", "ts", F.explode(pick).alias("r")).select("queue", "id", "r.kind", F.timestamp_seconds(F.unix_seconds("ts") + F.col("r.s")).alias("ts"))
    rows = rows.unionByName(clock_of(rows, rows.columns))
    step = F.least(F.lit(2), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10))
    with timed.rocks(t._spark):
        out = streams.replayed(rows, step, 3, lambda df: timed.job_moves(df, limit=1_000_000, most=3))
    return out.select("id", "status", F.unix_millis("at").alias("at_ms"))


@query("str05_token_stream", """e as (select event_id // 20 as request_id, event_id % 20 as seq, case when event_type = 'error' then 'error' when event_type = 'signup' then 'sources' else 'token' end as type,
    case when event_type = 'signup' then 's' || event_id else event_type || ' ' end as payload from events where event_id % 1000 <> 25),
    s as (select *, min(seq) filter (type = 'error') over (partition by request_id) as stop from e),
    whole as (select request_id, count(*) filter (seq < coalesce(stop, 20)) = min(coalesce(stop, 20)) as whole from s group by request_id)
    select request_id, coalesce(string_agg(payload, '' order by seq) filter (type = 'token' and (stop is null or seq < stop)), '') as text, arg_max(payload, seq) filter (type = 'sources' and (stop is null or seq < stop)) as sources,
    bool_or(type = 'error') as failed, case when any_value(whole) then 'end' else 'timeout' end as closed from s join whole using (request_id) group by request_id""")
def str05_tokens(t):
    """Token streams of all events, each request's dealt to three runs out of order; some lack an event and time out."""
    e = t.events.where("event_id % 1000 <> 25").withColumn("seq", F.col("event_id") % 20)
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "sources").otherwise("token")
    load = F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), F.col("event_id").cast("string"))).otherwise(F.concat("event_type", F.lit(" ")))
    request = F.floor(F.col("event_id") / 20).cast("long").alias("request_id")
    rows = e.select(request, "seq", kind.alias("type"), load.alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
    ends = rows.groupBy("request_id").agg(F.max("ts").alias("ts")).select("request_id", F.lit(20).cast("long").alias("seq"), F.lit("done").alias("type"), F.lit(None).cast("string").alias("payload"), "ts")
    rows = rows.unionByName(ends)
    rows = rows.withColumn("step", F.pmod(F.col("seq") * 7 + F.col("request_id"), F.lit(3)))
    rows = rows.unionByName(clock_of(rows, rows.columns).withColumns({"step": F.lit(3).cast("long"), "ts": F.expr("ts + interval 100 days")}))
    flow = lambda df: timed.replies(df.drop("step"), late="60 days", idle_ms=3_600_000)
    with timed.rocks(t._spark):
        return streams.replayed(rows, F.col("step"), 4, flow)


@query("str11_url_dedup", "select distinct user_id, event_type as url from events")
def str11(t):
    e = events(t).select("user_id", F.col("event_type").alias("url"), "ts")
    return streams.drain(streams.redelivered(e, ["user_id", "url"], "60 days").select("user_id", "url"))
