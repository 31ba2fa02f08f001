"""The retrieval model's tables, derived from the given ones by SQL that any engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("documents", "labels", "embeddings", "benchmark", "pages", "conversations", "events")

#: Name to SQL; {name} is another table or view.
VIEWS = {
    "kbs": "select kb_id, kb_id % 5 as user_id, concat('kb_', kb_id) as name from (select distinct cast(substr(source, 4) as int) as kb_id from {documents}) x",
    "docs": """select d.doc_id as document_id, cast(substr(d.source, 4) as int) % 5 as user_id, case when d.doc_id % 4 = 3 then null else cast(substr(d.source, 4) as int) end as kb_id,
        concat('doc_', d.doc_id, case when d.doc_id % 5 = 0 then '.md' when d.doc_id % 5 = 1 then '.pdf' when d.doc_id % 5 = 2 then '.exe' else '.txt' end) as original_filename,
        case when d.doc_id % 10 = 9 then 'failed' when d.doc_id % 10 = 8 then 'parsing' else 'completed' end as status, d.lang, coalesce(l.quality, 0) as quality, d.n_chars as file_size, d.text
        from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "doc_kb": "select doc_id as document_id, cast((doc_id * 7) % 20 as int) as kb_id from {documents} where doc_id % 3 = 0",
    "doc_tags": "select doc_id as document_id, lang as name, 'manual' as source from {documents} union all select doc_id, case when quality = 1 then 'quality' else 'review' end, 'auto' from {labels}",
    "vectors": "select vec_id, label as kb_id, embedding from {embeddings}",
    "vector_queries": "select vec_id as query_id, label as kb_id, embedding from {embeddings} where vec_id % 50 = 0",
    "text_queries": "select item_id as query_id, cast(item_id % 20 as int) as kb_id, text from {benchmark}",
    "conversations_v": "select conv_id, conv_id % 10 as user_id, case when conv_id % 4 = 0 then null else cast(conv_id % 20 as int) end as kb_id, count(*) as n_messages from {conversations} group by conv_id",
    "messages": "select conv_id * 1000 + turn as message_id, conv_id, turn, role, text as content from {conversations}",
    "feedback": """select event_id, (event_id % 50) * 1000 + 1 as message_id, user_id, case when event_type in ('purchase', 'signup') then 1 when event_type = 'error' then -1 else 0 end as rating,
        case when event_type = 'purchase' then 'thumbs_up' when event_type = 'error' then 'thumbs_down' when event_type = 'click' then 'copy' when event_type = 'signup' then 'regenerate' else '' end as feedback_type,
        case when event_id % 3 = 0 then props else '' end as comment, ts from {events}""",
    "outbox": """select event_id as id, event_id as aggregate_id, case when event_id % 4 = 0 then 'PENDING' when event_id % 4 = 1 then 'PROCESSING' when event_id % 4 = 2 then 'PUBLISHED' else 'DEAD' end as status,
        cast(event_id % 11 as int) as attempts, ts as next_attempt_at, case when event_id % 4 = 1 then ts end as locked_until, ts as created_at from {events}""",
    "call_log": "select event_id, ts, user_id, case when event_type = 'error' then 1 else 0 end as failed from {events}",
    "verdicts": "select doc_id - doc_id % 5 as case_id, cast(doc_id % 5 as int) + 1 as pos, quality as relevant from {labels}",
}


class Tables:
    """Given tables and views of one folder, by attribute; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            needs = [t for t in GIVEN if f"{{{t}}}" in VIEWS[name]]
            return self._spark.sql(VIEWS[name], **{t: getattr(self, t) for t in needs})
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """`sql` (a select, or 'x as (..), .. select') after the views it names, as one DuckDB statement."""
    import re

    plain = {k: v.format(**{t: t for t in GIVEN}) for k, v in VIEWS.items()}
    used = [k for k in plain if re.search(rf"\b{k}\b", sql)]
    body = sql.strip()
    ctes = ", ".join(f"{k} as ({plain[k]})" for k in used)
    if not ctes:
        return body if body.lower().startswith(("select", "with")) else f"with {body}"
    return f"with recursive {ctes} {body}" if body.lower().startswith("select") else f"with recursive {ctes}, {body}"
