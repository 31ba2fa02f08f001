"""Queries of retrieval-quality evaluation; verdicts and vectors come from labels and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from .base import query

CASES = "cases as (select distinct case_id from verdicts)"
PREC = "prec as (select case_id, round(sum(relevant::double / pos) / sum(1.0::double / pos), 6) as context_precision from verdicts group by case_id)"
LINES = "lines as (select case_id, string_agg(case when relevant = 1 then '相关' else '不相关' end, chr(10) order by pos) as raw, count(*) as n, sum(relevant) as yes from verdicts group by case_id)"


def verdict_lines(t):
    """A reply for each case: a line for each verdict, in order."""
    word = F.when(F.col("relevant") == 1, "是").otherwise("否")
    line = F.when(F.col("relevant") == 1, "相关").otherwise("不相关")
    join = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("w")))), lambda y: y["w"]), "\n")
    return t.verdicts.groupBy("case_id").agg(join(line).alias("raw"), join(word).alias("yes"), F.count("*").cast("int").alias("n"))


@query("eva01_context_precision", PREC + " select case_id, context_precision from prec")
def eva01(t):
    return ev.context_precision(t.verdicts)


@query("eva02_batch_precision", """v as (select case_id, row_number() over (partition by case_id order by pos) as i, relevant from verdicts), n as (select case_id, count(*) as k from v group by case_id),
    p as (select case_id, i, relevant from v union all select case_id, j, 0 from n, range(1, 4) r(j) where j > k) select case_id, round(sum(relevant::double / i) / sum(1.0::double / i), 6) as context_precision from p group by case_id""")  # fmt: skip
def eva02(t):
    return ev.batch_precision(verdict_lines(t).withColumn("n_contexts", F.lit(3)))


@query("eva03_relevance_lines", "select case_id, string_agg(case when relevant = 1 then 'true' else 'false' end, ',' order by pos) as marks from verdicts group by case_id")
def eva03(t):
    return verdict_lines(t).select("case_id", F.array_join(F.transform(ev.relevance_lines(F.col("raw")), lambda x: x.cast("string")), ",").alias("marks"))


@query("eva04_yes_lines", "select case_id, cast(sum(relevant) as int) as yes from verdicts group by case_id")
def eva04(t):
    return verdict_lines(t).select("case_id", ev.yes_lines(F.col("yes")).alias("yes"))


@query("eva05_context_recall", LINES + " select case_id, case when case_id % 4 = 0 then 1.0 else round(yes / (case_id % 4), 6) end as context_recall from lines")
def eva05(t):
    return ev.supported_share(verdict_lines(t).select("case_id", (F.col("case_id") % 4).cast("int").alias("n_claims"), F.col("yes").alias("raw")), "context_recall")


@query("eva06_faithfulness", LINES + " select case_id, round(yes / n, 6) as faithfulness from lines")
def eva06(t):
    return ev.supported_share(verdict_lines(t).select("case_id", F.col("n").alias("n_claims"), F.col("yes").alias("raw")), "faithfulness")


REL = "q as (select vec_id - vec_id % 5 as case_id, embedding::double[] as q from embeddings where vec_id % 5 <> 0 and vec_id % 15 < 10), c as (select vec_id as case_id, embedding::double[] as v from embeddings where vec_id % 5 = 0), rel as (select c.case_id, coalesce(round(avg(list_cosine_similarity(v, q)), 4), 1.0) as answer_relevancy from c left join q using (case_id) group by c.case_id)"


@query("eva08_answer_relevancy", REL + " select case_id, answer_relevancy from rel")
def eva08(t):
    return relevancy(t)


def relevancy(t):
    cases = t.embeddings.where("vec_id % 5 = 0").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector"))
    questions = t.embeddings.where("vec_id % 5 <> 0 and vec_id % 15 < 10").select((F.col("vec_id") - F.col("vec_id") % 5).alias("case_id"), F.col("embedding").alias("vector"))
    return ev.answer_relevancy(cases, questions).withColumn("answer_relevancy", F.round("answer_relevancy", 4))


ENT = "pairs as (select d.doc_id as case_id, d.text as a, e.text as b from documents d join documents e on e.doc_id = d.doc_id + 1), ents as (select case_id, list_distinct(list_filter(list_transform(string_split_regex(a, '[,，、\\n]'), lambda x: trim(x)), lambda x: x <> '')) as a, list_distinct(list_filter(list_transform(string_split_regex(b, '[,，、\\n]'), lambda x: trim(x)), lambda x: x <> '')) as b from pairs), ent as (select case_id, case when len(a) = 0 then 1.0 else round(len(list_intersect(a, b)) / len(a), 6) end as entity_recall from ents)"


@query("eva10_entity_recall", ENT + " select case_id, entity_recall from ent")
def eva10(t):
    d = t.documents
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context"))
    return ev.entity_recall(d.join(nxt, "doc_id").select(F.col("doc_id").alias("case_id"), F.col("text").alias("truth"), "context"))


CASE = PREC + ", " + LINES + """, m as (select c.case_id, round(context_precision, 4) as context_precision, round(case when c.case_id % 4 = 0 then 1.0 else round(yes / (c.case_id % 4), 6) end, 4) as context_recall, round(round(yes / n, 6), 4) as faithfulness
    from (select distinct case_id from verdicts) c join prec using (case_id) join lines using (case_id)), full_ as (select *, round((context_precision + context_recall + faithfulness + 0.0 + 0.0) / 5, 4) as average from m)"""


def cases(t, quick=False):
    all_cases = t.verdicts.select("case_id").distinct()
    return ev.evaluate(all_cases, {"context_precision": eva01(t), "context_recall": eva05(t), "faithfulness": eva06(t)}, quick)


@query("eva11_quick_gate", PREC + " select case_id, round(context_precision, 4) as context_precision, 0.0::double as context_recall, round(round(context_precision, 4) / 5, 4) as average from prec")
def eva11(t):
    return cases(t, quick=True).select("case_id", "context_precision", "context_recall", "average")


@query("eva12_case_metrics", CASE + " select case_id, context_precision, context_recall, faithfulness, average from full_")
def eva12(t):
    return cases(t).select("case_id", "context_precision", "context_recall", "faithfulness", "average")


RUNS = CASE + ", run as (select case_id // 100 as run_id, count(*) as test_case_count, round(round(avg(context_precision), 4), 3) as p, round(round(avg(context_recall), 4), 3) as r, round(round(avg(faithfulness), 4), 3) as f from full_ group by 1)"


def run_rows(t):
    out = ev.runs(cases(t).withColumn("run_id", F.floor(F.col("case_id") / 100).cast("long")))
    return out.select("run_id", "test_case_count", *[F.round(f"avg_{m}", 3).alias(f"avg_{m}") for m in ev.METRICS])


@query("eva13_runs", RUNS + " select run_id, test_case_count, p as avg_context_precision, r as avg_context_recall, f as avg_faithfulness from run")
def eva13(t):
    return run_rows(t).select("run_id", "test_case_count", "avg_context_precision", "avg_context_recall", "avg_faithfulness")


@query("eva14_dashboard", RUNS + " select run_id, coalesce(k.name, 'KB#' || cast(run_id * 3 % 30 as int)) as kb_name, round((p + r + f) / 5, 3) as overall from (select * from run order by run_id desc limit 20) left join kbs k on k.kb_id = run_id * 3 % 30")
def eva14(t):
    rows = run_rows(t).withColumn("kb_id", (F.col("run_id") * 3 % 30).cast("int")).withColumn("created_at", F.col("run_id"))
    return ev.dashboard(rows, t.kbs).select("run_id", "kb_name", F.round("overall", 3).alias("overall"))


@query("eva15_drill_down", CASE + " select case_id, average from full_ where case_id // 100 = 2")
def eva15(t):
    return cases(t).where(F.floor(F.col("case_id") / 100) == 2).select("case_id", "average")


@query("eva16_bands", RUNS + ", l as (select run_id, unnest(['avg_context_precision', 'avg_context_recall', 'avg_faithfulness', 'avg_answer_relevancy', 'avg_entity_recall']) as metric, unnest([p, r, f, 0, 0]) as value from run) select run_id, metric, case when value >= 0.7 then 'good' when value >= 0.4 then 'fair' else 'poor' end as band from l")
def eva16(t):
    return ev.bands(run_rows(t).drop("test_case_count")).select("run_id", "metric", "band")


@query("eva17_sample", "select id, content from (select doc_id as id, text as content, md5('42|' || doc_id) as o from documents order by o, id limit 40) where length(content) >= 100")
def eva17(t):
    return ev.sample_chunks(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 120)


@query("eva18_parse_qa", "select event_id as case_id, event_type || '?' as question, 'user ' || user_id as answer from events where event_id % 4 in (0, 1) union all select event_id, '1. Q: ' || event_type, '' from events where event_id % 4 = 2")
def eva18(t):
    """Replies written from events: JSON with one complete and one incomplete pair, loose lines, or neither."""
    k, e = F.col("event_id") % 4, F.col("event_type")
    raw = F.when(k.isin(0, 1), F.concat(F.lit('Sure: {"qa_pairs": [{"question": "'), e, F.lit('?", "answer": "user '), F.col("user_id").cast("string"), F.lit('"}, {"question": "", "answer": "x"}]}'))).when(k == 2, F.concat(F.lit("Some text\n 1. Q: "), e, F.lit("\nand more"))).otherwise("no pairs here")
    # a brace inside the list ends the reply pattern's lazy match early only if the list has none after it
    return ev.parse_qa(t.events.select(F.col("event_id").alias("case_id"), raw.alias("raw")))


@query("eva19_compare_runs", CASE + " select 'q' || a.case_id % 100 as question, round(b.context_precision - a.context_precision, 4) as d_context_precision from full_ a join full_ b on b.case_id = a.case_id + 100 where a.case_id // 100 = 1")
def eva19(t):
    rows = cases(t).withColumn("run_id", F.floor(F.col("case_id") / 100)).withColumn("question", F.concat(F.lit("q"), (F.col("case_id") % 100).cast("string")))
    return ev.compare_runs(rows, 1, 2).select("question", "d_context_precision")


@query("eva20_list_runs", RUNS + " select run_id, p as context_precision from run where run_id % 5 in (1, 2)")
def eva20(t):
    mine = run_rows(t).where(F.col("run_id") % 5 <= 2).where("run_id % 5 >= 1").orderBy(F.desc("run_id"))
    metrics = F.create_map(*[x for m in ev.METRICS for x in (F.lit(m), F.col(f"avg_{m}"))])
    return mine.select("run_id", metrics.alias("metrics")).select("run_id", F.col("metrics")["context_precision"].alias("context_precision"))
