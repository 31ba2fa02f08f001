"""Retrieval-quality metrics from tables of verdicts, claims, entities and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import cosine

METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy", "entity_recall")


def context_precision(verdicts: DataFrame) -> DataFrame:
    """case_id, context_precision: sum of relevant / position over the sum of 1 / position; 0 if none is relevant."""
    return verdicts.groupBy("case_id").agg(F.round(F.sum(F.col("relevant") / F.col("pos")) / F.sum(1.0 / F.col("pos")), 6).alias("context_precision"))


def relevance_lines(raw: Column) -> Column:
    """Verdicts of a reply's lines: 不相关 is false, else 相关 is true, other lines are skipped."""
    marks = F.transform(F.split(F.trim(raw), "\n"), lambda x: F.when(F.contains(x, F.lit("不相关")), False).when(F.contains(x, F.lit("相关")), True))
    return F.filter(marks, lambda x: x.isNotNull())


def yes_lines(raw: Column) -> Column:
    """Lines with 是 and without 否."""
    return F.size(F.filter(F.split(F.trim(raw), "\n"), lambda x: F.contains(x, F.lit("是")) & ~F.contains(x, F.lit("否"))))


def batch_precision(replies: DataFrame, contexts: int = 3) -> DataFrame:
    """case_id, context_precision of replies (case_id, raw, n_contexts): missing verdicts are false, surplus ones stay, no reply is 0.5."""
    n = F.least(F.col("n_contexts"), F.lit(contexts))
    got = relevance_lines(F.col("raw"))
    short = F.greatest(n - F.size(got), F.lit(0))
    padded = F.concat(got, F.when(short > 0, F.transform(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    rel = F.aggregate(F.transform(padded, lambda x, i: F.when(x, 1.0 / (i + 1)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    whole = F.aggregate(F.transform(padded, lambda x, i: 1.0 / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return replies.select("case_id", F.when(F.col("raw").isNull(), 0.5).when(whole > 0, F.round(rel / whole, 6)).otherwise(0.0).alias("context_precision"))


def supported_share(rows: DataFrame, name: str) -> DataFrame:
    """case_id and supported / claims of rows (case_id, n_claims, raw): 1 without claims, 0 without a reply; surplus yes lines may exceed 1."""
    return rows.select("case_id", F.when(F.col("n_claims").isNull() | F.col("raw").isNull(), 0.0).when(F.col("n_claims") == 0, 1.0).otherwise(F.round(yes_lines(F.col("raw")) / F.col("n_claims"), 6)).alias(name))


def claims(replies: DataFrame) -> DataFrame:
    """case_id, pos, claim of replies (case_id, raw, text): parsed lines, or the text's sentences without a reply."""
    return replies.select("case_id", F.posexplode(F.coalesce(T.parse_claims(F.col("raw")), T.sentences(F.col("text")))).alias("pos", "claim"))


def answer_relevancy(cases: DataFrame, questions: DataFrame) -> DataFrame:
    """case_id, answer_relevancy: mean cosine of a case's vector with its reverse questions'; 1 without questions."""
    near = cases.join(questions.select("case_id", F.col("vector").alias("q")), "case_id").groupBy("case_id").agg(F.round(F.avg(cosine(F.col("vector"), F.col("q"))), 6).alias("r"))
    return cases.select("case_id").join(near, "case_id", "left").select("case_id", F.coalesce("r", F.lit(1.0)).alias("answer_relevancy"))


def entity_recall(rows: DataFrame) -> DataFrame:
    """case_id, entity_recall of rows (case_id, truth, context: entity lists as text): shared over the truth's; 1 if it has none, 0 if an input is missing."""
    a, b = (F.array_distinct(T.parse_list(F.col(c))) for c in ("truth", "context"))
    return rows.select("case_id", F.when(F.col("truth").isNull() | F.col("context").isNull(), 0.0).when(F.size(a) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(a), 6)).alias("entity_recall"))


def evaluate(cases: DataFrame, metrics: dict[str, DataFrame], quick: bool = False) -> DataFrame:
    """case_id, the five metrics to 4 places (0 where not computed) and their average; quick computes precision and relevancy alone."""
    out = cases.select("case_id")
    for name in METRICS:
        use = name in metrics and (not quick or name in ("context_precision", "answer_relevancy"))
        out = out.join(metrics[name].select("case_id", name), "case_id", "left") if use else out.withColumn(name, F.lit(0.0))
    out = out.select("case_id", *[F.round(F.coalesce(m, F.lit(0.0)), 4).alias(m) for m in METRICS])
    total = sum((F.col(m) for m in METRICS[1:]), F.col(METRICS[0]))
    return out.withColumn("average", F.round(total / 5, 4))


def runs(results: DataFrame) -> DataFrame:
    """run_id, test_case_count and the mean of each metric."""
    return results.groupBy("run_id").agg(F.count("*").alias("test_case_count"), *[F.round(F.avg(m), 4).alias(f"avg_{m}") for m in METRICS])


def dashboard(of_runs: DataFrame, kbs: DataFrame, newest: int = 20) -> DataFrame:
    """The newest runs (run_id, kb_id, created_at, averages) with the knowledge base's name, KB#id if unknown, and the overall mean."""
    top = of_runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(newest)
    total = sum((F.col(f"avg_{m}") for m in METRICS[1:]), F.col(f"avg_{METRICS[0]}"))
    return top.join(kbs.select("kb_id", "name"), "kb_id", "left").select("run_id", "created_at", F.coalesce("name", F.concat(F.lit("KB#"), F.col("kb_id").cast("string"))).alias("kb_name"), *[f"avg_{m}" for m in METRICS], F.round(total / 5, 4).alias("overall"))


def bands(rows: DataFrame, key: str = "run_id", prefix: str = "avg_") -> DataFrame:
    """key, metric, value, band: good from 0.7, fair from 0.4, else poor."""
    long = rows.unpivot([key], [f"{prefix}{m}" for m in METRICS], "metric", "value")
    return long.withColumn("band", F.when(F.col("value") >= 0.7, "good").when(F.col("value") >= 0.4, "fair").otherwise("poor"))


def sample_chunks(chunks: DataFrame, max_pairs: int, seed: str = "42", min_chars: int = 100) -> DataFrame:
    """A test set's chunks (id, content): min(n, max(10, max_pairs div 3)) by hash order, the short ones skipped, max_pairs at most."""
    n = max(10, max_pairs // 3)
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    return chunks.withColumn("_o", order).orderBy("_o", "id").limit(n).where(F.length("content") >= min_chars).orderBy("_o", "id").limit(max_pairs).drop("_o")


QA = "struct<qa_pairs:array<struct<question:string,answer:string>>>"


def parse_qa(replies: DataFrame) -> DataFrame:
    """case_id, question, answer: complete pairs of the reply's JSON, else its question lines with empty answers."""
    data = F.from_json(F.regexp_extract("raw", r'(?s)\{[^{}]*"qa_pairs"[^{}]*\[.*?\][^{}]*\}', 0), QA)["qa_pairs"]
    full = lambda p: (F.length(p["question"]) > 0) & (F.length(p["answer"]) > 0)
    lines = F.filter(F.transform(F.split(F.trim("raw"), "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("Q:")) | F.contains(x, F.lit("问:")) | F.contains(x, F.lit("问题:")))
    loose = F.transform(lines, lambda x: F.struct(x.alias("question"), F.lit("").alias("answer")))
    return replies.select("case_id", F.explode(F.coalesce(F.filter(data, full), loose)).alias("p")).select("case_id", "p.question", "p.answer")


def compare_runs(results: DataFrame, run_a: int, run_b: int) -> DataFrame:
    """question and each metric's difference b - a, for questions of both runs."""
    a, b = (results.where(F.col("run_id") == r).select("question", *[F.col(m).alias(f"{s}_{m}") for m in METRICS]) for r, s in ((run_a, "a"), (run_b, "b")))
    return a.join(b, "question").select("question", *[F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 4).alias(f"d_{m}") for m in METRICS])
