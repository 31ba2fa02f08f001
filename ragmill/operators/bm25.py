"""BM25 over tables of chunks: postings, statistics, scoring of whole tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.files import written
from . import inplace

#: So many asked terms at most are sent to all tasks; more are merged.
MOST = 200_000


def postings(chunks: DataFrame) -> DataFrame:
    """kb_id, chunk_id, term, tf of chunks (kb_id, chunk_id, text)."""
    return chunks.select("kb_id", "chunk_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("kb_id", "chunk_id", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    """kb_id, chunk_id, len: terms of each chunk, 0 included; no shuffle."""
    return chunks.select("kb_id", "chunk_id", F.size(terms(F.col("text"))).cast("long").alias("len"))


def stats(chunks: DataFrame) -> DataFrame:
    """kb_id, n, avgdl: one row per knowledge base."""
    return lengths(chunks).groupBy("kb_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def term_stats(post: DataFrame, stat: DataFrame) -> DataFrame:
    """kb_id, term, df, idf = ln((n - df + 0.5) / (df + 0.5) + 1)."""
    df = post.groupBy("kb_id", "term").agg(F.count("*").alias("df"))
    return df.join(stat, "kb_id").select("kb_id", "term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def tokens(chunks: DataFrame) -> DataFrame:
    """kbs, chunk_id, terms, len of chunks (kb_id or an array kbs, chunk_id, text), each tokenised once.

    What is derived from it should read it from storage: see sources.files.written().
    """
    kbs = F.col("kbs") if "kbs" in chunks.columns else F.array("kb_id")
    return chunks.select(kbs.alias("kbs"), "chunk_id", terms(F.col("text")).alias("terms")).withColumn("len", F.size("terms").cast("long"))


def stored_tokens(chunks: DataFrame) -> DataFrame:
    """tokens(), stored with each chunk's terms as one text, `words`, from which `terms` are split again where they are used."""
    toks = tokens(chunks)
    held = written(toks.select("kbs", "chunk_id", F.array_join("terms", " ").alias("words"), F.size("terms").cast("long").alias("len")), "tokens")
    terms_again = F.when(F.length("words") > 0, F.split("words", " ")).otherwise(F.array().cast("array<string>"))
    return held.select("kbs", "chunk_id", terms_again.alias("terms"), "len", "words")


def token_stats(toks: DataFrame) -> DataFrame:
    """kb_id, n, avgdl of tokens()."""
    return toks.select(F.explode("kbs").alias("kb_id"), "len").groupBy("kb_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def counted(toks: DataFrame) -> DataFrame:
    """tokens() with `counts`, an array of (term, tf): runs of the sorted terms, so a chunk is counted where it is read."""
    rows = toks.where(F.size("terms") > 0).withColumn("_sorted", F.sort_array("terms"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    rows = rows.withColumn("_starts", starts)
    ends = F.concat(F.expr("slice(_starts, 2, size(_starts))"), F.array(F.size("_sorted")))
    runs = F.zip_with("_starts", ends, lambda a, b: F.struct(F.get("_sorted", a).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.withColumn("counts", runs).drop("_sorted", "_starts", "terms")


def token_postings(toks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """kb_id, chunk_id, term, tf, len of tokens(), with `wanted` (kb_id, term) of those terms of those bases only.

    A chunk is one row of tokens(). Terms are counted in it, whatever the number of its knowledge bases, which come last;
    nothing is shuffled.
    """
    # of an explode() Spark would infer a filter and push it down, with its arrays made anew for each term
    words = counted(toks).select("kbs", "chunk_id", "len", F.explode_outer("counts").alias("c"))
    post = words.select(F.explode("kbs").alias("kb_id"), "chunk_id", "c.term", "c.tf", "len")
    return post if wanted is None else post.join(wanted, ["kb_id", "term"], "left_semi")


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, kb_id, term, times of queries (query_id, kb_id, text); a repeated term counts each time."""
    return queries.select("query_id", "kb_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "kb_id", "term").agg(F.count("*").alias("times"))


def ranked(asked: DataFrame, post: DataFrame, df: DataFrame, stat: DataFrame, top_k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, score, bm25_rank of the top_k chunks with a positive score, from postings with their lengths.

    df (kb_id, term, df) and stat (kb_id, n, avgdl) are joined to the asked terms, a stored table of which there are few,
    before these meet the postings where they are read. Terms of a chunk are neighbours there, so sums are made in place.
    """
    weighed = weights(asked, df, stat)
    hits = post.join(weighed.hint("broadcast" if asked.count() <= MOST else "merge"), ["kb_id", "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    scored = hits.groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.round(F.sum(part), 4).alias("score")).where("score > 0")
    return best(scored, top_k)


def weights(asked: DataFrame, df: DataFrame, stat: DataFrame) -> DataFrame:
    """query_id, kb_id, term, times, idf, avgdl of the asked terms that occur."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return asked.join(df, ["kb_id", "term"]).join(stat, "kb_id").select("query_id", "kb_id", "term", "times", idf.alias("idf"), "avgdl")


def best(scored: DataFrame, top_k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("bm25_rank", rank).where(F.col("bm25_rank") <= top_k)


def search(queries: DataFrame, chunks: DataFrame, top_k: int = 5, k1: float = 1.5, b: float = 0.75, most: int = MOST) -> DataFrame:
    """query_id, id, score, bm25_rank: the top_k chunks with a positive score for each query (query_id, kb_id, text).

    chunks are as in tokens(), or its result. They are tokenised once, into a stored table. With at most `most` asked
    terms these go to all tasks, and chunks are counted and scored where they are read; more meet postings, cut to the
    terms that some query of their knowledge base has. Chunks that share an id are separate ones in the first case.
    """
    toks = chunks if "terms" in chunks.columns else stored_tokens(chunks)
    asked = written(asked_terms(queries), "asked")
    wanted = asked.select("kb_id", "term").distinct()
    if asked.count() > most:
        post = written(token_postings(toks, wanted.hint("merge")), "postings")
        df = post.groupBy("kb_id", "term").agg(F.count("*").alias("df"))
        return ranked(asked, post, df, token_stats(toks), top_k, k1, b)
    weighed = written(weights(asked, inplace.frequencies(toks, wanted), token_stats(toks)), "weights")
    scored = inplace.weighed_sums(toks, weighed, top_k, k1, b).select("query_id", "id", F.round("raw", 4).alias("score")).where("score > 0")
    return best(scored, top_k)
