"""Language identification by Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Hashed byte trigrams of one model.
CELLS = 1 << 15
#: What a tag, script, style or comment without its end takes up is the rest of the page, so each is looked for once.
TAG = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")


def trigram_cells(text: str) -> np.ndarray:
    """Cells of all byte trigrams of a whole text, lower-cased, with a space at either end."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(17)


def visible_text(html: str | None) -> str:
    """The text of a page: no markup, scripts, styles or comments; entities are left as they are."""
    return TAG.sub(" ", html or "")


def fit_text_model(docs: DataFrame, lang_col: str = "lang", smoothing: float = 0.5, most: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(cell | language) by trigram counts over all documents with a language.

    Tasks add up counts of their documents, a vector for each language; their sums, languages * CELLS numbers however
    large the corpus, are the model. Null and empty languages teach nothing. The model has the `most` languages with the
    most documents, ties to the first by name, so that a column of stray values can't make it grow with the corpus.
    """

    known = [r.lang for r in docs.groupBy(F.col(lang_col).alias("lang")).count().where("lang <> ''").orderBy(F.desc("count"), "lang").limit(most).collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang and text:
                    counts = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                    counts += np.bincount(trigram_cells(text), minlength=CELLS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "cell": at.astype(np.int32), "n": counts[at]})

    parts = docs.select(F.col(lang_col).alias("lang"), "text").where(F.col("lang").isin(known)).mapInPandas(run, "lang string, cell int, n long")
    got = parts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    counts = np.full((len(langs), CELLS), smoothing)
    counts[[langs.index(x) for x in got["lang"]], got["cell"].to_numpy(int)] += got["n"].to_numpy(float)
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], declared_trust: float = 0.9, address_trust: float = 0.85, prior_weight: float = 5.0, temper: float = 0.05) -> DataFrame:
    """The language of each page (page_id, url, html) by Bayes' rule over independent evidence.

    - text: log likelihoods of the visible text's trigrams, times `temper` since neighbouring trigrams aren't independent;
    - markup: the language that <html lang> declares is right with probability declared_trust;
    - address: a language code that is the host's suffix or the first part of the path, likewise with address_trust;
    - host: a prior from the host's other pages. A first pass without it gives every page a posterior; these are
      summed by host with partial aggregation, and a host's distribution is smoothed with that of its domain (the last
      two labels), a domain's with its suffix's and a suffix's with the whole, each as if by `prior_weight` more pages.
      The page's own posterior is taken out of each sum, as its evidence is in already.

    Returns page_id, host, declared, address_lang, lang, probability and text_lang (by text alone). Evidence that is
    missing or names no language of the model is uniform. A null html is an empty page, a null url has no host: pages
    without one share the empty host. Ties go to the first language. Repeated rows are pages of their own. With an empty
    model lang is null. An empty table gives no rows; other columns are ignored. A host under a third of all pages is one
    row per task before its shuffle, and the join back is one that may be split where it is skewed.
    """
    langs, logs = model
    k = len(langs)
    spark = pages.sparkSession
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[/?#._-]|$)", 1))
    host = host_of(url)
    suffix = F.element_at(F.split(host, r"\."), -1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), declared.alias("declared"), F.when(path.isin(langs), path).otherwise(suffix).alias("address"), html.alias("html"))
    if not k:
        return rows.select("page_id", "host", "declared", F.lit(None).cast("string").alias("address_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    shared = spark.sparkContext.broadcast(logs)  # languages * CELLS doubles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            out = []
            for html in batch.pop("html"):
                cells, counts = np.unique(trigram_cells(visible_text(html)), return_counts=True)
                out.append(table[:, cells] @ counts * temper)
            batch["text_log"] = out
            yield batch

    scored = rows.mapInPandas(run, "page_id long, host string, declared string, address string, text_log array<double>")

    def evidence(col: Column, trust: float) -> list[Column]:
        other = (1 - trust) / max(1, k - 1)
        return [F.when(~col.isin(langs), 0.0).otherwise(F.when(col == x, float(np.log(trust))).otherwise(float(np.log(max(other, 1e-12))))) for x in langs]

    def posterior(logs: list[Column]) -> Column:
        """Normalised probabilities of logarithms, as an array."""
        arr = F.array(*logs)
        up = F.transform(arr, lambda x: F.exp(x - F.array_max(arr)))
        return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))

    text = [F.col("text_log")[i] for i in range(k)]
    both = [t + m + a for t, m, a in zip(text, evidence(F.col("declared"), declared_trust), evidence(F.col("address"), address_trust), strict=True)]
    first = scored.select("page_id", "host", "declared", F.when(F.col("address").isin(langs), F.col("address")).alias("address_lang"), F.array(*both).alias("logs"), F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(F.col("text_log"), F.array_max("text_log")).cast("int")).alias("text_lang"))
    first = stored(first, "language-evidence")
    soft = first.withColumn("p", posterior([F.col("logs")[i] for i in range(k)]))
    hosts = stored(soft.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]), "language-hosts")
    labels = F.split("host", r"\.")
    hosts = hosts.withColumn("domain", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))).withColumn("suffix", F.element_at(labels, -1))

    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    packed = lambda n, at: [F.col("n").alias(n), F.array(*[f"s{i}" for i in range(k)]).alias(at)]
    whole = hosts.agg(F.sum("n").alias("n"), *sums).first()
    of_suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), *sums).select("suffix", *packed("n_suffix", "of_suffix"))
    of_domain = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), *sums).select("domain", "suffix", *packed("n_domain", "of_domain"))
    priors = hosts.select("host", "domain", *packed("n_host", "of_host")).join(of_domain.hint("merge"), "domain").join(of_suffix.hint("merge"), "suffix")
    priors = stored(priors.drop("domain", "suffix"), "language-priors")

    def smoothed(s: Column, n: Column, up: Column) -> Column:
        """The distribution of a level's other pages, smoothed by the level above."""
        others = F.zip_with(s, F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.zip_with(others, up, lambda a, b: (a + prior_weight * b) / (n - 1 + prior_weight))

    fused = first.join(priors.hint("merge"), "host").withColumn("own", posterior([F.col("logs")[i] for i in range(k)]))
    up = smoothed(F.array(*[F.lit(float(whole[f"s{i}"] or 0)) for i in range(k)]), F.lit(whole["n"] or 1), F.array(*[F.lit(1.0 / k)] * k))
    for level in ("suffix", "domain", "host"):
        fused = fused.withColumn("prior", up)
        up = smoothed(F.col(f"of_{level}"), F.col(f"n_{level}"), F.col("prior"))
    fused = fused.withColumn("prior", up)
    fused = fused.withColumn("p", posterior([F.col("logs")[i] + F.log(F.col("prior")[i]) for i in range(k)]))
    best = F.array_max("p")
    return fused.select("page_id", "host", "declared", "address_lang", F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("p", best).cast("int")).alias("lang"), best.alias("probability"), "text_lang")
