"""The numbered queries against their SQL, and the pipeline's stages on their own inputs."""

from collections import Counter

import numpy as np
import pytest
from conftest import DATA, oracle_rows, rows_of
from test_dedup import brute_components

import corpus_pipeline
from ragmill.llm import pieces, quality, registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert rows_of(registry.queries()[name](spark, DATA)) == oracle_rows(duck, registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def seen(spark):
    """The documents, and what each stage of the pipeline makes of the stage before."""
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], DATA), f"test-{name}"))
    return out


def texts_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def without_repeats(rows, length=400):
    """Texts without the bytes of strings that start twice; every window is looked up."""
    coded = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(hash(b[k : k + length]) for _, b in coded for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in coded:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[hash(b[k : k + length])] > 1:
                gone[k : k + length] = True
        out[i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")] += 1
    return out


def test_stages_equal_brute_force(spark, duck, seen):
    docs, good, single, cut, mixed, encoded = seen
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    score = lambda t: float(model.score(quality.features(t)[None])[0])
    assert texts_of(good) == Counter({k: n for k, n in texts_of(docs).items() if score(k[1]) >= 0.7})
    label = brute_components(list(texts_of(good)))
    assert texts_of(single) == Counter({k: n for k, n in texts_of(good).items() if label[k[0]] == k[0]})
    assert texts_of(cut) == without_repeats(list(texts_of(single).elements()))
    other = duck.cursor()
    other.register("documents", cut.toPandas())
    rows = other.execute(f"select doc_id, size, taken from ({registry.oracle_sql()['op1_pareto_mix']})").fetchall()
    copies, text = {i: taken // size for i, size, taken in rows if size}, dict(texts_of(cut))
    assert texts_of(mixed) == Counter({k: copies[k[0]] for k in text if copies.get(k[0])})
    assert texts_of(pieces.decode(encoded)) == texts_of(mixed)


def test_pipeline_stages(seen):
    before, good, single, cut, mixed, encoded = seen
    docs = before
    assert all(x.columns == docs.columns for x in seen[:-1])
    assert 0.7 * before.count() < good.count() < before.count()
    assert single.count() < good.count() and single.count() == single.select("doc_id").distinct().count()
    assert cut.count() == single.count() and cut.where("n_chars <> length(text)").isEmpty()
    words = lambda df: df.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')) as n").first().n
    assert abs(words(mixed) - 1.5 * words(cut)) < 0.1 * words(cut)
    assert encoded.count() == mixed.count() and encoded.where("n_pieces <> size(ids)").isEmpty()


def test_near_duplicate_stage_keeps_one_row_of_a_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (1, a), (2, b), (5, b), (5, c), (5, c), (6, c), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, a), (2, b), (5, c), (7, "")]
