"""Chunks scored in Arrow batches against few queries: BM25 as by postings, the best kept over batches."""

import numpy as np

from ragmill.operators import bm25, inplace


def test_bm25_in_place_as_by_postings(spark):
    texts = [([k % 2, 2], f"c{k}", " ".join(f"w{(k * j) % 13}" for j in range(k % 9))) for k in range(60)] + [(None, "n", "w1"), ([0], "e", "")]
    rows = spark.createDataFrame(texts, "kbs array<int>, chunk_id string, text string")
    asked = spark.createDataFrame([(1, 0, "w1 w2 w2 w5"), (2, 2, "w0 w7"), (3, 1, "nowhere"), (4, 9, "w1"), (5, 0, ""), (6, None, "w1")], "query_id long, kb_id int, text string")
    one, other = (sorted(map(tuple, bm25.search(asked, rows, 4, most=n).collect())) for n in (100, 0))
    assert one == other and {r[0] for r in one} == {1, 2}


def test_no_query_in_place(spark):
    rows = spark.createDataFrame([([0], "c", "w1")], "kbs array<int>, chunk_id string, text string")
    asked = spark.createDataFrame([], "query_id long, kb_id int, text string")
    assert bm25.search(asked, rows, 4).collect() == []


def test_search_plan_shuffles_scores_alone(spark):
    """Terms neither explode into rows nor move: the only Python nodes read chunks, the only shuffle after them is of scores."""
    rows = spark.createDataFrame([([0], "c", "w1 w2")], "kbs array<int>, chunk_id string, text string")
    asked = spark.createDataFrame([(1, 0, "w1")], "query_id long, kb_id int, text string")
    plan = bm25.search(asked, rows, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_best_are_kept_over_batches():
    rng = np.random.default_rng(5)
    q, score = rng.integers(0, 7, 5000), np.round(rng.random(5000), 3)
    best, seen = inplace.Best(7, 15), []
    for lo in range(0, 5000, 37):
        seen += (lo + best.kept(q[lo : lo + 37], score[lo : lo + 37])).tolist()
    for i in range(7):
        mine = np.flatnonzero(q == i)
        least = np.sort(score[mine])[-15]
        assert set(mine[score[mine] >= least].tolist()) <= set(seen)
    assert len(seen) < 2500


def test_vectors_in_place_as_by_the_join(spark):
    from ragmill.operators import vectors

    rng = np.random.default_rng(3)
    rows = [(k % 3, k, [float(x) for x in rng.standard_normal(4)]) for k in range(60)]
    rows += [(0, 60, None), (0, 61, []), (1, 62, [0.0] * 4), (1, 63, [1.0, 2.0]), (2, 64, [1.0, None, 0.0, 2.0]), (None, 65, [1.0] * 4), (2, 66, [float("nan")] * 4), (0, 67, rows[0][2])]
    held = spark.createDataFrame(rows, "kb_id int, id long, embedding array<float>")
    asked = held.where("id % 10 in (0, 2, 3, 4)").withColumnRenamed("id", "query_id")
    plain = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    rounded = lambda n: vectors.cosines(asked, held, most=n).selectExpr("query_id", "id", "round(cosine, 6) as cosine")
    assert plain(rounded(1000)) == plain(rounded(0))
    for metric in ("half", "sidecar"):
        one, other = (plain(vectors.search(asked, held, 5, 0.0, metric, True, most=n)) for n in (1000, 0))
        assert one == other
    assert "Exchange" not in vectors.cosines(asked, held)._jdf.queryExecution().executedPlan().toString()
