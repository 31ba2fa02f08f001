"""WARC round trips, pieces and nearest neighbours."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from helpers import awkward, none_of
from pyspark.sql import functions as F

from ragmill.llm import neighbours, pieces, registry, warc
from ragmill.llm.common import scratch


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 200
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 30)) for i in range(60)] + [(70, "http://a\r\nX: y", long), (71, None, long), (None, "u", long), (72, "u", None), (73, "u", "short"), (74, "u", "short"), (75, "u", "z" * 99), (76, "u", "z" * 99), (77, "u", "z" * 100), (78, "u", "z" * 100), (90, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("shard", F.lit(2))
    got = warc.warc_round_trip(df, shard_rows=10, roll_bytes=4000).collect()
    firsts = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            firsts[b] = min(firsts.get(b, i), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        f = firsts.get(b)
        revisit = f is not None and i != f
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.warc_round_trip(none_of(df)).count() == 0


def test_warc_files_are_the_same_on_every_run(spark):
    df = spark.createDataFrame([(i, "u", f"<p>{i % 7}</p>" * 40) for i in range(200)], "page_id long, url string, html string")
    seen = []
    for parts in (1, 5):
        folder = scratch(spark, "warc-test")
        bounds = warc.shard_bounds(df.select("page_id"), 4)
        lines = warc.write_warc(*warc.mark_revisits(df.repartition(parts)), folder, bounds, roll_bytes=2000).collect()
        seen.append(sorted((r.shard, r.part, r.records, r.bytes, r.sha256) for r in lines))
        assert warc.read_warc(spark, folder).where("record_type = 'response'").select("payload").distinct().count() == 7
    assert seen[0] == seen[1] and len({s for s, *_ in seen[0]}) > 1


def test_range_number_is_exact(spark):
    bounds = [5, 1 << 60]
    df = spark.createDataFrame([(None,), (4,), (5,), ((1 << 60) - 1,), (1 << 60,)], "i long")
    assert [r.x for r in df.select(warc.range_number(F.col("i"), bounds).alias("x")).collect()] == [0, 0, 1, 1, 2]


@pytest.fixture(scope="module")
def unigram():
    """The library's own unigram encoder with the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    scores = {i: s for _, i, s in pieces.piece_scores()}
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if i in scores:
            p.score = scores[i]
        elif p.type == 1:
            p.type = 5
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_units_as_the_library_segments_them(spark, unigram):
    rng = random.Random(2)
    words = {"".join(rng.choice("theandinéü.,!A1") for _ in range(rng.randint(1, 14))) for _ in range(300)} | {"representations", "日本", "naïve", "x" * 120}
    df = spark.createDataFrame([(" " + w,) for w in words], "unit string")
    got = {r.unit: r.ids for r in pieces.lexicon(df).collect()}
    score = {i: s for _, i, s in pieces.piece_scores()}
    for w in words:
        lib = unigram.encode(w)
        assert got[" " + w] == lib or sum(score.get(i, -99_999) for i in got[" " + w]) == sum(score.get(i, -99_999) for i in lib)


def test_round_trip(spark):
    docs = awkward(spark)
    extra = docs.where("doc_id = 5").limit(1).withColumn("doc_id", F.lit(900).cast("long")).withColumn("text", F.lit("tabs\tand  spaces\r\n\n 日本 😀 end "))
    docs = docs.unionByName(extra)
    for common in (5, 200_000):
        got = pieces.encode(docs, common=common, check=True)
        table = pieces.decoder()
        texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
        rows = got.collect()
        assert Counter((r.doc_id, pieces.decode_ids(r.ids, table)) for r in rows) == texts
        assert all(r.round_trip for r in rows)
        assert Counter((r.doc_id, r.n_units) for r in rows) == Counter((r.doc_id, len(pieces.split_units(r.text or "", pieces.unit_pattern()))) for r in docs.collect())
    assert pieces.decode(got).count() == docs.count()
    assert pieces.encode(none_of(docs)).count() == 0


def test_units_lose_nothing_and_no_piece_joins_them():
    rng = random.Random(4)
    inside = {p for p, _, _ in pieces.useful()}
    for pattern in (pieces.re.compile(pieces.UNIT), pieces.unit_pattern()):
        for _ in range(3000):
            text = "".join(rng.choice("ab1_,.(\n\té日 ") for _ in range(rng.randint(1, 12)))
            got = pieces.split_units(text, pattern)
            assert "".join(got) == " " + text
            ends = np.cumsum([len(u) for u in got])[:-1]
            assert not any((" " + text)[i:j] in inside for e in ends for i in range(max(0, e - 8), e) for j in range(e + 1, e + 9))


def test_whole_texts_as_the_library_encodes_them(spark, unigram):
    """Every document of the table, but for those with runs of spaces, which the library's normaliser changes first."""
    score = {i: s for _, i, s in pieces.piece_scores()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    total = lambda ids: sum(score.get(i, -99_999) for i in ids)
    rows = [r for r in pieces.encode(docs, common=300).collect() if r.doc_id in texts]
    assert len(rows) == len(texts)
    for r in rows:
        lib = unigram.encode(texts[r.doc_id])
        assert r.ids == lib or total(r.ids) == total(lib)


def brute_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        x = dict(rows)[q]
        d = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, v in rows if i != q)[:k]
        out[q] = [i for _, i in d]
    return out


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 5)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)]  # copies of a query
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0]), (2004, [None] * 8), (2005, [float("inf")] * 8), (None, [1.0] * 8), (2100, [0.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("query", F.lit(2))
    got = {}
    for r in neighbours.nearest_neighbours(df, lambda i: i % 100 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_neighbours(rows, [i for i, _ in rows if i % 100 == 0], 10)
    assert set(got) == set(want) and got[100] == want[100] == [1000 + i for i in range(10)]
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    few = neighbours.nearest_neighbours(df.where("vec_id in (0, 1, 2)"), lambda i: i % 100 == 0).orderBy("rank").collect()
    assert len(few) == 2 and [r.rank for r in few] == [1, 2] and few[0].score <= few[1].score
    assert neighbours.nearest_neighbours(none_of(df), lambda i: i % 100 == 0).count() == 0


def test_search_looks_at_every_node_it_keeps(spark):
    line = [(i, np.array([i], np.float32).tobytes()) for i in range(100)]
    nodes = spark.createDataFrame(line, "id long, vec binary")
    graph = spark.createDataFrame([(i, i + 1, 1.0, 1) for i in range(99)], "id long, nb long, d double, old int")
    queries = spark.createDataFrame([(7, 0)], "query long, id long")
    got = neighbours.search(graph, nodes, queries, beam=16).orderBy("d").collect()
    assert [(r.query, r.id, r.d) for r in got] == [(7, i, float(i * i)) for i in range(16)]


def test_descent_ends_when_no_edge_changes(spark):
    x = np.random.default_rng(5).normal(size=(3000, 12)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, vec binary")
    graph = neighbours.build_graph(nodes, still=0)
    assert neighbours.descend(graph, nodes, 14, 24)[0].where("old = 0").isEmpty()
    assert graph.count() == graph.select("id", "nb").distinct().count() == 3000 * 14


def test_round_trip_is_that_of_the_document(spark, tmp_path):
    rows = [(1, "a plain text"), (2, "a literal \u2581 mark"), (3, "\u2581first"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op9_pieces(spark, str(tmp_path)).collect()}
    assert {i: r.round_trip for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    ids = {r.doc_id: r.ids for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_pieces for i, r in got.items()} == {i: len(x) for i, x in ids.items()}


def test_long_runs_as_the_library_segments_them(spark, unigram):
    rng = random.Random(6)
    runs = ["".join(rng.choice(["the", "and", "repre", "sent", "ation", "house", "日", "é", "A1"]) for _ in range(n)) for n in (80, 120, 400, 1600)]
    runs = [r[:5000] for r in runs] + ["abc" * 67, "x" * 5000]
    assert all(len(r) > 200 for r in runs)
    score = {i: s for _, i, s in pieces.piece_scores()}
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    for r in pieces.encode(docs).collect():
        lib = unigram.encode(runs[r.doc_id])
        assert r.ids == lib or sum(score.get(i, -99_999) for i in r.ids) == sum(score.get(i, -99_999) for i in lib)


def test_large_magnitudes_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    for size in (1e200, 1e-200, 3e38):
        x = {i: v for i, v in enumerate(rng.uniform(-1, 1, (40, 6)) * size)}
        df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()] + [(3, (x[3] + 9 * size).tolist())], "vec_id long, embedding array<double>")
        x[3] = np.array(min(x[3].tolist(), (x[3] + 9 * size).tolist()))
        got = {}
        for r in neighbours.nearest_neighbours(df, lambda i: i % 10 == 0, 5).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert sorted(got) == [0, 10, 20, 30]
        for q, rows in got.items():
            want = sorted((float(np.sqrt((((x[q] - x[i]) / size) ** 2).sum())), i) for i in x if i != q)[:5]
            assert [r[1] for r in sorted(rows)] == [i for _, i in want]
            assert np.allclose([r[2] / size for r in sorted(rows)], [d for d, _ in want])
