"""Documents are numbered, wait and are put together in stretches; each still gets its own pieces."""

import random

from ragmill.llm import pieces


def test_documents_of_many_stretches_get_their_own_pieces(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abdeginorstu") for _ in range(n))
    shared = [word(9) for _ in range(40)]
    texts = [" ".join([rng.choice(shared), word(7), rng.choice(shared), *["y" * (210 + i % 3), word(230)][: i % 3]]) for i in range(2 * pieces.STRETCH + 50)]
    texts[7] = texts[8] = texts[299] = texts[9]
    rows = list(enumerate(texts)) + [(9, texts[9]), (1000, ""), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = pieces.encode(docs, common=5, check=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows) and all(r.round_trip for r in got)
    segment = pieces.long_units(pieces.MODEL)
    whole = {i: [x for u in pieces.split_units(t or "", pieces.unit_pattern()) for x in segment(u)] for i, t in rows}
    assert all(r.ids == whole[r.doc_id] for r in got)


def test_edges_are_spread_finer_than_shuffles(spark):
    assert pieces.spread(spark.range(3).selectExpr("cast(id as string) as unit")).rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
