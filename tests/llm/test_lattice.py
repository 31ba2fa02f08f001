"""Units that are not among the commonest are segmented where they are read, by the rules of lexicon()."""

import random

from ragmill.llm import pieces


def test_lattice_equals_lexicon_and_the_plain_path(spark):
    rng = random.Random(6)
    letters = "abcdeghinorstuäéñ 中あ\U0001f600ꙮ_1.,-"
    units = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 9, 14, 200]))) for _ in range(400)} | {" " * k for k in (1, 17, 60)})
    worst, first_byte = 4 * min(s for _, _, s in pieces.piece_scores()), pieces.byte_ids()
    ids, sizes = pieces.lattice(units, pieces.edge_table(), worst, first_byte)
    ends = sizes.cumsum().tolist()
    got = {u: ids[a:b].tolist() for u, a, b in zip(units, [0, *ends], ends)}
    segment = pieces.long_units(pieces.MODEL)
    assert len(ids) == ends[-1] and got == {u: segment(u) for u in units}
    assert got == {r.unit: r.ids for r in pieces.lexicon(spark.createDataFrame([(u,) for u in units], "unit string")).collect()}
    none = pieces.lattice([], pieces.edge_table(), worst, first_byte)
    assert none[0].size == none[1].size == 0


def test_documents_and_units_are_not_shuffled_for_their_pieces(spark):
    docs = spark.createDataFrame([(i, f"word{i} zqxv{i * 7919}") for i in range(20)], "doc_id long, text string")
    out = pieces.encode(docs, common=3, check=True)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("round_trip").count() == 20
