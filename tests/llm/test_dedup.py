"""Near-duplicates and repeated strings against brute force."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
from helpers import awkward, none_of
from hypothesis import given, settings
from hypothesis import strategies as st

from ragmill.llm import neardup, repeats


def brute_sets(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(rows):
    ids = sorted({i for i, _ in rows})
    sets = [(i, brute_sets(t)) for i, t in rows]
    label = {i: i for i in ids}
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"t{rng.randrange(900)}" for _ in range(rng.choice([4, 5, 9, 40, 120]))]
        for k in range(rng.choice([1, 3, 9])):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                ws[rng.randrange(len(ws))] = f"e{rng.randrange(900)}"
            rows.append((g * 100 + k, " ".join(w.upper() if rng.random() < 0.1 else w for w in ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert {i: got[i].n_shingles for i, _ in rows} == {i: len(brute_sets(t)) for i, t in rows}


def test_awkward_documents(spark):
    docs = awkward(spark)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[102].n_shingles == by[103].n_shingles == by[104].n_shingles == 0 and by[102].kept and by[104].kept
    assert by[101].component_id == 100 and by[105].n_shingles == 1 and by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none_of(docs)).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(5)
    for j in (0.2, 0.5, 0.75, 0.95):
        a, b = [], []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, int(1000 * j)).astype(np.uint64)
            rest = rng.integers(0, 1 << 63, 2 * ((1000 - both.size) // 2)).astype(np.uint64)
            a.append(np.concatenate([both, rest[::2]]))
            b.append(np.concatenate([both, rest[1::2]]))
        got = neardup.estimate(neardup.registers(neardup.minima(a)), neardup.registers(neardup.minima(b)), np.array([x.size for x in a], float), np.array([x.size for x in b], float))
        assert abs(got.mean() - j) < 0.03


def test_registers_of_a_union_are_the_greater_ones():
    a, b = np.arange(100, dtype=np.uint64) * np.uint64(7919), np.arange(50, 900, dtype=np.uint64) * np.uint64(104729)
    one, two, both = (neardup.registers(neardup.minima([x]))[0] for x in (a, b, np.union1d(a, b)))
    assert (np.maximum(one, two) == both).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=14), st.integers(0, 12), st.integers(1, 9))
def test_deep_shallow_sorts(strings, shallow, word):
    strings = strings + [strings[0][:30] + b"a" * 40, strings[0][:30] + b"a" * 39 + b"b"]
    order, lcps = repeats.deep_shallow(strings, list(range(len(strings))), shallow=shallow, word=word)
    assert [strings[i] for i in order] == sorted(strings)
    assert lcps[1:] == [len(os.path.commonprefix([strings[a], strings[b]])) for a, b in zip(order, order[1:], strict=False)]


def brute_repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[(i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest())] += 1
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdé ") for _ in range(60)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(parts)[rng.randint(0, 20) : rng.randint(30, 60)], "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows += [(1000, "a" * 300), (1001, "ab" * 200), (1002, None), (1003, rows[5][1]), (1004, rows[6][1] + "x"), (None, rows[7][1]), (7, rows[7][1]), (7, "another text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as start", "3 as h")
    for length, hot in ((20, 4096), (20, 3), (13, 4096)):
        got = Counter(tuple(r) for r in repeats.remove_repeats(df, length, hot=hot).collect())
        assert got == brute_repeats(rows, length)
    assert repeats.remove_repeats(none_of(df)).count() == 0


def test_kept_text_is_whole_characters(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, "a" + shared + "tail"), (2, shared[:-1] + "b")], "doc_id long, text string")
    assert all("�" not in r.text for r in repeats.remove_repeats(df, 21, keep_text=True).collect())


def test_links_of_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(5, a), (5, b), (7, near(a)), (8, near(b)), (9, "quite other words than those of any of the rows above")]
    for order in (rows, rows[::-1]):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]


def test_equal_rows_are_settled_once(spark):
    """Equal rows share their spans and contexts; results are those of one copy beside another."""
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh ij"), 6000))
    other = text[:2500] + "#" + text[2500:4000]
    docs = spark.createDataFrame([(1, text)] * 90 + [(1, other)], "doc_id long, text string")
    got = {(r.n_bytes, r.n_removed, r.n_spans): r["count"] for r in repeats.remove_repeats(docs).groupBy("n_bytes", "n_removed", "n_spans").count().collect()}
    assert got == {(6000, 6000, 1): 90, (4001, 4000, 2): 1}


def test_no_document_is_lost_by_its_key(spark):
    """Of 256 keys one ends in a zero byte: 300 pairs of texts, each of which repeats one of its own."""
    text = lambda i: "".join(random.Random(i).choices("abcdefgh ", k=30))
    rows = [(i, f"{i:04d}#" + text(i // 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 1):
        assert Counter(tuple(r) for r in repeats.remove_repeats(df, 20, hot=hot).collect()) == brute_repeats(rows, 20)


def test_large_ids_beside_null_ones(spark):
    rows = [((1 << 53) + 1, "a" * 30), (None, "b" * 9), ((1 << 63) - 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = repeats.remove_repeats(df, 20)
    assert dict(out.dtypes)["doc_id"] == "bigint" and Counter(tuple(r) for r in out.collect()) == brute_repeats(rows, 20)
