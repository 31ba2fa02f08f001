"""The filter audit against a plain count, with ids that arrive in the wrong order."""

import re
from itertools import permutations

import pandas as pd
import pytest
from conftest import rows_of
from helpers import awkward, none_of

from ragmill.llm import audit

LABELS = "doc_id long, quality int, toxic int, good int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(docs, labels):
    """Rows (part, order, step, kept, removed, redundant, unique, good lost, toxic lost, shapley), by applying every order."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        copy = any(i is not None and j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((lang or "", {f for f, x in zip("ABCDE", [*fails(text or ""), copy], strict=True) if x}, i in good, i in toxic))
    out = []
    for part in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in mine)
                left = [r for r in left if f not in r[1]]
                out.append([part, order, step, len(left), len(hit), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in hit), sum(r[3] for r in hit)])
    total = {}
    for r in out:
        key = r[0], r[1][r[2] - 1]
        total[key] = total.get(key, 0) + r[4]
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def given(got):
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect())


def prose(k):
    return " ".join(f"word{k}x{j}" for j in range(120))


DOCS = [(9, prose(1), "en"), (7, prose(1), "de"), (7, prose(1), "en"), (8, prose(1), None), (3, prose(2), "en"), (4, prose(2), "en"), (None, prose(1), "en"), (20, "AB " * 150, "de"), (21, "$ few", "en"), (22, None, None), (23, "", "")]
DOCS2 = [(2, prose(1), "de"), (7, prose(1), "en"), (None, prose(1), "de"), (1, prose(2), None), (3, prose(2), "en"), (19, "$ few", "de")]
DOCS3 = [(2, prose(1), "en"), (5, prose(1), "en"), (-4, prose(2), "de"), (24, prose(3) + " #", "en")]
MARKS = [(7, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (20, None, 1), (None, 1, 1), (21, 0, 0), (99, 1, 1)]


@pytest.mark.parametrize("parts", [[DOCS, DOCS2, DOCS3], [DOCS3, DOCS2, DOCS], [DOCS + DOCS2 + DOCS3]])
def test_smaller_ids_that_come_later_retract_counts(spark, tmp_path, parts):
    at = f"file://{tmp_path}/docs.parquet"
    for k, rows in enumerate(parts):
        frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, mask int")
        frame.coalesce(1).write.mode("append").parquet(at)
    labels = spark.createDataFrame([(*m, 1) for m in MARKS], LABELS)
    got = audit.audit(audit.stream_of(spark, at, 10)[0], labels, 3)
    assert given(got) == brute(DOCS + DOCS2 + DOCS3, MARKS)


def test_retractions_are_emitted():
    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    step = lambda state, *rows: [tuple(r) for df in audit.retracting((0,), iter([pd.DataFrame(list(rows), columns=audit.COMBINED_NAMES)]), state) for r in df.itertuples(index=False)]
    state = State()
    assert step(state, (b"k", "en", 1, 0, 2, 50, 1, 0, 0)) == [("en", 2, 1, 0, 1)]
    assert step(state, (b"k", "de", 0, 0, 2, 60, 1, 0, 0)) == [("de", 18, 0, 0, 1)] and state.get[1] == [50]
    assert sorted(step(state, (b"k", "de", 0, 1, 2, 10, 2, 1, 0))) == [("de", 2, 0, 1, 2), ("de", 18, 0, 1, 1), ("en", 2, 1, 0, -1), ("en", 18, 1, 0, 1)]
    assert step(state, (b"x", "de", 0, 0, 1, 3, 1, 0, 4)) == [("de", 1, 0, 0, 5)]
    assert state.get == ([b"k", b"x"], [10, 3], ["de", "de"], [0, 0], [1, 0], [2, 1])


def test_awkward_rows_and_none(spark, tmp_path):
    docs = awkward(spark)
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"file://{tmp_path}/a.parquet")
    got = audit.audit(audit.stream_of(spark, f"file://{tmp_path}/a.parquet", 2)[0], labels)
    assert given(got) == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], MARKS)
    none_of(docs).write.parquet(f"file://{tmp_path}/b.parquet")
    assert rows_of(audit.audit(audit.stream_of(spark, f"file://{tmp_path}/b.parquet", 2)[0], none_of(labels))) == []


def test_sums_of_a_task_do_not_depend_on_how_often_they_are_sent(spark):
    rows = [(bytes([i % 3]), i % 7 if i % 5 else None, "en" if i % 2 else "de", i % 3, 0, 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "key binary, doc_id long, part string, mask int, good int, toxic int").coalesce(1)
    least = audit.combined(frame).collect()
    assert len(least) == 6 and sum(r.n_least + r.n_more + r.n_null for r in least) == 200
    assert sum(r.n_null for r in least) == 40 and all(r.least == min(i for k, i, p, *_ in rows if k == r.key and p == r.part and i is not None) for r in least)
    assert sum(r.n_least + r.n_more + r.n_null for r in audit.combined(frame, most=1).collect()) == 200
