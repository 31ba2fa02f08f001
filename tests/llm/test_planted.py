"""Passages of over 50 words planted in two documents each: cut from 400 bytes on, left whole below."""

import random

from ragmill.llm import repeats


def test_planted_passages_by_length(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, size = [], {}
    for n in (300, 399, 400, 450):
        for _ in range(5):
            passage = " ".join(word() for _ in range(200))[:n]
            assert len(passage.split()) > 50
            for _ in range(2):
                k = len(rows)
                size[k] = n
                rows.append((k, " ".join(word() for _ in range(100)) + chr(0x30 + k) + passage + chr(0x30 + k) + " ".join(word() for _ in range(100))))
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in out} == {k: n if n >= 400 else 0 for k, n in size.items()}
    # n_bytes is the size before the cut, so it tells nothing of what was removed
    assert {r.doc_id: r.n_bytes for r in out} == {k: len(t.encode()) for k, t in rows}
