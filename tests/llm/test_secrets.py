"""The combined automaton against Python's regular expressions, and secrets on awkward rows."""

import random
import re

import numpy as np
import pytest
from helpers import awkward, none_of

from ragmill.llm import automaton, secrets

BITS = ["token", "Token", "TOKEN=", "secret", "api_key", "apikey", "password", ":", "=", " ", "  ", '"', "'", "abcdef", "0123", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 3, "é", "漢", "\n", "eyJab", ".", "eyJ"]
BITS += ["ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890", "sk_live_", "aaaa1111aaaa1111", "http://", "u:p@h", "AIza", "_-9Zz" * 7]


def brute(text, rules=secrets.RULES):
    found = [(m.start(), i, r.kind, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text) if r.kept is None or re.fullmatch(r.kept, m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_spans_are_those_of_regular_expressions():
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", "token=token:abcdefgh", "token=" + "k" * 5, "f" * 50_000 + "g", "a" * 23, "x" * 50_000, "AKIAKIA" + "B" * 13 + "AKIA" + "C" * 16, "x eyJab.eyJcd.e-f_ eyJ.eyJa.b"]
    got = secrets.scan_texts(texts)
    assert got == [brute(t) for t in texts]
    assert {k for spans in got for k, _, _ in spans} == {r.kind for r in secrets.RULES}


@pytest.mark.parametrize("pattern", ["a(b|cd)*e?", "(?i:ab)+c{2,4}", "[^a-c]x{3}", "a?b?c", r"\x41+\.[a-]{0,2}z", "(ab|a)(bc|c)"])
def test_automata_accept_what_patterns_do(pattern):
    rng = random.Random(7)
    forth, back = (automaton.compile_all([pattern], backwards=b) for b in (False, True))
    for _ in range(2000):
        text = "".join(rng.choice("abcdexzA.-") for _ in range(rng.randint(1, 8)))
        for auto, data in ((forth, text.encode()), (back, text.encode()[::-1])):
            state = auto.start
            for b in data:
                state = auto.table[state, auto.kinds[b]]
            assert bool(auto.accepts[state]) == bool(re.fullmatch(pattern, text)), (pattern, text)


def test_states_are_minimal_and_lanes_do_not_matter():
    assert len(automaton.compile_all(["(a|b)(c|d)", "zz"]).table) == len(automaton.compile_all(["[ab][cd]", "z{2}"]).table) == 6
    with pytest.raises(ValueError):
        automaton.compile_all(["a*"])
    auto = automaton.compile_all(["a{700}b", "ca+"], search=True)
    data = np.frombuffer(("ab" * 300 + "a" * 3000 + "b" + "c" + "a" * 900 + "b" + "x" * 77).encode(), np.uint8)
    one = automaton.find(auto, data, lane=data.size)
    for lane, piece in ((1, 1 << 20), (7, 1 << 20), (64, 1000), (512, 513)):
        got = automaton.find(auto, data, lane=lane, piece=piece)
        assert all(np.array_equal(x, y) for x, y in zip(one, got, strict=True))


def test_secrets_of_awkward_rows(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(900, 'é "Secret": "abc123" then AKIA' + "Z" * 16)], "doc_id long, text string"), allowMissingColumns=True)
    got = secrets.scan(docs.withColumn("spans", docs.uid), carry="doc_id long, lang string", mask="<gone>").collect()
    assert len(got) == docs.count()
    row = next(r for r in got if r.doc_id == 900)
    assert [tuple(s) for s in row.spans] == [("assign", 3, 19), ("access", 26, 46)] and row.masked == 'é "<gone>" then <gone>'
    assert all(r.spans == [] for r in got if r.doc_id in (102, 103))
    assert secrets.scan(none_of(docs)).count() == 0
    assert secrets.masked_text("abcdef", [("x", 1, 3), ("y", 2, 4), ("z", 5, 6)], "#") == "a#e#"
