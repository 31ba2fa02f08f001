"""Secrets in texts, found by one combined deterministic automaton."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import SEPARATOR, compile_all, find


@dataclass(frozen=True)
class Rule:
    """Leftmost, longest, non-overlapping strings of `pattern` are matches; those that `kept` (if any) takes whole are secrets."""

    kind: str
    pattern: str
    kept: str | None = None


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
#: hex takes runs of 24 at once: a shorter run, being maximal, holds no longer one.
BASE = (
    Rule("assign", _ASSIGN + "+", _ASSIGN + "{6,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further credentials whose form alone marks them; `kept` holds the least length of each kind.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("code_host", "gh[opsur]_[A-Za-z0-9]+", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_host", "xox[abeprs]-[A-Za-z0-9-]+", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("pay_key", "[rs]k_live_[A-Za-z0-9]+", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!*-]+@[A-Za-z0-9]"),
)
RULES = BASE + MORE
SPANS = "array<struct<kind: string, start: int, end: int>>"


@lru_cache(maxsize=8)
def automata(rules: tuple[Rule, ...]) -> tuple:
    """Where matches start (texts read backwards), and how far one reaches from its start; compiled once in each worker."""
    starts = compile_all([r.pattern for r in rules], search=True, backwards=True)
    reach = compile_all([r.pattern for r in rules] + [r.kept or r.pattern for r in rules])
    return starts, reach, [row.tolist() for row in reach.table[:, reach.kinds]], reach.accepts.tolist()


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """For each text its secrets (kind, start, end) by start, then order of the rules; code points, end exclusive.

    One pass over all bytes of all texts, from their ends, marks where any rule has a match that starts; where two texts
    meet stands a byte that no match has. From the leftmost start on or after a rule's last match, the second automaton
    reads its longest match, so bytes outside matches are read once, whatever the number of rules.
    """
    starts, reach, step, accepts = automata(rules)
    coded = [t.encode() for t in texts]
    data = np.frombuffer(bytes([SEPARATOR]).join(coded), np.uint8)
    back, what = find(starts, data[::-1])
    at, what = data.size - 1 - back[::-1], what[::-1]
    begins = np.cumsum([0] + [len(c) + 1 for c in coded])
    owner = np.searchsorted(begins, at, "right") - 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for r, rule in enumerate(rules):
        mine = np.flatnonzero(what >> r & 1)
        places, docs, i = at[mine].tolist(), owner[mine].tolist(), 0
        while i < len(places):
            start, doc = places[i], docs[i]
            text, base = coded[doc], int(begins[doc])
            state, end, kept = reach.start, start, False
            for p in range(start - base, len(text)):
                state = step[state][text[p]]
                if state == reach.dead:
                    break
                if accepts[state] >> r & 1:
                    end, kept = base + p + 1, accepts[state] >> (len(rules) + r) & 1
            if kept:
                out[doc].append((rule.kind, start - base, end - base))
            i = bisect_left(places, max(end, start + 1), i)
    rank = {r.kind: i for i, r in enumerate(rules)}
    for doc, spans in enumerate(out):
        spans.sort(key=lambda s: (s[1], rank[s[0]]))
        if spans and not texts[doc].isascii():
            chars = np.concatenate(([0], np.cumsum((np.frombuffer(coded[doc], np.uint8) & 0xC0) != 0x80)))
            out[doc] = [(k, int(chars[s]), int(chars[e])) for k, s, e in spans]
    return out


def masked_text(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """`text` with each stretch that spans cover, overlapping ones together, replaced by `mask`."""
    parts, done = [], 0
    for _, start, end in spans:
        if start >= done:
            parts += [text[done:start], mask]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: str = "doc_id long", mask: str | None = None) -> DataFrame:
    """The `carry` columns (a schema of columns of `docs`) and spans, the secrets of each whole text by start, then kind.

    With `mask`, column masked is the text with that in place of its secrets. No shuffle; a task holds an Arrow batch of
    texts. Null texts are empty and have no spans; repeated rows are scanned as often as they come; an empty table gives
    no rows; other columns are ignored. Kinds are independent: spans of two kinds may overlap.
    """
    names = [c.split()[0] for c in carry.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("_text").tolist()
            found = scan_texts(texts, rules)
            batch["spans"] = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
            if mask is not None:
                batch["masked"] = [masked_text(t, s, mask) for t, s in zip(texts, found, strict=True)]
            yield batch

    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInPandas(run, f"{carry}, spans {SPANS}" + (", masked string" if mask is not None else ""))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
