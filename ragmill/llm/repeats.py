"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, met, mix64, powers, prefix_hashes, row_key, span_hashes, stored

BLOCK = 1 << 19


# ---- anchors: the places at which suffixes are sorted -----------------------------------------------------------------


def anchors(data: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of all `length`-byte windows of `data`, block by block so that a long text needs no more memory.

    A window's anchor is the leftmost of its (length // 2)-byte strings with the least hash. It depends on the window's
    bytes alone, so equal windows have equal strings at equal places: two windows can only be equal if their anchors
    are. Returns arrays: at (the anchor's place), back and reach (its windows start reach..back bytes before it),
    h (hash of the anchor's string) and c (hash of all bytes of these windows and of the anchor's place in them).
    """
    k = length // 2
    spread, n, parts = length - k + 1, data.size, []
    for begin in range(0, n - length + 1, BLOCK):
        part = data[begin : begin + BLOCK + length - 1]
        prefix = prefix_hashes(part)
        m = part.size - k + 1
        grams = mix64((prefix[k:] - prefix[:-k]) * powers(m, inverse=True))
        low = (grams & ~U64((1 << 20) - 1)) | np.arange(m, dtype=U64)  # the place breaks ties to the left
        span = 1
        while span < spread:
            step = min(span, spread - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        place = (low & U64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], place.size) - 1
        at = place[first]
        context = span_hashes(prefix, first, last + length)
        parts.append((at + begin, at - first, at - last, grams[at], mix64(context + (at - first).astype(U64) * U64(0x9E3779B97F4A7C15))))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2
    return dict(zip(("at", "back", "reach", "h", "c"), columns, strict=True))


def same(value: bytes, n: int) -> np.ndarray:
    """`value` n times; np.full() would take bytes for a text and drop zeros at their end."""
    out = np.empty(n, object)
    out.fill(value)
    return out


ANCHORS = "uid binary, at int, back int, reach int, h long, c long"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for uid, text in zip(batch["uid"], batch["text"], strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                if data.size >= length:
                    found = anchors(data, length)
                    held.append((same(uid, found["at"].size), *(found[c].astype(np.int32) for c in ("at", "back", "reach")), found["h"].view(np.int64), found["c"].view(np.int64)))
                    size += found["at"].size
                if size > 200_000:
                    yield pd.DataFrame(dict(zip(("uid", "at", "back", "reach", "h", "c"), map(np.concatenate, zip(*held, strict=True)), strict=True)))
                    held, size = [], 0
            if held:
                yield pd.DataFrame(dict(zip(("uid", "at", "back", "reach", "h", "c"), map(np.concatenate, zip(*held, strict=True)), strict=True)))

    return docs.select("uid", "text").mapInPandas(run, ANCHORS)


# ---- deep-shallow sorting ---------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, of which `start` bytes are known to agree."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:  # a[low:high] differs
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Orders strings that share a long prefix by their branching bytes alone; each insertion reads one string in full."""

    def __init__(self, strings: list[bytes], start: int):
        self.strings, self.start, self.root = strings, start, None

    @staticmethod
    def _branch(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        """Nodes are [depth, {byte: child}], leaves [None, [indices of equal strings]]."""
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blindly: bytes between the branching depths aren't looked at
            node = node[1].get(self._branch(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = common_prefix(s, other, self.start)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        parent, node, key = None, self.root, None
        while node[0] is not None and node[0] < depth:
            key = self._branch(s, node[0])
            parent, node = node, node[1][key]
        if node[0] == depth:
            node[1][self._branch(s, depth)] = [None, [i]]
            return
        fork = [depth, {self._branch(other, depth): node, self._branch(s, depth): [None, [i]]}]
        if parent is None:
            self.root = fork
        else:
            parent[1][key] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and each one's common prefix with the one before (the first: unset, 0)."""
        order, lcps, stack = [], [], [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if node[0] is None:
                for i in node[1]:
                    order.append(i)
                    lcps.append(lcp)
                    lcp = len(self.strings[i])
            else:
                keys = sorted(node[1])
                stack += [(node[1][k], node[0] if j else lcp) for j, k in reversed(list(enumerate(keys)))]
        return order, lcps


def deep_shallow(strings: list[bytes], members: list[int], shared: int = 0, shallow: int = 48, word: int = 8) -> tuple[list[int], list[int]]:
    """Sort `members` (indices into `strings`, which agree on `shared` bytes): the order, and common prefixes of neighbours.

    Multikey quicksort takes `word` bytes at a time as the character, down to `shallow` bytes beyond the shared ones;
    what is still undivided then has a long common prefix and is ordered by a blind trie.
    """
    order, lcps = [], []
    stack = [(members, shared)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            new, steps = group, [0]
        elif depth >= shared + shallow:
            trie = BlindTrie(strings, depth)
            for i in group:
                trie.add(i)
            new, steps = trie.ordered()
        else:
            keys = [strings[i][depth : depth + word] for i in group]
            pivot = sorted(keys[:: max(1, len(keys) // 7)])[min(3, (len(keys) - 1) // 2)] if len(keys) > 2 else keys[0]
            below = [i for i, x in zip(group, keys, strict=True) if x < pivot]
            equal = [i for i, x in zip(group, keys, strict=True) if x == pivot]
            above = [i for i, x in zip(group, keys, strict=True) if x > pivot]
            # a character cut short by the end of its string ends them all: they are equal
            if len(pivot) < word and len(equal) > 1:
                stack += [(g, depth) for g in (above,) if g]
                stack += [([i], depth + len(pivot)) for i in reversed(equal)]
                stack += [(g, depth) for g in (below,) if g]
            else:
                stack += [x for x in ((above, depth), (equal, depth + word), (below, depth)) if x[0]]
            continue
        if order:
            steps[0] = common_prefix(strings[order[-1]], strings[new[0]])
        order += new
        lcps += steps
    return order, lcps


def repeated_offsets(contexts: list[bytes], back: np.ndarray, reach: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each offset d, which rows' window that starts d bytes before the anchor equals that of another row of its group.

    `contexts` hold the bytes of all windows of an anchor, which lies back bytes into them. Suffixes from the anchors
    and, read backwards, prefixes before them are sorted; the window at d is repeated if another row shares both
    length - d bytes to the right and d to the left. Either relation is an interval of its order, so at each d two
    running counts name the classes and a pair of classes that occurs twice is a repeat. Yields (d, boolean per row).
    """
    n = len(contexts)
    right = [c[b:] for c, b in zip(contexts, back.tolist(), strict=True)]
    left = [c[:b][::-1] for c, b in zip(contexts, back.tolist(), strict=True)]
    bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    orders, steps = ([], []), ([], [])
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for side, strings in enumerate((right, left)):
            order, lcps = deep_shallow(strings, list(range(begin, end)))
            lcps[0] = -1
            orders[side].extend(order)
            steps[side].extend(lcps)
    (ro, lo), (rs, ls) = (np.array(x) for x in orders), (np.array(x) for x in steps)
    rclass, lclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(reach.min()), int(back.max()) + 1):
        mine = (reach <= d) & (d <= back)
        rclass[ro] = np.cumsum(rs < length - d)
        lclass[lo] = np.cumsum(ls < d)
        pair = (rclass * (n + 1) + lclass)[mine]
        if pair.size > 1:
            _, where, count = np.unique(pair, return_inverse=True, return_counts=True)
            out = np.zeros(n, bool)
            out[mine] = count[where] > 1
            yield d, out


# ---- the Spark job ----------------------------------------------------------------------------------------------------


def spans_of(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"uid": uid.astype(object), "start": start.astype(np.int64), "end": end.astype(np.int64)})


def sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """uid, start, end of repeated windows: contexts (h, uid, at, back, reach, n, context), groups of bounded size, by sorting."""

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        back, reach, single = rows["back"].to_numpy(np.int64), rows["reach"].to_numpy(np.int64), rows["n"].to_numpy() == 1
        uid, at = rows["uid"].to_numpy(), rows["at"].to_numpy(np.int64)
        out = []
        for d, repeated in repeated_offsets(list(rows["context"]), back, reach, rows["h"].to_numpy(), length):
            hit = repeated & single  # a context that occurs twice is removed as a whole already
            if hit.any():
                out.append((uid[hit], at[hit] - d, at[hit] - d + length))
        return spans_of(*map(np.concatenate, zip(*out, strict=True))) if out else spans_of(*[np.zeros(0)] * 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for whole in batches:
            for start in range(0, len(whole), 4000):
                batch = whole.iloc[start : start + 4000]
                held.append(batch)
                rows = pd.concat(held) if len(held) > 1 else batch
                tail = rows["h"].to_numpy() == rows["h"].iloc[-1]
                if tail.all():
                    held = [rows]
                    continue
                yield flush(rows[~tail])
                held = [rows[tail]]
        if held and len(rows := pd.concat(held)):
            yield flush(rows)

    parted = contexts.repartition("h").sortWithinPartitions("h")
    return parted.mapInPandas(run, "uid binary, start long, end long")


def counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for one task: each window becomes a digest, and equal digests are counted.

    Digests are pre-aggregated before the shuffle and spread by their own value, so no group meets in one place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), 500):
                out = []
                for r in whole.iloc[begin : begin + 500].itertuples():
                    starts = np.arange(0, r.back - r.reach + 1)
                    raw = np.frombuffer(r.context, np.uint8)
                    one, two = (span_hashes(prefix_hashes(x), starts, starts + length) for x in (raw, raw ^ np.uint8(0xA5)))
                    out.append((same(r.uid, starts.size), starts + (r.at - r.back), np.full(starts.size, r.n), one.view(np.int64), two.view(np.int64)))
                yield pd.DataFrame(dict(zip(("uid", "start", "n", "one", "two"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    windows = stored(contexts.mapInPandas(run, "uid binary, start long, n long, one long, two long"), "repeat-windows")
    twice = windows.groupBy("one", "two").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return windows.where("n = 1").join(twice.hint("merge"), ["one", "two"]).select("uid", "start", (F.col("start") + length).alias("end"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a set of [start, end) rows."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > top[:-1])))
    return list(zip(spans[new, 0].tolist(), np.append(top[new[1:] - 1], top[-1]).tolist(), strict=True))


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False, hot: int = 4096) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts elsewhere, in the same or any document.

    Texts (column `text`) are taken whole as UTF-8 bytes; strings are judged on the input, overlaps count and matches
    don't cross documents. Returns the `carry` columns, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    of what remains and, with keep_text, text: the remaining bytes, without those of characters cut in two.

    Suffixes are sorted at anchors (see anchors()), about two for each `length` bytes. An anchor whose string occurs
    once has no repeated window. Where all bytes around it occur again (as in copies), all its windows are repeats; a
    grouping finds these with partial aggregation, whatever their number. The rest, on the rims of repeated passages,
    are compared by deep-shallow sorting of one context each; groups of more than `hot` contexts by window digests.

    A null text is empty. Texts shorter than `length` lose nothing. Repeated rows are each other's copies. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    filled = F.coalesce("text", F.lit("")).alias("text")
    # numbers go through Python as text: among nulls pandas would make them doubles
    kinds_of = {c: docs.schema[c].dataType for c in carry}
    number = {c for c, kind in kinds_of.items() if kind.typeName() in ("byte", "short", "integer", "long", "float", "double")}
    named = [(F.col(c).cast("string") if c in number else F.col(c)).alias(f"_{i}") for i, c in enumerate(carry)]
    rows = docs.select(*named, filled).withColumn("uid", row_key(*[f"_{i}" for i in range(len(carry))], "text"))
    found = stored(anchor_rows(rows, length), "repeat-anchors")
    again = stored(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "repeat-again")
    found = stored(met(found, again, ["h"], "k").drop("k"), "repeat-recurring")
    kinds = stored(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at", "back", "reach")).alias("one")), "repeat-kinds")
    groups = kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("h", "m")
    whole = found.join(kinds.where("n > 1").select("h", "c").hint("merge"), ["h", "c"], "left_semi")
    # equal rows share a uid, and so their spans, which are listed once
    whole = whole.select("uid", (F.col("at") - F.col("back")).alias("start"), (F.col("at") - F.col("reach") + length).alias("end")).distinct()
    ask = met(kinds, stored(groups, "repeat-groups"), ["h"], "m").select("one.*", "h", "n", "m")
    empty = lambda kind: F.lit(None).cast(kind)
    notes = whole.select("uid", "start", "end", *[empty("long").alias(c) for c in ("h", "n", "m")], *[empty("int").alias(c) for c in ("at", "back", "reach")])
    notes = notes.unionByName(ask.select("uid", (F.col("at") - F.col("back")).cast("long").alias("start"), (F.col("at") - F.col("reach") + length).cast("long").alias("end"), "h", "n", "m", "at", "back", "reach"))
    notes = notes.groupBy("uid").agg(F.collect_list(F.struct("start", "end", "h", "n", "m", "at", "back", "reach")).alias("notes"))
    known = rows.join(notes.hint("merge"), "uid", "left")

    carried = [f for f in rows.schema.fields if f.name.startswith("_")]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried)
    names = [f.name for f in carried]
    finished = f"{fields}, {RESULT}" + ", text string" * keep_text

    def finish(values: list, data: bytes, spans: np.ndarray) -> list:
        runs = merged(spans)
        left = cut(data, runs)
        return [*values, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), *[left.decode(errors="ignore")] * keep_text]

    result = [c.split()[0] for c in finished.split(", ")]
    asked = ["h", "uid", "at", "back", "reach", "n", "m", "context"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of three kinds: finished documents, contexts to compare, and documents that wait for them."""
        for batch in batches:
            done, contexts, waiting = [], [], []
            for row in batch.to_dict("records"):
                data, values = row["text"].encode(), [row[c] for c in names]
                notes = row["notes"] if row["notes"] is not None else []
                spans = np.array([(x["start"], x["end"]) for x in notes if x["h"] is None], np.int64).reshape(-1, 2)
                if ask := [x for x in notes if x["h"] is not None]:
                    contexts += [(x["h"], row["uid"], x["at"], x["back"], x["reach"], x["n"], x["m"], data[x["start"] : x["end"]]) for x in ask]
                    runs = merged(spans)
                    waiting.append([*values, row["uid"], row["text"], [a for a, _ in runs], [b for _, b in runs]])
                else:
                    done.append(finish(values, data, spans))
            for kind, rows, columns in ((0, done, result), (1, contexts, asked), (2, waiting, [*names, "uid", "text", "starts", "ends"])):
                if rows:
                    by_name = dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)) | {"kind": [kind] * len(rows)}
                    yield pd.DataFrame({c: pd.Series(by_name.get(c, [None] * len(rows)), dtype=object) for c in every})

    schema = finished + ", text string" * (not keep_text) + ", h long, uid binary, at int, back int, reach int, n long, m long, context binary, starts array<long>, ends array<long>, kind int"
    every = [c.split()[0] for c in schema.split(", ")]
    parts = stored(known.mapInPandas(split, schema), "repeat-parts", "kind")
    contexts = parts.where("kind = 1").select(*asked).dropDuplicates(["h", "uid", "at", "back"])  # of equal rows one speaks for all; an anchor has two contexts where blocks meet
    contexts = stored(contexts, "repeat-contexts")
    few = sorted_repeats(contexts.where(F.col("m") <= hot), length)
    spans = few.unionByName(counted_repeats(contexts.where(F.col("m") > hot), length))
    late = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    waiting = parts.where("kind = 2").select(*names, "uid", "text", "starts", "ends").join(late.hint("merge"), "uid", "left")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                spans = list(zip(row["starts"], row["ends"], strict=True)) + [(x["start"], x["end"]) for x in (row["more"] if row["more"] is not None else [])]
                out.append(finish([row[c] for c in names], row["text"].encode(), np.array(spans, np.int64).reshape(-1, 2)))
            yield pd.DataFrame(out, columns=result, dtype=object)

    both = parts.where("kind = 0").select(*result).unionByName(waiting.mapInPandas(close, finished))
    back = [F.col(f"_{i}").cast(kinds_of[c]).alias(c) for i, c in enumerate(carry)]
    return both.select(*back, *[c for c in result if c not in names])
