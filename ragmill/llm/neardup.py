"""Near-duplicate documents: SetSketch registers, banded, then estimated and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOW, U64, mix64, prefix_hashes, span_hashes, stored

#: Registers of a sketch and of one band. With 32 bands of 4, a pair of similarity 0.75 shares no band with a
#: probability of about (1 - 0.75^4)^32 = 4e-6.
REGISTERS, BAND = 128, 4
#: Base and rate of the registers. The base spaces them so closely that two agree about as often as the sets overlap
#: and that a band still has some 48 bits for disjoint sets, so buckets stay small however large the corpus.
BASE_B, RATE, TOP = 1.001, 20.0, 65_534


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes other than space and tab to carriage return."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    return edges[::2], edges[1::2]


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the word shingles of a whole text; A-Z are lower-cased, other letters stay.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    data = np.frombuffer((text or "").encode(), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    begin, end = word_spans(data)
    n = begin.size
    if n == 0:
        return np.zeros(0, U64)
    each = span_hashes(prefix_hashes(data), begin, end)
    k = min(words, n)
    out = np.zeros(n - k + 1, U64)
    for i in range(k):
        out *= U64(0x9FB21C651E98DF25)
        out += each[i : n - k + 1 + i]
    return np.unique(mix64(out + U64(k)))


_FACTORS = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_OFFSETS = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xE7037ED1A0B428DB))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Per set (none empty) and register the least of one 64-bit hash of every element; a union's are the lesser ones."""
    out, k = np.empty((len(sets), REGISTERS), U64), 0
    while k < len(sets):
        j, total = k, 0
        while j < len(sets) and (j == k or total + sets[j].size <= 32_768):  # so many that a block stays in cache
            total += sets[j].size
            j += 1
        every = np.concatenate(sets[k:j])
        starts = np.concatenate(([0], np.cumsum([x.size for x in sets[k : j - 1]]))).astype(np.int64)
        hashed = np.empty_like(every)
        for r in range(REGISTERS):
            np.bitwise_xor(every, _OFFSETS[r], out=hashed)
            np.multiply(hashed, _FACTORS[r], out=hashed)
            out[k:j, r] = np.minimum.reduceat(hashed, starts)
        k = j
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers: floor(1 - log_b x) of an exponential minimum x of rate RATE, held between 0 and TOP + 1."""
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE_B)), 0, TOP + 1).astype(np.uint16)


def bucket_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    bands = sketches.reshape(len(sketches), -1, BAND).astype(U64)
    key = np.arange(1, bands.shape[1] + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
    for i in range(BAND):
        key = mix64(key ^ (bands[:, :, i] * U64(0xD6E8FEB86659FD93) + U64(i + 1)))
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets by maximum likelihood from their registers and sizes together.

    With u and v the sizes' shares of their sum, a register of a is above that of b with probability u - v J and below
    with v - u J (to within the base's distance from 1), so they agree with probability J. Setting the derivative of the
    likelihood of all three counts to 0 leaves a quadratic equation for J.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    m = a.shape[1]
    same = m - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    half = same * (u * u + v * v) + v * v * above + u * u * below
    return (half - np.sqrt(np.maximum(half * half - 4 * m * same * (u * v) ** 2, 0))) / (2 * m * u * v)


def sketched(docs: DataFrame, words: int = 5, mark: Column | None = None) -> DataFrame:
    """doc_id (null as LOW), n shingles, key (digest of the set, null if empty) and sketch of every whole text; mark, if any, as row."""
    carried = [] if mark is None else ["row"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.iloc[at : at + 500]
                sets = [shingles(t, words) for t in batch["text"]]
                full = [i for i, x in enumerate(sets) if x.size]
                sketch, key = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, r in zip(full, registers(minima([sets[i] for i in full])), strict=True):
                        sketch[i], key[i] = r.tobytes(), hashlib.blake2b(sets[i], digest_size=16).digest()
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n": [x.size for x in sets], "key": key, "sketch": sketch} | {c: batch[c].to_numpy() for c in carried})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW).cast("long")).alias("doc_id"), "text", *[mark.alias(c) for c in carried])
    return rows.mapInPandas(run, "doc_id long, n long, key binary, sketch binary" + "".join(f", {c} long" for c in carried))


def banded(classes: DataFrame) -> DataFrame:
    """bucket, id: a row for each band of each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = bucket_keys(np.frombuffer(b"".join(batch["sketch"]), np.uint16).reshape(len(batch), -1))
                yield pd.DataFrame({"bucket": keys.view(np.int64).ravel(), "id": np.repeat(batch["id"].to_numpy(), keys.shape[1])})

    return classes.select("id", "sketch").mapInPandas(run, "bucket long, id long")


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose estimated similarity is at least `least`."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")).hint("merge")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                a, b = (np.frombuffer(b"".join(part[c]), np.uint16).reshape(len(part), -1) for c in ("s_a", "s_b"))
                keep = estimate(a, b, part["n_a"].to_numpy(float), part["n_b"].to_numpy(float)) >= least
                yield part.loc[keep, ["a", "b"]]

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def shingle_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """id and set (its hashes, ascending, as bytes) of each of `classes` (id, key, least); texts are shuffled once.

    A class's set is made from the texts of its least document; where that id has other texts too, the key tells them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                sets = [shingles(t, words).tobytes() for t in whole["text"].iloc[at : at + 200]]
                yield pd.DataFrame({"key": [hashlib.blake2b(x, digest_size=16).digest() for x in sets], "set": sets})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW).cast("long")).alias("doc_id"), "text")
    rows = rows.join(classes.select(F.col("least").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = rows.mapInPandas(run, "key binary, set binary").groupBy("key").agg(F.first("set").alias("set"))
    return sets.join(classes.select("key", "id").hint("merge"), "key").select("id", "set")


def alike(x: bytes, y: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
    small, large = (a, b) if a.size < b.size else (b, a)
    if not small.size or 100 * small.size < percent * large.size:
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), large.size - 1)] == small).sum())
    return 100 * both >= percent * (a.size + b.size - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets are alike. A set goes to its pairs by joins that adaptive execution may split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [alike(x, y, percent) for x, y in zip(batch["s_a"], batch["s_b"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s_{x}")).hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def block_links(held: pd.DataFrame, percent: int, least: float) -> list[tuple[int, int]]:
    """Links between rows of one block pair (bucket, side, id, component, n, sketch, set) that are of different components.

    Pairs on different sides are compared, or all if there is one side. A pair that shares an earlier band is settled
    in that band's bucket. Estimates come first; once a link joins two components, their other pairs need no look.
    """
    held = held.drop_duplicates("id")
    side, comp, ids = held["side"].to_numpy(), held["component"].tolist(), held["id"].to_numpy()
    sketches = np.frombuffer(b"".join(held["sketch"]), np.uint16).reshape(len(held), -1)
    keys, sets = bucket_keys(sketches), held["set"].tolist()
    n = np.array([len(x) // 8 for x in sets], float)
    band = int(np.flatnonzero(keys[0] == np.array([held["bucket"].iloc[0]], np.int64).view(U64)[0])[0])
    code = pd.factorize(held["component"])[0]
    both = side.min() != side.max()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    flat = np.concatenate([np.frombuffer(x, U64) for x in sets])
    starts = np.concatenate(([0], np.cumsum(n[:-1]))).astype(np.int64)
    names, codes = np.unique(flat, return_inverse=True)
    marked = np.zeros(names.size, bool)
    links = []
    for i in range(len(held) - 1):
        j = np.arange(i + 1, len(held))
        j = j[(code[j] != code[i]) & ((side[j] != side[i]) if both else True)]
        if band and j.size:
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
        if j.size:  # far fewer equal registers than any pair of interest has
            j = j[(sketches[j] == sketches[i]).mean(1) >= least - 0.2]
        if j.size:
            j = j[estimate(np.broadcast_to(sketches[i], (j.size, sketches.shape[1])), sketches[j], np.full(j.size, n[i]), n[j]) >= least]
        if 8 * j.size > len(held):  # many: one pass over all sets counts what each shares with this one
            own = codes[starts[i] : starts[i] + int(n[i])]
            marked[own] = True
            both_n = np.add.reduceat(marked[codes], starts, dtype=np.int64)[j]
            marked[own] = False
            j = j[100 * both_n >= percent * (n[i] + n[j] - both_n)]
        for k in j.tolist():
            a, b = root(comp[i]), root(comp[k])
            if a != b and alike(sets[i], sets[k], percent):
                parent[a] = b
                links.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
    return links


def settled(members: DataFrame, profiles: DataFrame, sets: DataFrame, percent: int, least: float, size: int = 512) -> DataFrame:
    """Links (a, b) between members of different components in the same bucket; members: bucket, id, component, own.

    A bucket's rows of the leader's component (own) needn't meet each other, so own blocks meet other blocks and other
    blocks each other. A task holds two blocks of about `size` rows at a time, however large the bucket; of what it
    compares it returns only verified links, at most one for each two components it joins.
    """
    counts = members.groupBy("bucket").agg(F.count_if(F.col("component") == F.col("own")).alias("k0"), F.count_if(F.col("component") != F.col("own")).alias("k1"))
    blocks = lambda k: F.greatest(F.lit(1), F.ceil(F.col(k) / size)).cast("int")
    rows = members.join(counts.select("bucket", blocks("k0").alias("n0"), blocks("k1").alias("n1")).hint("merge"), "bucket")
    is_own, spread = F.col("component") == F.col("own"), F.xxhash64("id")
    rows = rows.withColumn("block", F.pmod(spread, F.when(is_own, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    key = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    block, zero, one = F.col("block"), F.lit(0), F.lit(1)
    with_others = F.transform(F.sequence(zero, F.col("n1") - 1), lambda k: key(1, F.least(block, k), F.greatest(block, k), (k < block).cast("int")))
    as_own = F.transform(F.sequence(zero, F.col("n1") - 1), lambda j: key(0, block, j, zero))
    as_other = F.transform(F.sequence(zero, F.col("n0") - 1), lambda i: key(0, i, block, one))
    rows = rows.select("bucket", "id", "component", F.explode(F.when(is_own, as_own).otherwise(F.concat(as_other, with_others))).alias("to"))
    rows = rows.select("bucket", "id", "component", "to.*").join(profiles.select("id", "n", "sketch").hint("merge"), "id").join(sets.hint("merge"), "id")
    group = ["bucket", "kind", "i", "j"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000]
                rows = batch if rest is None else pd.concat([rest, batch])
                turns = np.flatnonzero((rows[group].iloc[1:].to_numpy() != rows[group].iloc[:-1].to_numpy()).any(1)) + 1
                bounds = [0, *turns.tolist()]
                found = [x for p, q in zip(bounds[:-1], bounds[1:], strict=True) for x in block_links(rows.iloc[p:q], percent, least)]
                yield pd.DataFrame(found, columns=["a", "b"])
                rest = rows.iloc[bounds[-1] :]
        if rest is not None and len(rest):
            yield pd.DataFrame(block_links(rest, percent, least), columns=["a", "b"])

    return rows.mapInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id in `links` (a, b).

    Each round a node takes the least label around it and then that label's own label, so paths shorten by half; every
    round is written out, and the driver sees only the number of labels that changed.
    """
    edges = stored(links.union(links.select("b", "a")).distinct(), "near-edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("c")), "near-labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("b"), "c").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        step = labels.join(around.hint("merge"), "id").select("id", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("c").alias("next")).hint("merge")
        moved = stored(step.join(jump, "c", "left").select("id", "was", F.least("c", "next").alias("c")), "near-labels")
        labels = moved.select("id", "c")
        if moved.where("was <> c").isEmpty():
            return labels.select("id", F.col("c").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, margin: float = 0.2, mark: Column | None = None) -> DataFrame:
    """Link documents (doc_id, text) whose shingle sets have 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept (it is that document);
    mark (a long of each row, to tell rows that share an id), if given, comes as row.

    Equal sets are one class, made by a pre-aggregated grouping, so copies never meet as pairs. A class is known by its
    set's digest and gets a number when it is written, as its least document may be that of other classes too. Classes that agree on
    a band share a bucket. First each bucket's least class, its leader, meets the others, which joins a large group
    of near copies into few components at a linear cost. Then the members of different components of a bucket meet
    each other, block by block (see settled()). Pairs are estimated from registers, dropped if `margin` (over five
    standard errors) below the limit, and else verified on full sets. So every pair that shares a bucket is verified,
    estimated to be far below, or joined by other links.

    A null text or one without words has no shingles and is linked with nothing. A null doc_id counts as the least.
    Repeated rows are copies of each other. Rows that share an id with other texts are linked each by its own text, and
    its component goes by the least id of the texts that it reaches. An empty table gives no rows. Other columns are ignored.
    """
    least = percent / 100 - margin
    rows = stored(sketched(docs, words, mark), "near-sketches")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    bands = banded(classes)
    shared = bands.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("high")).where("leader < high").select("bucket", "leader")
    shared = stored(shared, "near-shared")  # a join of plain shuffles is one whose skewed partitions can be split
    members = stored(bands.join(shared.hint("merge"), "bucket").distinct(), "near-members")
    profiles = stored(classes.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "near-profiles")
    sets = stored(shingle_sets(docs, profiles, words), "near-sets")

    pairs = stored(likely(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), profiles, least), "near-likely")
    links = stored(verified(pairs, sets, percent), "near-links")
    labels = components(links)
    placed = stored(members.join(labels.hint("merge"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"), (F.col("id") == F.col("leader")).alias("led")), "near-placed")
    # the leader has met everyone; what is left to settle are buckets whose other members are of two components or more
    mixed = placed.groupBy("bucket").agg(F.min(F.when(~F.col("led"), F.col("component"))).alias("low"), F.max(F.when(~F.col("led"), F.col("component"))).alias("high"), F.max(F.when(F.col("led"), F.col("component"))).alias("own"))
    mixed = stored(mixed.where("low < high").select("bucket", "own"), "near-mixed")
    left = placed.where(~F.col("led")).join(mixed.hint("merge"), "bucket").select("bucket", "id", "component", "own")
    more = stored(settled(stored(left, "near-left"), profiles, sets, percent, least), "near-links")
    if not more.isEmpty():
        labels = components(links.union(more))

    numbered = stored(labels.join(classes.select("id", "least").hint("merge"), "id"), "near-named")
    lowest = numbered.groupBy("component").agg(F.min("least").alias("lowest"))
    of_class = numbered.join(lowest.hint("merge"), "component").select("id", "lowest")
    of_class = classes.select("key", "id", "least").join(of_class.hint("merge"), "id", "left").select("key", F.coalesce("lowest", "least").alias("component"))
    out = rows.drop("sketch").join(of_class.hint("merge"), "key", "left")
    component = F.coalesce("component", "doc_id")
    named = lambda c: F.nullif(c, F.lit(LOW).cast("long"))
    return out.select(named(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), named(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"), *([] if mark is None else ["row"]))
