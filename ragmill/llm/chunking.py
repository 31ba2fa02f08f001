"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, prefix_hashes, span_hashes
from .warc import range_number, shard_bounds

#: One pseudo-random 32-bit word for each byte value, from a rule.
GEAR = (mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, sum of GEAR[byte i places back] << i over the last 32 bytes, modulo 2^32, by doubling the window."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if h.size > shift:
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))  # the right side is evaluated first
    return h


def chunk_ends(data: np.ndarray, least: int = 16, normal: int = 64, most: int = 256) -> np.ndarray:
    """End offsets of the chunks of `data`.

    Normalised chunking: a chunk has at least `least` bytes; up to `normal` a boundary needs two more zero bits in
    the gear hash than beyond it, which draws sizes towards `normal`; at `most` it ends in any case. A boundary depends
    on the last 32 bytes and on where the chunk began, so after an edit the boundaries fall back into step.
    """
    n = data.size
    if n == 0:
        return np.zeros(0, np.int64)
    h, bits = gear_hash(data), max(1, int(normal).bit_length() - 1)
    strict, loose = np.uint32(((1 << (bits + 1)) - 1) << (31 - bits)), np.uint32(((1 << (bits - 1)) - 1) << (33 - bits))
    at = np.flatnonzero((h & loose) == 0)
    hard = ((h[at] & strict) == 0).tolist()
    places, ends, begin, k, count = (at + 1).tolist(), [], 0, 0, at.size
    while n - begin > least:
        stop = begin + most
        end = min(stop, n)
        while k < count and places[k] - begin < least:
            k += 1
        j = k
        while j < count and (p := places[j]) < end:
            if hard[j] or p - begin >= normal:
                end = p
                break
            j += 1
        k = j
        ends.append(end)
        begin = end
    if begin < n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunk_set(data: bytes, **sizes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chunk digests, ascending, and the length of each."""
    raw = np.frombuffer(data, np.uint8)
    ends = chunk_ends(raw, **sizes)
    if not ends.size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    digests, first = np.unique(span_hashes(prefix_hashes(raw), starts, ends), return_index=True)
    return digests, (ends - starts)[first]


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of a's chunk bytes whose chunks b has too; two texts without chunks are alike, one without is not."""
    if not a[0].size or not b[0].size:
        return float(a[0].size == b[0].size)
    place = np.minimum(np.searchsorted(b[0], a[0]), b[0].size - 1)
    return float(a[1][b[0][place] == a[0]].sum() / a[1].sum())


def fingerprint_text(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """The set as text: each chunk's digest and length in hexadecimal, in order of digest."""
    return " ".join([f"{d:016x}:{n:x}" for d, n in zip(chunks[0].tolist(), chunks[1].tolist(), strict=True)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Chunk-set fingerprint of every whole text: doc_id, fingerprint. Null is the empty text; its fingerprint is ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["fingerprint"] = [fingerprint_text(chunk_set(t.encode(), **sizes)) for t in batch.pop("text")]
            yield batch

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fingerprint string")


LIKENESS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _likeness(doc: tuple, chunks: tuple, other: str, other_chunks: tuple, sizes: dict) -> tuple:
    doc_id, text = doc
    half = min(len(text) // 2, len(other))
    edited = (text[: len(text) - len(text) // 2] + other[:half]).encode()
    edited_chunks = chunk_set(edited, **sizes)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), fingerprint_text(chunks), fingerprint_text(edited_chunks), containment(chunks, edited_chunks), containment(chunks, other_chunks))


def next_and_edited(docs: DataFrame, rows_per_range: int = 2000, **sizes: int) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how much of it they and the next document contain.

    The next document is the next in descending doc_id; after the last comes the first. The edited text has the last
    floor(n / 2) code points replaced by as many (or all) of the next document's first ones. near_edited and near_next
    are the containment of the document's chunks in the other's, weighted by length.

    Texts are shuffled once, to ranges of doc_id. A range's bounds are ids that exist, so the row that the range above
    it needs as its last neighbour is known beforehand and is sent to both as a guest; the greatest id is the guest of
    the lowest range. No order over all rows is made in one task, and a task holds one document and its next.

    Null texts are empty. Null ids count as the smallest. Rows that share an id follow each other in order of text
    (repeated rows are then their own copies' next). A single document is its own next. An empty table gives no rows.
    Other columns are ignored.
    """
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low).cast("long")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select(F.nullif("key", F.lit(low)).alias("doc_id"))
    n = ids.count()
    bounds = shard_bounds(ids, max(1, n // rows_per_range), "doc_id")
    # range k has bounds[k-1] < key <= bounds[k]; a guest is the first row, by text, of the greatest id below or, for range 0, of all
    top = rows.agg(F.max("key")).first()[0]
    above = range_number(F.col("key"), bounds)  # bounds not above the key
    own = range_number(F.when(F.col("key") > low, F.col("key") - 1), bounds)
    guest = F.array_compact(F.array(F.when(above > own, own + 1), F.when(F.col("key") == top, F.lit(0))))
    to = F.concat(F.array(F.struct(own.alias("range"), F.lit(0).alias("guest"))), F.transform(guest, lambda r: F.struct(r.alias("range"), F.lit(1).alias("guest"))))
    dealt = rows.withColumn("to", to).select(F.explode("to").alias("to"), "key", "text").select("to.range", "to.guest", "key", "text")
    dealt = dealt.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "guest", F.desc("key"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, held_set = None, None, None
        for batch in batches:
            out = []
            for place, visits, doc_id, text in zip(batch["range"], batch["guest"], batch["key"], batch["text"], strict=True):
                if visits and (held is None or here != place):
                    continue  # a further guest, of the same id
                chunks = chunk_set(text.encode(), **sizes)
                if held is not None and here == place:
                    out.append(_likeness(held, held_set, text, chunks, sizes))
                here, held, held_set = place, None if visits else (doc_id, text), chunks
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LIKENESS.split(", ")])

    return dealt.mapInPandas(run, LIKENESS).withColumn("doc_id", F.nullif("doc_id", F.lit(low)))
