"""SentencePiece encoding and decoding as a relational lattice."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A unit is a run of spaces with what follows them, or a line feed. No piece of a model that splits at white space
#: reaches over a unit's end, so units are never cut, however long.
UNIT = r" *[^ \n]+| +|\n"
#: The same for models without a piece in which a letter is followed by another character: units end with letters too.
FINE = r" *(?:[\d_]|[^\w \n])*[^\W\d_]+| *(?:[\d_]|[^\w \n])+| +|\n"
#: Longer units, in characters, are segmented in their document's task by best_path(), in memory in proportion to them.
LONG = 200
#: So many documents at most are numbered and put together at once.
STRETCH = 125


@functools.cache
def piece_scores(model: str = MODEL) -> list[tuple[str, int, int]]:
    """(piece, id, score) of the model's ordinary pieces, from its file alone; a piece's word mark is a space here.

    A unigram model's scores are log probabilities and are kept. A BPE model has ranks instead, so a piece of rank r is
    given the Zipf probability 1 / ((r + 1) H) of its rank. Scores are in thousandths, rounded, so sums are exact.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
    scores = {i: sp.get_score(i) for i in plain if sp.get_score(i) > -1e8}
    # characters that no merge may use have an unusable score too; alone they rank after all others
    last = min(scores.values()) - 1
    scores |= {i: last for i in plain if i not in scores and len(sp.id_to_piece(i)) == 1}
    if last < -1000:  # ranks
        h = math.log(len(scores)) + 0.5772
        scores = {i: -math.log((1 - s) * h) for i, s in scores.items()}
    return [(sp.id_to_piece(i).replace("▁", " "), i, round(1000 * s)) for i, s in scores.items()]


@functools.cache
def useful(model: str = MODEL) -> list[tuple[str, int, int]]:
    """Those of piece_scores() that no sequence of others beats: the rest are in no best segmentation, so their edges needn't be made."""
    known = {p: s for p, _, s in piece_scores(model)}
    out = []
    for piece, i, own in piece_scores(model):
        best = [0] + [-(1 << 60)] * len(piece)
        for end in range(1, len(piece) + 1):
            for start in range(end):
                if end - start < len(piece) and (s := known.get(piece[start:end])) is not None:
                    best[end] = max(best[end], best[start] + s)
        if own >= best[-1]:
            out.append((piece, i, own))
    return out


def byte_ids(model: str = MODEL) -> int:
    """The id of byte 0; byte pieces follow each other. -1 if the model has none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    first = sp.piece_to_id("<0x00>")
    return first if sp.is_byte(first) else -1


@functools.cache
def unit_pattern(model: str = MODEL) -> re.Pattern:
    """The pattern of units: the finer they are, the fewer different ones there are."""
    return re.compile(UNIT if any(re.search(r"[^\W\d_][\W\d_]", p) for p, _, _ in useful(model)) else FINE)


def split_units(text: str, pattern: re.Pattern) -> list[str]:
    """The units of a text, word marks as spaces, with one before the first word; none of an empty text."""
    return pattern.findall(" " + text.replace("▁", " ")) if text else []


def best_path(unit: str, known: dict[str, tuple[int, int]], prefixes: set[str], worst: int) -> list[int]:
    """The best segmentation of a long unit, by the rules of lexicon(): ids, and -1 - its place for a character without a piece."""
    low = -(1 << 62)
    best, back, edge = array("q", [low]) * (len(unit) + 1), array("q", [0]) * (len(unit) + 1), array("q", [0]) * (len(unit) + 1)
    best[0] = 0
    for start in range(len(unit)):
        for end in range(start + 1, len(unit) + 1):
            part = unit[start:end]
            hit = known.get(part)
            if hit is None and end == start + 1:
                hit = (-1 - start, worst)
            if hit is not None and best[start] + hit[1] > best[end]:
                best[end], back[end], edge[end] = best[start] + hit[1], start, hit[0]
            if part not in prefixes:
                break
    path, end = [], len(unit)
    while end:
        path.append(edge[end])
        end = back[end]
    return path[::-1]


def reaches(scores: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    """The first two characters of the pieces, and how long the longest piece that begins with them is."""
    longest: dict[str, int] = {}
    for piece, _, _ in scores:
        if len(piece) > 1:
            longest[piece[:2]] = max(longest.get(piece[:2], 0), len(piece))
    return list(longest.items())


#: Places of the fields of a packed edge: score, 255 - start and id, from the highest bits down.
SCORE, START = 1 << 30, 1 << 22


def lexicon(distinct: DataFrame, model: str = MODEL) -> DataFrame:
    """unit, ids: the best segmentation of every unit of `distinct` (unit, of 1 to LONG characters; no repeats, spread by unit).

    Substrings, each no longer than the longest piece with its first two characters, are exploded and joined to the
    piece table; the edges of a unit are grouped (it is where its row was, so nothing moves) and a fold over them, in
    order of their ends, keeps the best edge into each end with its score. The path is read backwards from there. Ties
    go to the longer last piece. A character that no piece has is an edge of its UTF-8 bytes' pieces, worse than any
    other.

    An edge is a number, score * SCORE + (255 - start) * START + id, so that the greatest is the best one; scores are
    in thousandths and at most LONG of them add up, ids are below START.
    """
    spark = distinct.sparkSession
    scores = piece_scores(model)
    kept = useful(model)
    worst, first_byte, unknown = 4 * min(s for _, _, s in scores), byte_ids(model), START - 1
    pieces = spark.createDataFrame(pd.DataFrame(kept, columns=["piece", "id", "score"]), "piece string, id int, score long")
    reach = spark.createDataFrame(pd.DataFrame(reaches(kept), columns=["two", "reach"]), "two string, reach int")
    starts = distinct.select("unit", F.length("unit").alias("n"), F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start"))
    starts = starts.withColumn("two", F.substring("unit", F.col("start") + 1, F.lit(2))).join(F.broadcast(reach), "two", "left")
    last = F.least(F.col("start") + F.coalesce("reach", F.lit(1)), F.col("n"))
    parts = starts.select("unit", "start", F.explode(F.sequence(F.col("start") + 1, last)).alias("end"))
    parts = parts.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("end") - F.col("start")))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where((F.col("end") == F.col("start") + 1) | F.col("id").isNotNull())
    value = F.coalesce("score", F.lit(worst)).cast("long") * F.lit(SCORE) + (255 - F.col("start")) * F.lit(START) + F.coalesce("id", F.lit(unknown))
    # grouped by a hash first: comparing numbers sorts faster than comparing words
    grouped = edges.select("unit", F.struct("end", "start", value.alias("value")).alias("edge")).groupBy(F.xxhash64("unit").alias("h"), "unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    def step(best: Column, e: Column) -> Column:
        value = F.get(best, e["start"]).bitwiseAND(F.lit(-SCORE)) + e["value"]
        known = F.size(best)
        put = lambda before: F.concat(before, F.array(value))
        return F.when(e["end"] == known, put(best)).when(value > F.get(best, known - 1), put(F.slice(best, 1, known - 1))).otherwise(best)

    folded = grouped.select("unit", F.aggregate("edges", F.array(F.lit(0).cast("long")), step).alias("best"))

    def back(at: Column, place: Column) -> Column:
        value = F.get(F.col("best"), place)
        start = (255 - F.shiftright(value, 22).bitwiseAND(F.lit(255))).cast("int")
        id_ = value.bitwiseAND(F.lit(START - 1)).cast("int")
        # a character without a piece is in the path as -1 - its place
        path = F.concat(F.array(F.when(id_ == unknown, -1 - start).otherwise(id_)), at["path"])
        return F.when(at["at"] == place, F.struct(start.alias("at"), path.alias("path"))).otherwise(at)

    n = F.size("best") - 1
    ends = F.struct(n.alias("at"), F.array().cast("array<int>").alias("path"))
    found = folded.select("unit", F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), ends, back, lambda at: at["path"]).alias("path"))
    code = lambda x: F.hex(F.encode(F.substring("unit", -x, F.lit(1)), "UTF-8"))
    as_bytes = lambda x: F.transform(F.sequence(F.lit(0), (F.length(code(x)) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(code(x), i * 2 + 1, F.lit(2)), 16, 10).cast("int") + first_byte)
    spelt = F.flatten(F.transform("path", lambda x: F.when(x >= 0, F.array(x)).otherwise(as_bytes(x) if first_byte >= 0 else F.array(F.lit(0)))))
    return found.select("unit", F.when(F.exists("path", lambda x: x < 0), spelt).otherwise(F.col("path")).alias("ids"))


def decoder(model: str = MODEL) -> tuple[list[bytes], np.ndarray]:
    """Bytes of every piece id, word marks as spaces, for decode_ids()."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """The text of a list of piece ids: bytes joined, the mark before the first word dropped."""
    return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace").removeprefix(" ")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids). Null or empty ids give the empty text."""
    table = decoder(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [decode_ids(x, table) if x is not None else "" for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def recurring_units(rows: DataFrame, pattern: re.Pattern, held: int = 100_000) -> DataFrame:
    """unit, n: units of the texts that occur twice or more in a task's stretch of `held` distinct ones, and how often.

    It tells which units are worth sending to all tasks; what it leaves out is joined, so it decides no result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def often() -> pd.DataFrame:
            twice = [(u, n) for u, n in counts.items() if n > 1 and len(u) <= LONG]
            counts.clear()
            return pd.DataFrame(twice, columns=["unit", "n"])

        for batch in batches:
            for text in batch["text"]:
                counts.update(split_units(text, pattern))
                if len(counts) > held:
                    yield often()
        yield often()

    return rows.select("text").mapInPandas(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows by unit in four times as many partitions as shuffles have: edges take far more room than units, by which AQE would join partitions."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")


def common_units(rows: DataFrame, model: str, most: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """At most `most` of the commonest units by number, commonest first, with the ids of number i at ids[ends[i] : ends[i + 1]]."""
    counted = stored(recurring_units(rows, unit_pattern(model)), "piece-units")
    # how often the rarest of them occurs; counts of counts are few
    least, total = 1 << 62, 0
    for n, k in counted.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        if total + k > most:
            break
        least, total = n, total + k
    chosen = counted.where(F.col("n") >= least)
    often = dict(zip(*chosen.select("unit", "n").toArrow().to_pydict().values(), strict=True))
    found = lexicon(spread(chosen.select("unit")), model).toArrow()
    units = found["unit"].to_pylist()
    order = sorted(range(len(units)), key=lambda i: (-often[units[i]], units[i]))
    found = found.take(pa.array(order, pa.int64()))
    lists = found["ids"].combine_chunks()
    return {u: i for i, u in enumerate(found["unit"].to_pylist())}, lists.flatten().to_numpy().astype(np.int32), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64))


def numbered(units: list[str], known: dict[str, int], own: dict[str, int]) -> tuple[list[int], dict[str, int]]:
    """A text's units as numbers: known ones by `known`, others by `own`, from len(known) on, and long ones from -1 down.

    Units that neither has are added to `own`; the long ones are returned too. Both are numbered in the order they come up in.
    """
    found, long = list(map(known.get, units)), {}
    if None in found:
        for at, u in enumerate(units):
            if found[at] is None:
                found[at] = len(known) + own.setdefault(u, len(own)) if len(u) <= LONG else -1 - long.setdefault(u, len(long))
    return found, long


def edge_table(model: str = MODEL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The piece table for lattice(), by prefixes of pieces: keys, children, ids, scores.

    A prefix has a number, the empty one 0. keys, in order, are a prefix's number and the next character, children the
    longer prefix's number; ids (-1: no piece) and scores are by number.
    """
    number, kept = {"": 0}, useful(model)
    for piece, _, _ in kept:
        for k in range(1, len(piece) + 1):
            number.setdefault(piece[:k], len(number))
    ids, scores = np.full(len(number), -1, np.int64), np.zeros(len(number), np.int64)
    for piece, i, score in kept:
        ids[number[piece]], scores[number[piece]] = i, score
    prefixes = [x for x in number if x]
    keys = np.array([number[x[:-1]] << 21 | ord(x[-1]) for x in prefixes], np.int64)
    order = np.argsort(keys)
    return keys[order], np.array([number[x] for x in prefixes], np.int64)[order], ids, scores


def lattice(units: list[str], pieces: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], worst: int, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentations of units (of 1 to LONG characters) of a stretch, by the rules of lexicon(): all ids, and how many each unit has.

    The same relation as there, a column an array: parts of units joined to the piece table make edges (end, size, id,
    score); in order of their ends, longer ones first, these leave the best edge into each end, read backwards then.
    """
    keys, children, ids, scores = pieces
    chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    n = np.fromiter(map(len, units), np.int64, len(units))
    first = np.cumsum(n) - n
    place = np.arange(chars.size) - np.repeat(first, n)  # in its unit
    room = np.repeat(n, n) - place  # characters from here to the unit's end
    start, prefix, edges = np.arange(chars.size), np.zeros(chars.size, np.int64), []
    for size in range(1, LONG + 1):
        key = prefix << 21 | chars[start + size - 1]
        at = np.minimum(np.searchsorted(keys, key), keys.size - 1)
        hit = keys[at] == key
        if size == 1:  # every character is an edge
            child = np.where(hit, children[at], 0)
            edges.append((start, np.ones(start.size, np.int64), np.where(ids[child] >= 0, ids[child], -1 - chars), np.where(ids[child] >= 0, scores[child], worst)))
        start, prefix = start[hit], children[at[hit]]
        piece = (ids[prefix] >= 0) & (size > 1)
        edges.append((start[piece], np.full(piece.sum(), size), ids[prefix[piece]], scores[prefix[piece]]))
        more = room[start] > size
        start, prefix = start[more], prefix[more]
        if not start.size:
            break
    start, size, id_, score = map(np.concatenate, zip(*edges, strict=True))
    end = place[start] + size
    turn = end * (LONG + 1) - size  # by ends, and of these the longest first
    order = np.argsort(turn.astype(np.min_scalar_type(LONG * (LONG + 1))), kind="stable")
    start, size, id_, score, turn = start[order], size[order], id_[order], score[order], turn[order]
    # a unit has a node before its first character and one after each
    before = start + np.repeat(np.arange(n.size), n)[start]
    after = before + size
    best = np.full(chars.size + n.size, -(1 << 62), np.int64)
    best[first + np.arange(n.size)] = 0
    chosen = np.zeros(best.size, np.int64)
    bounds = [*np.flatnonzero(np.diff(turn, prepend=-1)).tolist(), turn.size]
    for a, b in zip(bounds, bounds[1:], strict=False):  # at most one edge of each into a node
        value = best[before[a:b]] + score[a:b]
        better = np.flatnonzero(value > best[after[a:b]])
        best[after[a:b][better]], chosen[after[a:b][better]] = value[better], better + a
    unit, node, path = np.arange(n.size), first + np.arange(n.size) + n, []
    begin = first + np.arange(n.size)
    while unit.size:
        edge = chosen[node]
        path.append((unit, id_[edge]))
        node = before[edge]
        on = node > begin[unit]
        unit, node = unit[on], node[on]
    if not path:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    step = np.repeat(np.arange(len(path)), [u.size for u, _ in path])
    unit, found = map(np.concatenate, zip(*path, strict=True))
    steps = np.bincount(unit, minlength=n.size)
    out = np.empty(unit.size, np.int64)
    out[(np.cumsum(steps) - 1)[unit] - step] = found
    lost = np.flatnonzero(out < 0)
    if not lost.size:
        return out.astype(np.int32), steps
    # characters without a piece: -1 - the character, spelt as bytes
    spelt = [[first_byte + b for b in chr(-1 - c).encode()] if first_byte >= 0 else [0] for c in out[lost].tolist()]
    many = np.ones(out.size, np.int64)
    many[lost] = [len(x) for x in spelt]
    sizes = np.bincount(np.repeat(np.arange(n.size), steps), many, n.size).astype(np.int64)
    out = np.repeat(out, many)
    out[out < 0] = [x for y in spelt for x in y]
    return out.astype(np.int32), sizes


def long_units(model: str) -> Callable[[str], list[int]]:
    """Segments one unit by best_path(), bytes spelt out."""
    scores, kept = piece_scores(model), useful(model)
    known = {p: (i, s) for p, i, s in kept}
    prefixes = {p[:k] for p in known for k in range(1, len(p))}
    worst, first_byte = 4 * min(s for _, _, s in scores), byte_ids(model)

    def run(unit: str) -> list[int]:
        spelt = lambda place: [first_byte + b for b in unit[place].encode()] if first_byte >= 0 else [0]
        return [j for i in best_path(unit, known, prefixes, worst) for j in ([i] if i >= 0 else spelt(-1 - i))]

    return run


def spelled(codes: np.ndarray, flat: np.ndarray, ends: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of unit numbers and how many each has: known units' from `flat`, the n-th other one's from `more`, by `sizes`."""
    n = ends.size - 1
    own = codes >= n
    begin, size = np.zeros(codes.size, np.int64), np.zeros(codes.size, np.int64)
    low, high = codes[~own], codes[own] - n
    begin[~own], size[~own] = ends[low], ends[low + 1] - ends[low]
    begin[own], size[own] = (np.cumsum(sizes) - sizes)[high], sizes[high]
    place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    of_own, out = np.repeat(own, size), np.empty(place.size, np.int32)
    out[of_own], out[~of_own] = more[place[of_own]], flat[place[~of_own]]
    return out, size


def encode(docs: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ("doc_id",), common: int = 200_000, check: bool = False) -> DataFrame:
    """The `carry` columns and ids: array<int>, the pieces of every whole text in order.

    With `check` also n_units and round_trip: whether the ids decode to the text (by its MD5).

    At most `common` of the commonest units are segmented by lexicon() and sent to the tasks. The other units of a
    stretch of documents are numbered together, each once, and segmented where they are, by lattice(); nothing is
    shuffled for them.

    Null and empty texts have no pieces. A literal word mark in a text decodes to a space, as in SentencePiece itself.
    Repeated rows are encoded alike. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)], text)
    names = [f"_{i}" for i in range(len(carry))]
    if check:
        rows = rows.withColumn("md5", F.unhex(F.md5("text")))
    index, flat, ends = common_units(rows, model, common)
    known, table = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast((flat, ends, decoder(model)))
    pattern = unit_pattern(model)
    worst, first_byte = 4 * min(s for _, _, s in piece_scores(model)), byte_ids(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (flat, ends, bytes_of), edges, segment = table.value, edge_table(model), None
        for whole in batches:
            for k in range(0, len(whole), STRETCH):
                batch = whole.slice(k, STRETCH)
                own: dict[str, int] = {}
                units, codes, ids = [], [], []
                for text in batch.column("text").to_pylist():
                    found, long = numbered(split_units(text, pattern), known.value, own)
                    if long:
                        segment = segment or long_units(model)
                        found = [x - len(ids) if x < 0 else x for x in found]
                        ids += [segment(u) for u in long]
                    units.append(len(found))
                    codes += found
                # long units are numbered after the stretch's own ones
                codes = np.array(codes, np.int64)
                codes = np.where(codes < 0, len(known.value) + len(own) - 1 - codes, codes)
                more, sizes = lattice(list(own), edges, worst, first_byte)
                more, sizes = np.concatenate([more, *[np.array(x, np.int32) for x in ids]]), np.append(sizes, [len(x) for x in ids]).astype(np.int64)
                ids, size = spelled(codes, flat, ends, more, sizes)
                last = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(units, dtype=np.int64))]
                out = [*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(last, pa.int32()), pa.array(ids))]
                if check:
                    parts = zip(last[:-1].tolist(), last[1:].tolist(), batch.column("md5").to_pylist(), strict=True)
                    same = [hashlib.md5(decode_ids(ids[a:b].tolist(), bytes_of).encode()).digest() == md5 for a, b, md5 in parts]
                    out += [pa.array(units, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, [*names, "ids", *["n_units", "round_trip"][: 2 * check]])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in names)
    extra = ", n_units long, round_trip boolean" if check else ""
    out = rows.mapInArrow(run, f"{fields}ids array<int>{extra}")
    return out.withColumnsRenamed({f"_{i}": c for i, c in enumerate(carry)})
