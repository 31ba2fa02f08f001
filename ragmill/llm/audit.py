"""How filters of documents interact, from part counters that an incremental stream keeps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import scratch, small_batches, stored

FILTERS = "ABCDE"
#: The bit of E, which no text has by itself.
COPY = 1 << FILTERS.index("E")
_STORE = "spark.sql.streaming.stateStore"
#: State on disk, as it has an entry for each distinct text; all stores of an executor share 128 MB of buffers, and none
#: lays out its files beforehand, as there are many small ones.
STORE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STORE}.rocksdb.writeBufferSizeMB": "1",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
}
COMBINED = "key binary, part string, good int, toxic int, mask int, least long, n_least long, n_more long, n_null long"
COMBINED_NAMES = [c.split()[0] for c in COMBINED.split(", ")]
STATE = "keys array<binary>, least array<long>, parts array<string>, goods array<int>, toxics array<int>, counts array<long>"
DELTAS = "part string, mask int, good int, toxic int, n long"


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a whole text fails: few words, few distinct words, capitals, marks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def stream_of(spark: SparkSession, path: str, batches: int = 8, texts: int = 1000) -> tuple[DataFrame, int]:
    """The files of a Parquet table as a stream of about `batches` micro-batches, and in how many groups its state is kept.

    A group holds about `texts` texts, by their hash. The path's last letter becomes a pattern, for a file or a folder.
    """
    given = spark.read.parquet(path)
    files = max(1, -(-len(given.inputFiles()) // batches))
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    return stream, max(1, given.count() // texts)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Narrow rows of documents: key, doc_id, part, mask, good, toxic. `labels` (id, good, toxic) has each id once.

    Null ids meet no label; salted, they don't meet in one task either.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), own_mask(F.col("text")).alias("mask"))
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(0).cast("long")), "_salt": F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.hash("key", "part"), F.lit(4096))).otherwise(0)})
    right = labels.select(F.col("id").alias("_id"), F.lit(0).alias("_salt"), "good", "toxic")
    out = rows.join(right.hint("merge"), ["_id", "_salt"], "left")
    return out.select("key", "doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def combined(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """Rows added up in their task, before any goes to its text's state: a text with many copies sends few rows a task.

    Of the copies with one part and labels: the least id, how many rows have it, a greater one, or none. At most `most`
    sums are held at once; what is sent in several rows is added up by the state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        frame = lambda: pd.DataFrame([(*k, *v) for k, v in held.items()], columns=COMBINED_NAMES).astype({"least": "Int64"})
        for batch in batches:
            ids = batch["doc_id"].astype("Int64").tolist()
            for key, i, part, mask, good, toxic in zip(batch["key"], ids, batch["part"], batch["mask"], batch["good"], batch["toxic"], strict=True):
                at = held.setdefault((bytes(key), part, good, toxic, mask), [None, 0, 0, 0])
                if i is pd.NA:
                    at[3] += 1
                elif at[0] is None or i < at[0]:
                    at[0], at[1], at[2] = i, 1, at[1] + at[2]
                else:
                    at[1 if i == at[0] else 2] += 1
            if len(held) >= most:
                yield frame()
                held.clear()
        if held:
            yield frame()

    return rows.mapInPandas(run, COMBINED)


def retracting(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of part counters as rows of a group's texts arrive: state is each text's least id, and its rows that have it.

    Rows of the least id don't fail E. When a smaller id comes, those of the id before were counted without E: their
    mask is taken back and counted again with E. Rows of greater ids never change again, so only the least is kept.
    """
    held: dict[bytes, tuple[int, dict]] = {}
    if state.exists:
        for key, least, part, good, toxic, n in zip(*state.get, strict=True):
            held.setdefault(bytes(key), (least, {}))[1][part, good, toxic] = n
    deltas: dict[tuple, int] = {}

    def add(part, good, toxic, mask, n):
        if n:
            deltas[part, mask, good, toxic] = deltas.get((part, mask, good, toxic), 0) + n

    for batch in batches:
        for key, part, good, toxic, mask, i, n_least, n_more, n_null in zip(*(batch[c].tolist() for c in COMBINED_NAMES), strict=True):
            add(part, good, toxic, mask, n_null)
            add(part, good, toxic, mask | COPY, n_more)
            if not n_least:
                continue
            least, rows = held.get(bytes(key), (None, {}))
            if least is None or i < least:
                for at, n in rows.items():
                    add(*at, mask, -n)
                    add(*at, mask | COPY, n)
                least, rows = int(i), {}
                held[bytes(key)] = least, rows
            if i == least:
                rows[part, good, toxic] = rows.get((part, good, toxic), 0) + n_least
            add(part, good, toxic, mask if i == least else mask | COPY, n_least)
    flat = [(key, least, *at, n) for key, (least, rows) in held.items() for at, n in rows.items()]
    state.update(tuple(map(list, zip(*flat, strict=True))) or ([],) * 6)
    rows = [(part, mask, good, toxic, n) for (part, mask, good, toxic), n in deltas.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DELTAS.split(", ")])


def part_counters(docs: DataFrame, labels: DataFrame, groups: int) -> DataFrame:
    """part, mask, n, good, toxic of a stream of documents, after all that is there has been read.

    Texts are keyed by their SHA-256 and go to the state as sums of narrow rows. State is kept for `groups` groups of
    keys by hash, as a call of Python for each text would cost milliseconds, and at least 16 of them to a partition; it
    and the progress lie in the shared folder. Each micro-batch adds its changes as a table of its own, at most one row for each part and mask, which a
    rerun of the batch replaces: the counters are the sums over all batches. `labels` (doc_id, quality, toxic) may
    repeat ids (any mark counts) or hold null ones (they mark nothing).
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    mark = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = stored(marks.agg(mark("quality").alias("good"), mark("toxic").alias("toxic")).where("good + toxic > 0"), "audit-labels")
    at, parts = scratch(spark, "audit"), "spark.sql.shuffle.partitions"
    settings = STORE | {parts: str(min(int(spark.conf.get(parts)), max(1, groups // 16)))}  # each is a store of its own
    before = {k: spark.conf.get(k, None) for k in settings}
    rows = combined(marked(docs.withColumn("doc_id", F.col("doc_id").cast("long")), marks))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group")
    deltas = rows.applyInPandasWithState(retracting, DELTAS, STATE, "append", GroupStateTimeout.NoTimeout)

    def put(df: DataFrame, batch: int) -> None:
        sums = df.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
        sums.write.mode("overwrite").parquet(f"{at}/changes/batch={batch}")

    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = deltas.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "part string, mask int, n long, good long, toxic long, batch int"
    if query.lastProgress is None:
        return spark.createDataFrame([], schema).drop("batch")
    changes = spark.read.schema(schema).parquet(f"{at}/changes")
    sums = changes.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return stored(sums.where("n <> 0"), "audit-counters")


def interactions(counters: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Everything follows from how many documents of a part fail which filters, 32 rows a part at most.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counters.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.split("filter_order", ""), lambda f: F.pow(F.lit(2), F.ascii(f) - ord("A")).cast("int"))
    earlier = F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b))
    rows = rows.withColumn("bits", bits).withColumns({"bit": F.element_at("bits", F.col("step")), "earlier": earlier})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, groups: int = 64) -> DataFrame:
    """The interactions of the five filters over a stream of documents (doc_id, text, lang) and a table of labels.

    A: under 100 words; B: under 80 distinct words in 100; C: over 10 capitals in 100 code points; D: any of #$%&*|;
    E: the text of a document with a smaller id, whether that was removed or not. Null texts are empty, null languages
    the part ''. A row with a null id has no smaller id and is none; rows of one id and text aren't copies of each
    other. Other columns are ignored. Without documents there are no parts and no rows.
    """
    return interactions(part_counters(docs, labels, groups))
