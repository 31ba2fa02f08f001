"""The ingestion stream and the versioned tables: crashes, redelivery, untouched files."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ragmill.operators import chunk
from ragmill.sources import versions
from ragmill.streaming import ingest, streams

DOC = "document_id long, kb_id int, file_type string, text string"


def given(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kind = F.when(F.col("doc_id") % 5 == 2, "exe").otherwise("MD")
    return docs.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 4).cast("int")).alias("kb_id"), kind.alias("file_type"), F.when(F.col("doc_id") % 50 > 0, F.col("text")).otherwise(" \n").alias("text"))


def flow(spark, at):
    return spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(at)


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


def holds_the_batch_result(store, docs):
    readable = docs.where(ingest.refused().isNull())
    chunks = chunk.two_level_windows(readable)
    columns = ["document_id", "parent_index", "chunk_index", "content", "token_count"]
    assert same(store.read("chunks").select(columns), chunks.select(columns))
    vecs = ingest.chunk_vectors(chunks, docs.where("kb_id is not null").select("document_id", "kb_id"))
    plain = lambda df: df.withColumn("cells", F.transform("cells", lambda c: F.struct(c["bucket"], F.round(c["weight"], 9)))).drop("part")
    assert same(plain(store.read("vectors")), plain(vecs))
    states = ingest.transitions(docs, chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count")))
    assert same(store.read("states").drop("batch"), states)
    assert {r.status for r in ingest.current(store.read("states")).select("status").distinct().collect()} == {"completed", "failed"}


def test_stream_equals_batch_though_it_crashes_between_its_tables(spark, tmp_path, monkeypatch):
    docs = given(spark)
    for k in range(3):
        docs.where(F.col("document_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/docs")
    store = ingest.open_store(spark, f"file://{tmp_path}/store")
    whole, crashes = versions.Store.stage, {("vectors", 0), ("states", 1)}

    def stage(self, name, *args, **kw):
        if (name, self.version()[0]) in crashes:
            crashes.remove((name, self.version()[0]))
            raise RuntimeError("lost power")
        return whole(self, name, *args, **kw)

    monkeypatch.setattr(versions.Store, "stage", stage)
    for expected in (0, 1):
        with pytest.raises(Exception, match="lost power"):
            ingest.ingest(flow(spark, f"file://{tmp_path}/docs"), store, f"file://{tmp_path}/state")
        assert store.version()[0] == expected
        ids = [{r.document_id for r in store.read(n).select("document_id").distinct().collect()} for n in ("chunks", "states")]
        assert ids[0] <= ids[1] and len(ids[1]) == docs.where(F.col("document_id") % 3 < expected).count()
    ingest.ingest(flow(spark, f"file://{tmp_path}/docs"), store, f"file://{tmp_path}/state")
    assert not crashes and store.version() == (3, 2)
    holds_the_batch_result(store, docs)


def test_documents_that_come_again(spark, tmp_path):
    rows = [(1, 5, "txt", "first words"), (1, 5, "txt", "first words"), (2, 5, "txt", "  "), (3, None, "exe", "x"), (None, 5, "txt", "no id"), (4, 6, None, "x")]
    again = [(1, 5, "txt", "other words"), (2, 5, "txt", "now with words"), (5, 5, "md", "fifth"), (3, None, "exe", "x")]
    store = ingest.open_store(spark, f"file://{tmp_path}/store")
    for k, part in enumerate((rows, again, [])):
        spark.createDataFrame(part, DOC).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/docs")
        ingest.ingest(flow(spark, f"file://{tmp_path}/docs"), store, f"file://{tmp_path}/state")
    got = {r.document_id: (r.status, r.chunk_count, r.message) for r in ingest.current(store.read("states")).collect()}
    assert got == {1: ("completed", 1, None), 2: ("completed", 1, None), 3: ("failed", None, "unsupported type"), 4: ("failed", None, "unsupported type"), 5: ("completed", 1, None)}
    assert sorted((r.document_id, r.content) for r in store.read("chunks").collect()) == [(1, "first words"), (2, "now with words"), (5, "fifth")]
    assert sorted(r.id for r in store.read("vectors").collect()) == ["doc-1-0", "doc-2-0", "doc-5-0"]
    seen = [r.status for r in store.read("states").where("document_id = 2").orderBy("batch", "seq").collect()]
    assert seen == ["uploading", "parsing", "failed", "uploading", "parsing", "chunking", "embedding", "completed"]


VEC = "kb_id int, id long, document_id long, embedding array<float>, version int"


def vector_store(spark, at):
    store = versions.Store(spark, at, {"text": VEC, "image": VEC}).create()
    rows = spark.createDataFrame([(k, 100 * k + i, i % 10, [float(i)], 0) for k in range(4) for i in range(40)], VEC)
    store.publish([store.stage(n, rows, versions.kb_part(4)) for n in ("text", "image")])
    return store, rows


def files(store, name):
    return {r.part: r.folder for r in store.entries().where(F.col("name") == name).collect()}


def test_changes_rewrite_only_what_they_touch(spark, tmp_path):
    store, rows = vector_store(spark, f"file://{tmp_path}/v")
    before, image = files(store, "text"), files(store, "image")
    new = spark.createDataFrame([(1, 103, 3, [9.0], 1), (1, 103, 3, [8.0], 2), (1, 777, 3, [7.0], 1), (9, 900, 3, [1.0], 1)], VEC)
    versions.upsert(store, "text", new, buckets=4)
    after = files(store, "text")
    changed = {p for p in after if before.get(p) != after[p]}
    assert len(changed) == 2 and {p.split("-")[0] for p in changed} == {"1", "9"} and files(store, "image") == image
    got = {(r.kb_id, r.id): r.embedding for r in store.read("text").collect()}
    assert len(got) == 162 and got[1, 103] == [8.0] and got[1, 777] == [7.0] and got[9, 900] == [1.0] and got[1, 102] == [2.0]
    versions.delete_documents(store, ["text", "image"], spark.createDataFrame([(2, 4), (2, 4), (2, None)], "kb_id int, document_id long"), buckets=4)
    assert store.read("text").where("kb_id = 2 and document_id = 4").isEmpty() and store.read("image").where("kb_id = 2 and document_id = 4").isEmpty()
    assert store.read("text").where("kb_id = 2").count() == 36 and sum(files(store, "image")[p] != f for p, f in image.items()) == 1
    last = files(store, "text")
    versions.drop_collection(store, ["text", "image"], 2)
    assert store.read("text").where("kb_id = 2").isEmpty() and all(last[p] == f for p, f in files(store, "text").items())
    assert same(store.read("text", version=1), rows)


def test_readers_refuse_two_writers(spark, tmp_path):
    store, _ = vector_store(spark, f"file://{tmp_path}/v")
    store._write(store.entries(), store.version()[0], None)
    with pytest.raises(RuntimeError, match="two writers"):
        store.read("text")


def test_updates_of_a_stream_keep_the_last_of_each_key(spark, tmp_path):
    for k in range(3):
        spark.range(4).selectExpr("id % 2 as k", f"id + {k} as x").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, x long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    sums = stream.groupBy("k").agg(F.sum("x").alias("s"))
    assert streams.drain(sums, "update").count() == 6
    assert sorted(tuple(r) for r in streams.drain(sums, "update", ("k",)).collect()) == [(0, 12), (1, 18)]
