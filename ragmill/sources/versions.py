"""Tables kept as versions: partitioned files that a manifest names, changed partition by partition, several tables at once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row for each partition of each table and folder that holds rows of it, and one without a name for the version itself.
ENTRY = "name string, part string, folder string, batch long, version long"


@dataclass(frozen=True)
class Staged:
    """Rows of a table that are written but not yet part of any version."""

    name: str
    folder: str
    rows: DataFrame


class Store:
    """Tables under one folder, in any file system that Spark writes to.

    Rows of a table lie in data/<table>/<folder>/part=<part>; manifest/version=<n> is one file that lists the folders
    which make up version n of every table. To change tables, their new rows are staged, then publish() writes the next
    manifest: whoever reads sees all changes of a version or none, and what a crash leaves behind is never listed.
    Partitions that a version doesn't touch keep their files. One writer at a time: of two that publish the same
    version, readers refuse both.

    The driver holds the manifest's rows of the partitions that a call reads, so partitions, not rows, are what must
    stay countable: a table of 100 TB has some 10^5 of a gigabyte.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def create(self) -> Store:
        """The store with an empty version 0."""
        self._write(self.spark.createDataFrame([], ENTRY), 0, None)
        return self

    def _write(self, entries: DataFrame, version: int, batch: int | None) -> None:
        own = self.spark.createDataFrame([(None, None, None, batch, version)], ENTRY)
        rows = entries.select("name", "part", "folder", "batch").withColumn("version", F.lit(version).cast("long")).unionByName(own)
        rows.drop("version").coalesce(1).write.mode("append").parquet(f"{self.root}/manifest/version={version}")

    def version(self) -> tuple[int, int | None]:
        """The newest version, and the last micro-batch that any version up to it holds."""
        own = self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifest").where("name is null")
        rows = own.orderBy(F.desc("version")).limit(2).collect()
        if len(rows) == 2 and rows[0].version == rows[1].version:
            raise RuntimeError(f"two writers published version {rows[0].version} of {self.root}")
        return rows[0].version, rows[0].batch

    def entries(self, version: int | None = None) -> DataFrame:
        version = self.version()[0] if version is None else version
        return self.spark.read.schema(ENTRY.removesuffix(", version long")).parquet(f"{self.root}/manifest/version={version}").where("name is not null")

    def read(self, name: str, parts: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Rows of a table; with `parts` (part), of those partitions only."""
        rows = self.entries(version).where(F.col("name") == name)
        if parts is not None:
            rows = rows.join(parts.select("part").distinct(), "part", "left_semi")
        paths = [f"{self.root}/data/{name}/{r.folder}/part={r.part}" for r in rows.orderBy("part", "folder").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def stage(self, name: str, rows: DataFrame, part: Column, spread: bool = True) -> Staged:
        """Write `rows` for a later version, parted by `part`; a partition's rows are first brought together."""
        folder = uuid.uuid4().hex
        fields = T.StructType.fromDDL(self.schemas[name]).fields
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in fields], part.alias("part"))
        (rows.repartition("part") if spread else rows).write.partitionBy("part").parquet(f"{self.root}/data/{name}/{folder}")
        whole = T.StructType([*fields, T.StructField("part", T.StringType())])
        return Staged(name, folder, self.spark.read.schema(whole).parquet(f"{self.root}/data/{name}/{folder}"))

    def publish(self, staged: list[Staged], gone: dict[str, DataFrame] | None = None, batch: int | None = None) -> int:
        """The next version: partitions `gone` (part, by table) are left out, staged rows added. Returns its number."""
        version, last = self.version()
        entries = self.entries(version)
        for name, parts in (gone or {}).items():
            out = parts.select(F.lit(name).alias("name"), "part").distinct()
            entries = entries.join(out, ["name", "part"], "left_anti")
        for s in staged:
            new = s.rows.select(F.lit(s.name).alias("name"), "part").distinct()
            entries = entries.unionByName(new.withColumns({"folder": F.lit(s.folder), "batch": F.lit(batch).cast("long")}))
        self._write(entries, version + 1, last if batch is None else batch)
        return version + 1


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("string")


def kb_part(buckets: int) -> Column:
    """Partition of a row with kb_id and document_id: its knowledge base, and one of `buckets` by its document."""
    return F.concat_ws("-", F.coalesce(F.col("kb_id").cast("string"), F.lit("none")), bucket("document_id", buckets))


def upsert(store: Store, name: str, new: DataFrame, keys: tuple[str, ...] = ("kb_id", "id"), buckets: int = 8) -> int:
    """Put rows of `new` in the place of those with the same keys, or add them; only their partitions are rewritten.

    `new` has the table's columns, among them kb_id, document_id and version; of several rows of a key that of the
    greatest version counts. A key's document mustn't change, as it decides on the partition.
    """
    from ..operators import vectors

    part = kb_part(buckets)
    touched = new.select(part.alias("part")).distinct()
    rows = vectors.upsert(store.read(name, touched), new, keys)
    return store.publish([store.stage(name, rows, part)], {name: touched})


def delete_documents(store: Store, names: list[str], gone: DataFrame, buckets: int = 8) -> int:
    """Delete the vectors of documents `gone` (kb_id, document_id) from all tables `names` at once."""
    part, staged = kb_part(buckets), []
    gone = gone.select("kb_id", "document_id").distinct()
    touched = gone.select(part.alias("part")).distinct()
    for name in names:
        left = store.read(name, touched).join(gone, ["kb_id", "document_id"], "left_anti")
        staged.append(store.stage(name, left, part))
    return store.publish(staged, dict.fromkeys(names, touched))


def drop_collection(store: Store, names: list[str], kb_id: int) -> int:
    """Leave a knowledge base out of tables `names`; no row is read or written."""
    entries = store.entries()
    gone = {n: entries.where((F.col("name") == n) & F.startswith("part", F.lit(f"{kb_id}-"))).select("part") for n in names}
    return store.publish([], gone)
