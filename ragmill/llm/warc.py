"""A deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, scratch

RECORD = "page_id long, payload binary, payload_digest string, refers_to long, url string, record_type string"
MANIFEST = "shard int, part int, path string, records long, bytes long, sha256 string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def shard_bounds(ids: DataFrame, shards: int, id_col: str = "page_id", wanted: int = 20_000) -> list[int]:
    """At most shards - 1 ascending ids that part the rows evenly, the same on every run.

    The ids whose CRC-32 falls into a fixed residue are a sample that depends on the rows alone, not on their
    partitioning; about `wanted` of them reach the driver. The bounds only balance the files: every row is written.
    """
    n = ids.count()
    step = max(1, n // wanted)
    sample = np.array([r[0] for r in ids.where(F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % step == 0)).select(id_col).distinct().collect()], dtype=np.int64)
    sample.sort()
    if shards < 2 or not sample.size:
        return []
    return sorted({int(sample[sample.size * k // shards]) for k in range(1, shards)})


def range_number(col: Column, bounds: list[int]) -> Column:
    """How many of the ascending `bounds` are not above the value; null is 0."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return place(F.coalesce(col, F.lit(-(1 << 63)).cast("long")))


def mark_revisits(pages: DataFrame, min_bytes: int = 100) -> tuple[DataFrame, DataFrame]:
    """The rows to write, and the marks of those that are revisits: page_id, payload_digest, refers_to.

    Payloads are grouped by digest with map-side partial aggregation, so one payload under a third of all pages is one
    row per task before the shuffle. Marks carry no payload; the join that makes them may be split where it is skewed.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    long = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    marks = long.join(first.hint("merge"), "payload_digest").where("page_id is null or page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    return rows, marks


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{digest}'.encode()).hexdigest()[:32])}>"


def warc_record(row: dict, date: str) -> bytes:
    """One record in a gzip member of its own. A revisit keeps the HTTP header of its page, with the full length, and no payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'], row['payload_digest'])}", f"WARC-Date: {date}",
            "WARC-Target-URI: " + re.sub(r"[\r\n]+", "%0A", row["url"]), f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {record_id(row['refers_to'], row['payload_digest'])}", f"X-Refers-To-Page-ID: {row['refers_to']}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, compresslevel=6) as z:
        z.write("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return out.getvalue()


class _Roll:
    """Writes one shard's files: temporary name, then rename, then a manifest line."""

    def __init__(self, folder: str, shard: int, limit: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.shard, self.limit, self.part, self.stream = folder, shard, limit, -1, None
        self.lines: list[tuple] = []

    def write(self, data: bytes) -> None:
        if self.stream is not None and self.size + len(data) > self.limit:
            self.close()
        if self.stream is None:
            self.part += 1
            self.name = f"part-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temporary = f"{self.root}/_tmp-{uuid.uuid4().hex}-{self.name}"
            self.stream, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.stream.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.lines.append((self.shard, self.part, f"{self.folder}/{self.name}", self.records, self.size, self.sha.hexdigest()))
            self.stream = None


def write_warc(rows: DataFrame, marks: DataFrame, folder: str, bounds: list[int], roll_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write `rows` with their `marks` (see mark_revisits) as shards of rolled files under `folder`; returns the manifest, read back.

    Rows go to the shard of their page_id range and are sorted by page_id and digest, so the archives are the same
    bytes on every run. A file is written under a temporary name and renamed when whole; a retried or speculative
    task writes the same bytes to the same name, and only the manifest, which Spark commits at the end, says which
    files count. A shard never meets in memory: records stream into the open file, which rolls at `roll_bytes`.
    Payloads are shuffled once: marks go to the same ranges and sort before the rows they turn into revisits.
    """
    from pyarrow import fs

    filesystem, root = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(root)

    names = [c.split()[0] for c in MANIFEST.split(", ")]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, mark = None, None
        for batch in batches:
            for row in batch.to_dict("records"):
                row["page_id"], row["refers_to"] = (None if pd.isna(row[k]) else int(row[k]) for k in ("page_id", "refers_to"))
                key = row["shard"], row["page_id"], row["payload_digest"]
                if row["refers_to"] is not None:
                    mark = key, row["refers_to"]
                    continue
                row["record_type"] = "response"
                if mark is not None and mark[0] == key:
                    row |= {"record_type": "revisit", "refers_to": mark[1], "payload": b""}
                if roll is None or roll.shard != row["shard"]:
                    if roll is not None:
                        roll.close()
                        yield pd.DataFrame(roll.lines, columns=names)
                    roll = _Roll(folder, int(row["shard"]), roll_bytes)
                roll.write(warc_record(row, date))
        if roll is not None:
            roll.close()
            yield pd.DataFrame(roll.lines, columns=names)

    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    sharded = both.withColumn("shard", range_number(F.col("page_id"), bounds)).repartition(len(bounds) + 1, "shard")
    sharded = sharded.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "payload_digest", F.col("refers_to").asc_nulls_last(), "url")
    manifest = f"{folder}/manifest"
    sharded.mapInPandas(write, MANIFEST).write.parquet(manifest)
    return rows.sparkSession.read.schema(MANIFEST).parquet(manifest)


#: Bytes of an archive that a record's decompressor is given at once.
STEP = 1 << 16
HEADER = re.compile(rb"^([A-Za-z-]+): (.*?)\r?$", re.M)


def parse_archive(content: bytes) -> Iterator[tuple]:
    """Records of one archive, member by member: page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            piece = view[at : at + STEP]
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = {k.decode().lower(): v.decode() for k, v in HEADER.findall(head)}
        block = rest[: int(fields["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        number = lambda k: int(fields[k]) if k in fields else None
        stated = fields["warc-payload-digest"].removeprefix("sha256:")
        if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest differs in {fields['warc-record-id']}")
        if fields["warc-type"] == "revisit":
            length, digest, payload = int(re.search(rb"Content-Length: (\d+)", http)[1]), stated, None
        else:
            length, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if digest != stated:
                raise ValueError(f"payload digest differs in {fields['warc-record-id']}")
        yield number("x-page-id"), fields["warc-type"], length, digest, number("x-refers-to-page-id"), fields["warc-target-uri"], payload


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives that the manifest in `folder` names; temporary files of lost attempts are never read.

    Files are listed by their folder and held against the manifest by a join. Each is read whole by one task, so
    `roll_bytes` of the writer bounds its memory. Lengths and digests of responses are computed anew and held against the headers;
    revisits, which have no payload, take theirs from the header. Returns page_id, record_type, payload_bytes,
    payload_digest, refers_to, url and, if asked for, payload. No archives give no rows.
    """
    columns = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"][: 6 + with_payload]
    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string" + ", payload binary" * with_payload
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    named = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select(name)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(name, "content").join(few(named), "name", "left_semi")

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for row in parse_archive(content):
                    rows.append(row[: len(columns)])
                    held += len(row[-1] or b"") * with_payload
                    if held > 16 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return files.select("content").mapInPandas(parse, schema)


def warc_round_trip(pages: DataFrame, shard_rows: int = 1000, roll_bytes: int = 8 << 20, min_bytes: int = 100) -> DataFrame:
    """Write `pages` (page_id, url, html) as WARC archives in the shared folder and read them back.

    Of records with equal payloads of at least `min_bytes`, that with the smallest page_id is the response and the
    others are revisits of it; smaller payloads are all responses. A null html is an empty payload, a null url is
    empty. Rows with a null page_id are written without a page id; if another row has their payload they revisit it,
    else they are responses. Rows that repeat page_id and payload are all responses if that id is the smallest.
    """
    spark = pages.sparkSession
    ids = pages.select("page_id")
    bounds = shard_bounds(ids, max(1, -(-ids.count() // shard_rows)))
    folder = scratch(spark, "warc")
    write_warc(*mark_revisits(pages, min_bytes), folder, bounds, roll_bytes)
    return read_warc(spark, folder, with_payload=False)
