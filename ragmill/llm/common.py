"""Shared helpers: table access, scratch space on the cluster's shared folder, vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: Stands for a null id, as the least of all.
LOW = -(1 << 63)


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Rows of documents are long: Arrow batches of `rows` at most keep a Python worker's memory to a few megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table `name`; read only through Spark, so any store Spark knows will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under spark.checkpoint.dir; a local folder is set only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    small_batches(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """128 bits of a row's columns: rows that agree in them are taken to be equal."""
    half = lambda *salt: F.lpad(F.hex(F.xxhash64(*salt, *columns)), 16, "0")
    return F.unhex(F.concat(half(), half(F.lit(1))))


def met(rows: DataFrame, per: DataFrame, keys: list[str], size: str, hot: int = 4096) -> DataFrame:
    """`rows` joined by `keys` with `per`, which has one row for each key and in `size` how many rows the key has.

    Keys of more than `hot` rows are at most one row in `hot`; they are sent to all tasks, if few, so that no task
    gathers their rows. Both sides are stored tables.
    """
    large = stored(per.where(F.col(size) > hot), "hot-keys")
    rest = rows.join(few(large.select(*keys)), keys, "left_anti")
    return rows.join(few(large), keys).unionByName(rest.join(per.where(F.col(size) <= hot).hint("merge"), keys))


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df`, a stored table of narrow rows, as one side of a join: sent to all tasks if it has at most `rows`, else merged."""
    return df.hint("broadcast" if df.count() <= rows else "merge")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to 0..n-1 modulo 2^64, kept per Python worker and grown by doubling."""
    key, base = ("inv", INVERSE) if inverse else ("pow", BASE)
    have = _POWERS.get(key)
    if have is None or have.size < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _POWERS[key] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * BASE^j over j < i, modulo 2^64; a span's hash follows from two of them."""
    out = np.zeros(data.size + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(data.size), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of data[start:end] for arrays of spans."""
    inverse = powers(prefix.size, inverse=True)
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
