"""Helpers shared by the training-data operators: table paths, shared storage, folds and Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark touches the path, so any store Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    A folder is chosen here only where the session names none and runs in one process (tests); on a cluster a local
    folder would not be shared, so there the setting must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidewire-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a table to shared storage and read it back: lineage is cut, and lost executors lose nothing."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run, in shared storage; each is emptied once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.held = spark, shared_dir(spark), {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        out = materialise(df, path)
        self.held[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Empty the tables' folders, by an overwrite with no rows: any store that Spark writes will do."""
        for t in tables:
            path, _ = self.held.pop(id(t))
            self.spark.range(0).write.mode("overwrite").parquet(path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        keep = {id(t) for t in tables}
        self.drop(*(t for k, (_, t) in list(self.held.items()) if k not in keep))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def smallest_hashes(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n rows with the smallest hashes of a column; the further columns order rows that share one.

    Hashes are evenly spread, so where there are many more rows, those below a bound that some 1.2 n of them pass are
    sorted, and not every task's own n smallest. `df` is read up to three times: a written table.
    """
    hashed, total = F.xxhash64(by), df.count()
    if total > 2 * n:
        near = df.where(hashed < F.lit(int(-(2**63) + 2**64 * min(1.0, (1.2 * n + 1000) / total) - 1)))
        if near.count() >= n:
            df = near
    return df.orderBy(hashed, by, *ties).limit(n)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A null-free string array that starts at offset 0 of its own buffers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def utf8_view(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets into them, without a copy of the bytes."""
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, raw_offsets, raw = strings.buffers()
    offsets = np.frombuffer(raw_offsets, np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(strings: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    _, offsets = utf8_view(strings)
    lo, n = 0, len(strings)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def release() -> None:
    """Give memory that earlier tasks have freed back to the system, at a task's start: Python workers outlive their stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total, dtype=np.int64)
