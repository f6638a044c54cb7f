"""Versioned tables: numbered manifests as a commit log, and keys that are looked up by cells with Bloom filters.

A table's rows lie in cells: a part (a day, a month) and a bucket of the key's hash. A commit writes the rows of some
cells to a folder of its own, with a Bloom filter of each cell's keys, and then publishes the next manifest, which
says for each part which commits hold which buckets. Manifests are published by renaming a folder to the next number,
which fails where that number exists: of two writers, one is told to start again from the newer version. Readers list
the numbers and follow the highest, so they see a whole version; a crashed commit is a folder that no manifest names.
The file system has to rename folders atomically, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewire.operators.store import FILLED, enrich, first_per_key
from tidewire.storage import Files, emptied, materialise

#: Bits a key and probes of a cell's filter: one key in some two thousand is found where it is not, as a whole batch is asked of each cell.
BITS, PROBES = 16, 11
_CHUNK = 8192


class Conflict(RuntimeError):
    """Another writer has published the version that this one meant to; start again from it."""


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where a filter of so many bits holds each key (keys x probes), by double hashing."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h & np.uint64(0xFFFFFFFF))[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    """A Bloom filter of 64-bit hashes."""
    size = max(8, -(-len(hashes) * BITS // 8))
    flags = np.zeros(size * 8, bool)
    flags[_positions(hashes, size * 8).ravel().astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def maybe(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter may hold."""
    held = np.frombuffer(filter_, np.uint8)
    at = _positions(hashes, len(held) * 8).astype(np.int64)
    return ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


class Table:
    """A table at a path, with rows in parts and buckets; see the module. `part` and `key` name columns of its rows.

    A null part is a part of its own, named as Spark names it in a folder. Rows without a key are no row's copy: they
    are always added.
    """

    def __init__(self, spark: SparkSession, path: str, part: str, key: str = "url_hash", buckets: int = 16):
        self.spark, self.path, self.part, self.key, self.buckets, self.files = spark, path, part, key, buckets, Files(spark, path)

    # --- versions

    def version(self) -> int:
        """The highest published number; 0 before the first commit."""
        return max((int(n) for n in self.files.names("_log") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "cells": {}, "late": {}, "batches": {}, "closed": None, "schema": None, "buckets": self.buckets}
        return json.loads(self.files.read(f"_log/{version:012d}/manifest.json"))

    def commit(self, manifest: dict) -> int:
        """Publish the manifest as the version after the one that it was made from."""
        version = manifest["version"] + 1
        text = json.dumps(manifest | {"version": version, "id": uuid.uuid4().hex}, sort_keys=True)
        if not self.files.publish(f"_log/{version:012d}", "manifest.json", text):
            raise Conflict(f"version {version} of {self.path} was published by another writer")
        return version

    def expire(self, keep: int = 20) -> None:
        """Forget all but the last `keep` versions, and delete the folders of commits that none of those names.

        Folders are named by the version that they were made from; those of writers that may still publish stay.
        """
        versions = sorted(int(n) for n in self.files.names("_log") if n.isdigit())
        kept = versions[-keep:]
        named = {c for v in kept for kind in ("cells", "late") for held in self.manifest(v)[kind].values() for c in held}
        for v in versions[:-keep]:
            self.files.delete(f"_log/{v:012d}")
        for kind in ("data", "filters"):
            for name in self.files.names(kind):
                commit = name.removeprefix("commit=")
                if commit not in named and kept and int(commit.split("-")[0]) < kept[0]:
                    self.files.delete(f"{kind}/{name}")

    # --- reading

    def _load(self, manifest: dict, cells: list[tuple[str, str, int]], columns: list[str] | None = None) -> DataFrame:
        """Rows of (part, commit, bucket) cells, with their `commit` and `bucket`; only the cells' folders are listed."""
        schema = T.StructType.fromJson(manifest["schema"])
        full = T.StructType([*(f for f in schema.fields if f.name != self.part), T.StructField("commit", T.StringType()), schema[self.part], T.StructField("bucket", T.IntegerType())])
        wanted = [*(columns or schema.names), "commit", "bucket"]
        if not cells:
            return self.spark.createDataFrame([], full).select(*wanted)
        root = f"{self.path}/data"
        folders = sorted(f"{root}/commit={c}/{self.part}={p}/bucket={b}" for p, c, b in cells)
        return self.spark.read.schema(full).option("basePath", root).parquet(*folders).select(*wanted)

    @staticmethod
    def _cells(manifest: dict, kinds: tuple[str, ...]) -> list[tuple[str, str, int]]:
        return [(p, c, b) for kind in kinds for p, held in manifest[kind].items() for c, buckets in held.items() for b in buckets]

    def read(self, version: int | None = None, parts: list[str] | None = None, late: bool = False) -> DataFrame:
        """The rows of a version (the current one), of some parts or all; `late` adds rows that came after their part's close."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        cells = self._cells(manifest, ("cells", "late") if late else ("cells",))
        return self._load(manifest, [c for c in cells if parts is None or c[0] in parts]).drop("commit", "bucket")

    # --- writing

    def _folder(self) -> Column:
        """A row's part as folders name it."""
        return F.coalesce(F.col(self.part).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, manifest: dict) -> tuple[str, list[tuple[str, int, int]]]:
        """Write rows as a commit that no manifest names yet: its name and its cells (part, bucket, rows), with filters."""
        if {"commit", "bucket"} & set(rows.columns):
            raise ValueError("commit and bucket name a table's own folders")
        commit = f"{manifest['version']:012d}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/commit={commit}"
        rows.withColumn("bucket", self.bucket_of(F.col(self.key))).write.option("compression", "zstd").partitionBy(self.part, "bucket").parquet(folder)
        keys = self.spark.read.schema(T.StructType([rows.schema[self.key], rows.schema[self.part], T.StructField("bucket", T.IntegerType())])).parquet(folder)

        def build(group: pa.Table) -> pa.Table:
            own = group["hash"].to_numpy()
            return pa.table({"part": group["part"][:1], "bucket": group["bucket"][:1], "n": pa.array([len(own)], pa.int64()), "bits": pa.array([bloom(own)], pa.binary())})

        cells = keys.select(self._folder().alias("part"), "bucket", F.xxhash64(self.key).alias("hash")).groupBy("part", "bucket").applyInArrow(build, "part string, bucket int, n long, bits binary")
        cells.write.parquet(f"{self.path}/filters/commit={commit}")
        counts = self.spark.read.schema("part string, bucket int, n long").parquet(f"{self.path}/filters/commit={commit}").collect()  # a row a cell
        return commit, [tuple(r) for r in counts]

    def touched(self, manifest: dict, keys: DataFrame) -> list[tuple[str, str, int]]:
        """The cells (late ones too) whose filters may hold any of the keys: all that a lookup has to read."""
        cells = self._cells(manifest, ("cells", "late"))
        if not cells:
            return []
        commits = sorted({c for _, c, _ in cells})
        filters = self.spark.read.schema("part string, bucket int, n long, bits binary, commit string").option("basePath", f"{self.path}/filters").parquet(*(f"{self.path}/filters/commit={c}" for c in commits))
        asked = keys.where(F.col(self.key).isNotNull()).select(F.xxhash64(self.key).alias("hash"), self.bucket_of(F.col(self.key)).alias("bucket"))
        chunks = max(1, -(-asked.count() // (_CHUNK * self.buckets)))
        asked = asked.groupBy("bucket", F.pmod(F.shiftright("hash", 40), F.lit(chunks)).alias("chunk")).agg(F.collect_set("hash").alias("hashes"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [bool(maybe(bits.as_py(), np.array(hashes.as_py(), np.int64)).any()) for bits, hashes in zip(batch.column(3), batch.column(4), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit, pa.bool_())) for c in batch.columns[:3]], names=["part", "commit", "bucket"])

        found = filters.join(asked, "bucket").select("part", "commit", "bucket", "bits", "hashes").mapInArrow(probe, "part string, commit string, bucket int")
        hits = {tuple(r) for r in found.distinct().collect()}  # at most a row a cell
        return [c for c in cells if c in hits]

    def replace(self, rows: DataFrame, parts: list[str] | None = None, verify: bool = True, tries: int = 5) -> int:
        """Give parts new rows: those of `rows` and the listed ones, which may come away empty; other parts are neither read nor written.

        What was written is read back and compared by counts and an order-independent checksum before it is published.
        Returns the new version. A parts' replacement does not depend on what was there: it is published again on a conflict.
        """
        manifest = self.manifest()
        commit, cells = self.write(rows, manifest)
        if verify:
            written = self.spark.read.schema(T.StructType([*(f for f in rows.schema.fields if f.name != self.part), rows.schema[self.part]])).parquet(f"{self.path}/data/commit={commit}")
            expected, found = checksum(rows), checksum(written.select(*rows.columns))
            if expected != found:
                raise ValueError(f"{found} was written of {expected}")
        for _ in range(tries):
            for part in {*(parts or ()), *(p for p, _, _ in cells)}:
                manifest["cells"].pop(part, None)
            _add(manifest["cells"], commit, cells)
            manifest["schema"] = _merged(manifest["schema"], rows.schema)
            try:
                return self.commit(manifest)
            except Conflict:
                manifest = self.manifest()
        raise Conflict(f"{self.path} was published by others {tries} times")

    def upsert(self, batch: DataFrame, columns: tuple[str, ...] = FILLED, order: str = "seq", stream: str | None = None, batch_id: int | None = None, tries: int = 5) -> dict[str, int]:
        """Insert unseen keys (the first row of each by `order`), fill missing columns of known ones; never overwrite.

        A batch that the manifest says its stream has already brought changes nothing. Rows of a part that is closed
        are late: they are kept, and found again by key, but wait in the queue until the part is reopened. Only cells
        whose filters may hold a key of the batch are read, and only those are rewritten in which a column is filled.
        Returns the numbers of candidates, inserted and late rows, and of cells read and known.
        """
        with emptied(self.spark):
            staged = materialise(batch)
            for _ in range(tries):
                manifest = self.manifest()
                done = manifest["batches"].get(stream or "")
                if stream is not None and done and batch_id is not None and done["id"] >= batch_id:
                    return done["counts"] if done["id"] == batch_id else {"candidates": 0, "inserted": 0, "late": 0, "cells_read": 0, "cells": 0}
                try:
                    return self._upsert(manifest, staged, columns, order, stream, batch_id)
                except Conflict:
                    continue
        raise Conflict(f"{self.path} was published by others {tries} times")

    def _upsert(self, manifest: dict, staged: DataFrame, columns: tuple[str, ...], order: str, stream: str | None, batch_id: int | None) -> dict[str, int]:
        manifest["schema"] = _merged(manifest["schema"], staged.drop(order).schema)
        columns = tuple(c for c in columns if c in staged.columns)
        everything, read = self._cells(manifest, ("cells", "late")), self.touched(manifest, staged)
        named = staged.where(F.col(self.key).isNotNull())
        fresh = first_per_key(named, self.key, order)
        known = self._load(manifest, read, [self.key, self.part, *columns]).join(named.select(self.key).distinct(), self.key, "left_semi")
        known = materialise(known.withColumn("folder", self._folder()))
        fresh = fresh.join(known.select(self.key), self.key, "left_anti").select(*staged.columns).union(staged.where(F.col(self.key).isNull())).drop(order)
        filled = self._filled(known, named, columns)

        closed = manifest["closed"]
        late = F.lit(False) if closed is None else F.coalesce(F.col(self.part).cast("string") <= closed, F.lit(False))
        counts = {"candidates": staged.count(), "inserted": 0, "late": 0, "cells_read": len(read), "cells": len(everything)}
        for kind, rows in [("cells", fresh.where(~late)), ("late", fresh.where(late))][: 1 if closed is None else 2]:
            again = [c for c in filled if c in set(self._cells(manifest, (kind,)))]
            old = self._load(manifest, again).drop("commit", "bucket")
            commit, made = self.write(enrich(old, named, self.key, columns, order).unionByName(rows, allowMissingColumns=True), manifest)
            new = sum(n for _, _, n in made) - (old.count() if again else 0)
            counts |= {"inserted": counts["inserted"] + new} | ({"late": new} if kind == "late" else {})
            for part, other, bucket in again:
                manifest[kind][part][other].remove(bucket)
            _add(manifest[kind], commit, made)
        if stream is not None:
            manifest["batches"][stream] = {"id": batch_id, "counts": counts}
        self.commit(manifest)
        return counts

    def _filled(self, known: DataFrame, batch: DataFrame, columns: tuple[str, ...]) -> list[tuple[str, str, int]]:
        """The cells in which the batch fills a missing column of a known key."""
        if not columns:
            return []
        empty = lambda c: F.nullif(F.col(c), F.lit(""))
        given = batch.groupBy(self.key).agg(*[F.max(empty(c)).alias(f"__{c}") for c in columns])
        fills = reduce(or_, (empty(c).isNull() & F.col(f"__{c}").isNotNull() for c in columns))
        return [tuple(r) for r in known.join(given, self.key).where(fills).select("folder", "commit", "bucket").distinct().collect()]  # at most a row a cell

    def change(self, edit: Callable[[dict], None], tries: int = 5) -> int:
        """Publish a version that differs in its manifest only, over again where another writer was first."""
        for _ in range(tries):
            manifest = self.manifest()
            edit(manifest)
            try:
                return self.commit(manifest)
            except Conflict:
                continue
        raise Conflict(f"{self.path} was published by others {tries} times")

    # --- days that close

    def close(self, part: str) -> int:
        """Close all parts up to this one: what comes later for them waits in the queue."""
        return self.change(lambda m: m.update(closed=max(filter(None, (m["closed"], part)))))

    def queue(self) -> list[str]:
        """Closed parts that late rows wait for: they have to be clustered again."""
        return sorted(self.manifest()["late"])

    def reopen(self, part: str) -> int:
        """Let a part's late rows in: a change of the manifest, no row moves."""

        def move(manifest: dict) -> None:
            for commit, buckets in manifest["late"].pop(part, {}).items():
                manifest["cells"].setdefault(part, {})[commit] = buckets

        return self.change(move)

    def compact(self, least: int = 2) -> int:
        """Rewrite parts that more than `least` commits hold, each into one commit; other parts are not read."""
        manifest = self.manifest()
        parts = [p for p, held in manifest["cells"].items() if len(held) > least]
        if not parts:
            return manifest["version"]
        commit, cells = self.write(self._load(manifest, [c for c in self._cells(manifest, ("cells",)) if c[0] in parts]).drop("commit", "bucket"), manifest)
        for part in parts:
            manifest["cells"][part] = {}
        _add(manifest["cells"], commit, cells)
        return self.commit(manifest)


def _add(cells: dict, commit: str, made: list[tuple[str, int, int]]) -> None:
    for part, bucket, _ in sorted(made):
        cells.setdefault(part, {}).setdefault(commit, []).append(bucket)
    for part in list(cells):
        cells[part] = {c: b for c, b in cells[part].items() if b}
        if not cells[part]:
            del cells[part]


def _merged(held: dict | None, new: T.StructType) -> dict:
    """Columns by name: those of the table, then what a batch adds."""
    old = T.StructType.fromJson(held) if held else T.StructType([])
    return T.StructType([*old.fields, *(f for f in new.fields if f.name not in old.names)]).jsonValue()


def checksum(rows: DataFrame) -> tuple[int, int, int]:
    """Count, and the sum and the exclusive or of the rows' hashes: the same in any order, another if a row is lost or changed."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) if "map" in t else F.col(c) for c, t in rows.dtypes])
    got = rows.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first()
    return int(got[0]), int(got[1]), int(got[2])
