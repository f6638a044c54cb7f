"""Written intermediate tables: lineage is cut in shared storage, so plans stay small and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a folder is chosen here only where the session names none and runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidewire-{uuid.uuid4().hex}"


class Files:
    """The few file operations that a commit log needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, folder: str, name: str, text: str) -> bool:
        """A folder with one file, all at once; false where the folder is there already, which then stays as it is."""
        aside = f"{folder}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(f"{aside}/{name}"), False)
        stream.write(text.encode())
        stream.close()
        # A rename onto a folder that exists fails, or moves below it; whose text stands there tells who was first.
        won = not self._fs.exists(self._at(folder)) and self._fs.rename(self._at(aside), self._at(folder)) and self.read(f"{folder}/{name}") == text
        if not won:
            self.delete(aside)
        return won

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def emptied(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written within are deleted at the end: what comes out must not read them any more."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            Files(spark, path).delete("")


def materialise(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
