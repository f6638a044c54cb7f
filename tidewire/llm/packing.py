"""Bounded-space online packing of token streams into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import as_strings, materialise, release, shared_dir, slices
from tidewire.llm.tokens import PlainEncoder, WordEncoder, of_word_family

_BATCH_BYTES = 3 << 20
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """At most `slots` open windows of `size` tokens; pieces go best-fit, and full or emitted windows leave.

    A window holds (payload, length) pieces. `place` yields the windows that close.
    """

    def __init__(self, size: int, slots: int):
        self.size, self.slots = size, slots
        self.free: list[int] = []
        self.held: list[list] = []

    def _take(self, k: int) -> list:
        self.free[k], self.free[-1] = self.free[-1], self.free[k]
        self.held[k], self.held[-1] = self.held[-1], self.held[k]
        self.free.pop()
        return self.held.pop()

    def place(self, payload: object, length: int) -> Iterator[list]:
        best, room = -1, self.size + 1
        for k, f in enumerate(self.free):
            if length <= f < room:
                best, room = k, f
                if f == length:
                    break
        if best < 0:
            if len(self.free) >= self.slots:
                yield self._take(min(range(len(self.free)), key=self.free.__getitem__))
            self.free.append(self.size)
            self.held.append([])
            best = len(self.free) - 1
        self.held[best].append((payload, length))
        self.free[best] -= length
        if self.free[best] == 0:
            yield self._take(best)

    def drain(self) -> Iterator[list]:
        while self.free:
            yield self._take(len(self.free) - 1)


def _rows(windows: list[tuple[int, bool, list]], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    """Closed windows as piece rows."""
    cols: list[list] = [[] for _ in range(8)]
    for sequence, open_, pieces in windows:
        offset = 0
        for (doc, start, crc, total), length in pieces:
            for c, v in zip(cols, (doc, start, length, crc, total, sequence, offset, open_), strict=True):
                c.append(v)
            offset += length
    types = [key, *[pa.int64()] * 6, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def pack(docs: DataFrame, path: str, text: str = "text", end_id: int = 1, size: int = 2048, slots: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per piece of every document, placed gaplessly in windows of `size` tokens.

    Each task tokenises its rows, cuts whole windows off long documents and puts the rest best-fit into at most
    `slots` open windows; when none has room the fullest leaves. What is still open at a task's end, at most
    `slots` windows a task, is merged by the same rule over groups of `fan_in` tasks: at most fan_in * slots * size
    pieces, a million. Memory is bounded by the open windows and one batch, however long the input. Tokenizers of the
    word family are encoded through a cache, any other by its library. A null or empty text packs as its end id
    alone; repeated rows are packed each; null ids stay null; an empty table gives an empty result; other columns
    are ignored, whatever their names. sequence_id is unique, not consecutive.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in _PIECE.split(", ")), "open"]
    schema, family = f"doc_id {key}, {_PIECE}, open boolean", of_word_family(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder, windows, kind = WordEncoder(path) if family else PlainEncoder(path), Windows(size, slots), pa.int64()
        sequence = TaskContext.get().partitionId() << 36
        done: list = []
        for batch in batches:
            strings, kind = as_strings(batch.column(1)), batch.column(0).type
            for lo, hi in slices(strings, _BATCH_BYTES):
                ids, counts = encoder.flat_ids(strings.slice(lo, hi - lo))
                raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
                tail = int(end_id).to_bytes(4, "little")
                for doc, n in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), counts.tolist(), strict=True):
                    total = n + 1
                    for start in range(0, total, size):
                        stop = min(start + size, total)
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + min(stop, n))])
                        if stop == total:
                            crc = zlib.crc32(tail, crc)
                        for full in windows.place((doc, start, crc, total), stop - start):
                            done.append((sequence, False, full))
                            sequence += 1
                    at += n
                if done:
                    yield _rows(done, names, kind)
                    done = []
        done = [(sequence + k, True, w) for k, w in enumerate(windows.drain())]
        if done:
            yield _rows(done, names, kind)

    def merge(group: pa.Table) -> pa.Table:
        release()
        kind = group.schema.field("doc_id").type
        rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        filled: dict[int, list] = {}
        for r in rows:
            filled.setdefault(r["sequence_id"], []).append(((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]), r["length"]))
        windows, done = Windows(size, slots), []
        free = iter(sorted(filled))
        pieces = sorted((p for ps in filled.values() for p in ps), key=lambda p: -p[1])
        for payload, length in pieces:
            done += windows.place(payload, length)
        done += windows.drain()
        # Best-fit decreasing opens no more windows than came in, or the windows stay as they were.
        if len(done) > len(filled):
            done = list(filled.values())
        return pa.Table.from_batches([_rows([(next(free), False, w) for w in done], names, kind)])

    first = materialise(docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, schema), shared_dir(docs.sparkSession))
    part = F.shiftright("sequence_id", 36)
    left = first.where("open").groupBy(F.floor(part / fan_in).alias("task_group")).applyInArrow(merge, schema)
    return first.where("not open").unionByName(left).drop("open")
