"""Cosine joins: sparse vectors by a prefix filter, dense ones by matrix products in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.functions import values


def packed(long: DataFrame, on: list[str], key: str, frequency: DataFrame, least: float) -> DataFrame:
    """(on, key, vector, norm, prefix): each vector as a map, and the rarest of its terms that any match has to share.

    Terms go from rare to frequent. Behind the prefix the vector's rest is shorter than `least` of its length, so that
    two vectors that share no term of both their prefixes cannot reach it: what they share lies in the rest of one.
    """
    cells = F.array_sort(F.collect_list(F.struct("df", "term", "weight")))
    rows = long.join(frequency, [*on, "term"]).groupBy(*on, key).agg(cells.alias("cells"))
    square = lambda c: c["weight"] * c["weight"]
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, c: a + square(c)))).where("norm > 0")
    limit = F.pow(F.lit(max(0.0, least - 1e-9)) * F.col("norm"), F.lit(2))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    fits = lambda a, c: F.struct((a["sum"] + square(c)).alias("sum"), (a["n"] + F.when(a["sum"] + square(c) < limit, 1).otherwise(0)).alias("n"))
    rest = F.aggregate(F.reverse("cells"), start, fits, lambda a: a["n"])
    vector = F.map_from_arrays(F.transform("cells", lambda c: c["term"]), F.transform("cells", lambda c: c["weight"]))
    prefix = F.slice(F.transform("cells", lambda c: c["term"]), F.lit(1), F.size("cells") - rest)
    return rows.select(*on, key, vector.alias("vector"), "norm", prefix.alias("prefix"))


def candidates(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs of packed vectors that share a term of both prefixes, once each."""
    own = lambda side, key: side.select(*on, key, F.explode("prefix").alias("term"))
    return own(left, left_id).join(own(right, right_id), [*on, "term"]).select(*on, left_id, right_id).distinct()


def similarity_join(left: DataFrame, right: DataFrame, on: list[str], least: float, left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """Pairs (left_id, right_id) of sparse long-form vectors (id, term, weight) whose cosine is at least `least`, over 0.

    Terms' frequencies are counted over both sides, so that frequent terms, whose pairs grow with the square of their
    frequency, are in few prefixes. Each candidate pair is met once and its cosine summed over the whole vectors. A
    vector has a term once; vectors without weight match nothing.
    """
    if least <= 0:
        raise ValueError("vectors that share nothing cannot be joined")
    frequency = left.select(*on, "term").unionByName(right.select(*on, "term")).groupBy(*on, "term").agg(F.count("*").alias("df"))
    a, b = packed(left, on, left_id, frequency, least), packed(right, on, right_id, frequency, least)
    met = candidates(a, b, on, left_id, right_id)
    named = lambda side, n: side.select(*on, left_id if n == 1 else right_id, F.col("vector").alias(f"v{n}"), F.col("norm").alias(f"n{n}"))
    pairs = met.join(named(a, 1), [*on, left_id]).join(named(b, 2), [*on, right_id])
    similarity = values.dot(F.col("v1"), F.col("v2")) / (F.col("n1") * F.col("n2"))
    return pairs.select(*on, left_id, right_id, similarity.alias("similarity")).where(F.col("similarity") >= least)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of an array column as unit vectors; rows without length are zeros."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r and len(r) == width:
            out[i] = r
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1.0)[:, None]


def _matches(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not a.size or not b.size or a.shape[1] != b.shape[1]:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    product = a @ b.T
    i, j = np.nonzero(product >= least)
    return i, j, product[i, j]


def dense_join(probes: DataFrame, vectors: DataFrame, least: float, probe_id: str, vector_id: str, vector: str = "vector", broadcast_bytes: int = 32 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """(probe_id, vector_id, similarity) of a stated set of probes against all dense vectors, cosine at least `least`.

    Similarities are products of blocks of unit vectors. Probes of at most `broadcast_bytes` go to every task, and the
    vectors stay where they are read; more probes than that are dealt with the vectors as pairs of blocks of about
    `block_bytes`, each in a task of its own. Null, empty or zero vectors match nothing; all vectors have one width.
    """
    if least <= 0:
        raise ValueError("vectors that share nothing cannot be joined")
    kinds = {c: side.schema[c].dataType.simpleString() for side, c in ((probes, probe_id), (vectors, vector_id))}
    schema = f"{probe_id} {kinds[probe_id]}, {vector_id} {kinds[vector_id]}, similarity double"
    probes, vectors = (side.where(F.size(vector) > 0).select(c, F.col(vector).cast("array<double>").alias("__v")) for side, c in ((probes, probe_id), (vectors, vector_id)))
    size = lambda side: side.agg(F.coalesce(F.sum(8 * F.size("__v")), F.lit(0))).first()[0]
    held = size(probes)

    if held <= broadcast_bytes:
        table = probes.toArrow()
        shared = probes.sparkSession.sparkContext.broadcast((table[probe_id].combine_chunks(), _unit(table["__v"].combine_chunks())))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, mine = shared.value
            for batch in batches:
                if len(ids):
                    i, j, similarity = _matches(mine, _unit(batch.column(1)), least)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), batch.column(0).take(pa.array(j)), pa.array(similarity)], names=[probe_id, vector_id, "similarity"])

        return vectors.mapInArrow(score, schema)

    rows, columns = (max(1, math.ceil(n / block_bytes)) for n in (held, size(vectors)))
    mine = probes.withColumn("a", F.pmod(F.xxhash64(probe_id), F.lit(rows))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<bigint>")))
    others = vectors.withColumn("b", F.pmod(F.xxhash64(vector_id), F.lit(columns))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<bigint>")))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda t: t["__v"].combine_chunks()
        i, j, similarity = _matches(_unit(flat(left)), _unit(flat(right)), least) if len(left) and len(right) else _matches(np.zeros((0, 0)), np.zeros((0, 0)), least)
        return pa.table({probe_id: left[probe_id].take(pa.array(i, pa.int64())), vector_id: right[vector_id].take(pa.array(j, pa.int64())), "similarity": pa.array(similarity)})

    return mine.groupBy("a", "b").cogroup(others.groupBy("a", "b")).applyInArrow(block, schema)
