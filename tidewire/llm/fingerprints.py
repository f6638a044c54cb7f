"""Document fingerprints: MinHash signatures over word shingles, the likeness of two, and near duplicates by their bands.

A signature holds, for each of many universal hash functions x -> (a x + b) mod 2^64, the least value over a text's
shingles; two texts agree in a place with the probability that a random shingle of both together is in both, their
Jaccard similarity. A fingerprint keeps 16 well-mixed bits of each place, as hexadecimal text.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import Scratch, as_strings, release, slices, text_of
from tidewire.llm.near import near_duplicates, shingle_sets
from tidewire.llm.words import mix

_BATCH_BYTES = 2 << 20
_BLOCK_BYTES = 1 << 16  # shingles for which all functions are worked off while they are in the cache
PLACES = 128


def functions(places: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of the hash functions; multipliers are odd, so that each function is a permutation."""
    drawn = np.random.default_rng(seed).integers(0, 2**64, (2, places), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def signatures(values: np.ndarray, sizes: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The least value of each function over each set of shingles (sets x places); a set without any gets the greatest number.

    `values` holds the sets' members one set after another, `sizes` how many each has.
    """
    a, b = functions(places)
    out = np.full((len(sizes), places), np.iinfo(np.uint32).max, np.uint32)
    begin = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes > 0)
    lo = 0
    while lo < len(some):  # some whole sets at a time
        hi = max(lo + 1, int(np.searchsorted(begin[some], begin[some[lo]] + _BLOCK_BYTES // 8, "right")) - 1)
        first, last = begin[some[lo]], begin[some[hi - 1]] + sizes[some[hi - 1]]
        block, at = values[first:last], begin[some[lo:hi]] - first
        for k in range(places):
            out[some[lo:hi], k] = np.minimum.reduceat((block * a[k] + b[k]) >> np.uint64(32), at)
        lo = hi
    return out


def sixteen_bits(signature: np.ndarray) -> np.ndarray:
    """What a fingerprint keeps of each place: minima are small numbers, so that their bits are mixed first."""
    places = np.arange(signature.shape[1], dtype=np.uint64)
    return (mix(signature.astype(np.uint64) + (places << np.uint64(32))) >> np.uint64(48)).astype(">u2")


def fingerprints_of(strings: pa.Array, shingle: int = 5, places: int = PLACES) -> np.ndarray:
    """Fingerprints of the texts (texts x places, 16 bits each), worked off in slices of some megabytes."""
    parts = [np.zeros((0, places), ">u2")]
    for lo, hi in slices(strings, _BATCH_BYTES):
        parts.append(sixteen_bits(signatures(*shingle_sets(strings.slice(lo, hi - lo), shingle), places)))
    return np.concatenate(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of places in which two fingerprints agree: an estimate of the Jaccard similarity, 0 to 1."""
    return (a == b).mean(axis=1)


def spelled(marks: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in marks], pa.string())


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 5, places: int = PLACES) -> DataFrame:
    """The kept columns and `fingerprint`, four hexadecimal digits a place, of every whole text.

    Equal texts have equal fingerprints, as have all texts of equal shingle sets. A text of fewer than `shingle` words
    is one shingle; texts without words (nulls too) share the fingerprint of the empty set. An empty table gives an
    empty result; other columns play no part. A column named fingerprint cannot be kept.
    """
    if "fingerprint" in keep:
        raise ValueError("a kept column must not be named as the result is")
    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            marks = fingerprints_of(as_strings(batch.column(len(keep))), shingle, places)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], spelled(marks)], names=[*keep, "fingerprint"])

    return held.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]), "fingerprint string"]))


def banded_duplicates(docs: DataFrame, text: str = "text", bands: int = 24, rows: int = 4, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, copy_id, class_id and n_links of every document: signatures of `bands` bands of `rows` minima, joined band by
    band, with every candidate pair verified by its exact Jaccard similarity.

    Bands are trees of one level of `near_duplicates`, which says what nulls, empty texts, ties and repeated rows
    give; a pair at the threshold shares a band with probability 1 - (1 - threshold^rows)^bands, 0.999997 here.
    """
    return near_duplicates(docs, text, shingle, threshold, trees=bands, deepest=rows, recall=0.0)


def in_order(docs: DataFrame, text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """block, tail, doc_id, mark and text: the documents in blocks that follow one another by id, in order within a partition.

    Every block ends with a tail, a copy of the next block's first document (the last block's: of the first one), so
    that each document is followed by the next one and no block waits for another. Blocks are ranges of ids (missing
    ids first, equal ids by a hash of their text) of about `block_bytes`; a row of each is all that the driver holds.
    """
    body = docs.select("doc_id", F.xxhash64(text_of(text)).alias("mark"), text_of(text).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.keep(body.select("doc_id", "mark", F.octet_length("text").alias("bytes")))
    blocks = max(1, math.ceil((narrow.agg(F.sum("bytes")).first()[0] or 0) / block_bytes))
    ranges = narrow.repartitionByRange(blocks, F.col("doc_id").asc_nulls_first(), "mark").withColumn("range", F.spark_partition_id())
    least = ranges.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark")).alias("least")).collect()
    scratch.drop(narrow)
    key = lambda known, doc_id, mark: (known, doc_id if known else 0, mark)
    firsts = sorted(key(*r.least) for r in least)

    @F.pandas_udf("block int, first boolean")
    def place(known: pd.Series, doc_id: pd.Series, mark: pd.Series) -> pd.DataFrame:
        keys = [key(*k) for k in zip(known.tolist(), doc_id.tolist(), mark.tolist(), strict=True)]
        at = [bisect_right(firsts, k) - 1 for k in keys]
        return pd.DataFrame({"block": pd.Series(at, dtype="int32"), "first": [firsts[b] == k for b, k in zip(at, keys, strict=True)]})

    number = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    placed = body.withColumn("place", place(F.col("doc_id").isNotNull(), number, F.col("mark")))
    own = F.struct(F.col("place.block").alias("block"), F.lit(False).alias("tail"))
    ahead = F.struct(F.pmod(F.col("place.block") - 1, F.lit(max(1, len(firsts)))).cast("int").alias("block"), F.lit(True).alias("tail"))
    dealt = placed.select(F.explode(F.when(F.col("place.first"), F.array(own, ahead)).otherwise(F.array(own))).alias("to"), "doc_id", "mark", "text")
    dealt = dealt.select("to.block", "to.tail", "doc_id", "mark", "text")
    return dealt.repartition("block").sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), "mark")


def edited_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 5, places: int = PLACES) -> DataFrame:
    """Each document's fingerprint beside that of its edited text: its last quarter (n_chars div 4 code points) gives way
    to the first as many code points of the next document by ascending id, or all if it has fewer; after the last
    document comes the first.

    doc_id, n_chars, edited_sha256 (of the edited text's UTF-8), fingerprint, edited_fingerprint, near_edited and
    near_next, the likeness of the fingerprint to the edited text's and to the next document's; a row per row. A null
    text counts as empty; a table of one row is its own next; rows of equal id follow one another by a hash of their
    text, rows without an id come first; an empty table gives an empty result; other columns play no part. Texts of
    any length are read whole; a task holds a batch of rows and the row before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        before = None
        for whole in batches:
            strings = as_strings(whole.column(4))
            for lo, hi in slices(strings, _BATCH_BYTES):
                batch = whole.slice(lo, hi - lo)
                texts, marks = strings.slice(lo, hi - lo).to_pylist(), fingerprints_of(strings.slice(lo, hi - lo), shingle, places)
                if before is not None:
                    batch, texts, marks = pa.concat_batches([before[0], batch]), [before[1], *texts], np.concatenate([before[2], marks])
                own = [i for i, tail in enumerate(batch.column(1).to_pylist()[:-1]) if not tail]
                edited = pa.array([texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in own], pa.string())
                other = fingerprints_of(edited, shingle, places)
                at = np.array(own, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).take(pa.array(at)), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(e.as_buffer()).hexdigest() for e in edited], pa.string()),
                        spelled(marks[at]), spelled(other), pa.array(likeness(marks[at], other)), pa.array(likeness(marks[at], marks[at + 1])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                before = batch.slice(batch.num_rows - 1), texts[-1], marks[-1:]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_order(docs, text).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
