"""Periodic run detection: an all-lag scan of each text's words.

A run is a stretch of words that repeats with some smallest period q (words q apart are equal), is at least
`min_exp` periods and `least` words long, and is not part of a longer stretch with that period. The array of a text's
word numbers is compared with itself shifted by every lag from 1 up to n / min_exp; a true stretch of m places at lag q
is a stretch of m + q words with period q. Where q is a multiple of the smallest period, the smaller lag has found the
same stretch, so that the least lag of a stretch is its period.

All texts of a batch are compared at once, longest first, as those that a lag no longer concerns are then at the end.
A text whose compares exceed `unit` becomes several document-lag ranges of about that cost, which Spark deals out by
themselves; what they find meets again by document. A range holds the whole text's word numbers, so that ranges grow
with the text (at least `LEAST_LAGS` lags each): their number stays linear in its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import Scratch, as_strings, ragged, release, slices
from tidewire.llm.words import Words, hashes, mix, split

_BATCH_BYTES = 2 << 20
_COPY_BYTES = 1 << 20
LEAST_LAGS = 512
RUNS = "array<struct<start:long,length:long,period:long>>"


def lag_scan(ids: np.ndarray, ends: np.ndarray, least: int, min_exp: float, low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, lag) of every long enough true stretch at lags low <= lag < high.

    `ids` holds the word numbers of several texts, longest first, none shared between texts; `ends` is where each
    text ends.
    """
    lengths = np.diff(ends, prepend=0)
    shorter = -lengths  # ascending, for the search
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q, stop = low, high if high is not None else len(ids)
    while q < stop:
        words = max(least, math.ceil(min_exp * q))
        texts = int(np.searchsorted(shorter, -words, "right"))  # those with so many words
        if not texts:
            break
        end, places = int(ends[texts - 1]), max(1, words - q)
        same = ids[: end - q] == ids[q:end]
        if same[places - 1 :: places].any():  # a stretch of so many places holds one of these
            at = np.flatnonzero(same)
            if len(at) >= places and (at[places - 1 :] - at[: len(at) - places + 1] == places - 1).any():
                cut = np.flatnonzero(np.diff(at) != 1) + 1
                first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
                long = np.flatnonzero(last - first + 1 >= places)
                found.append((first[long], (last - first)[long] + 1 + q, np.full(len(long), q)))
        q += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, lag = (np.concatenate(part) for part in zip(*found, strict=True))
    return smallest(start, length, lag)


def smallest(start: np.ndarray, length: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least lag, by start and then period."""
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[fresh], length[fresh], lag[fresh]
    order = np.lexsort((lag, start))
    return start[order], length[order], lag[order]


def word_numbers(words: Words) -> np.ndarray:
    """A number for each word, equal within a text where the words are (told by 64-bit hashes), never equal between texts."""
    own = mix(hashes(words.data, words.starts, words.ends) ^ mix(words.row.astype(np.uint64) + np.uint64(1)))
    return np.unique(own, return_inverse=True)[1].astype(np.int32)


def scanned(words: Words, least: int, min_exp: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts; starts count over all words, in the texts' order."""
    order = np.argsort(-words.per_row, kind="stable")
    lengths = words.per_row[order]
    ends = np.cumsum(lengths)
    ids = word_numbers(words)[ragged(words.first[:-1][order], lengths)]
    start, length, lag = lag_scan(ids, ends, least, min_exp)
    text = np.searchsorted(ends, start, "right")
    start = start - (ends - lengths)[text] + words.first[:-1][order][text]
    again = np.lexsort((lag, start))
    return start[again], length[again], lag[again]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Which words no run holds beyond its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + lag, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] == 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space; bytes are copied in blocks."""
    at = np.flatnonzero(keep)
    row, size = words.row[at], (words.ends - words.starts)[at]
    last = np.ones(len(at), bool)
    last[:-1] = row[1:] != row[:-1]
    slot = size + ~last
    begin = np.cumsum(slot) - slot
    out = np.full(int(slot.sum()), 32, np.uint8)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + _COPY_BYTES, "right")) - 1)
        out[ragged(begin[lo:hi], size[lo:hi])] = words.data[ragged(words.starts[at[lo:hi]], size[lo:hi])]
        lo = hi
    offsets = np.zeros(len(words.per_row) + 1, np.int64)
    np.add.at(offsets, row + 1, slot)
    return pa.Array.from_buffers(pa.string(), len(words.per_row), [None, pa.py_buffer(np.cumsum(offsets).astype(np.int32)), pa.py_buffer(out)])


def run_lists(words: Words, start: np.ndarray, length: np.ndarray, lag: np.ndarray) -> pa.Array:
    """The runs of each text, whose starts count from the text's first word."""
    text = words.row[start] if len(start) else start
    offsets = np.searchsorted(start, words.first).astype(np.int32)
    fields = [pa.array(x, pa.int64()) for x in (start - words.first[text], length, lag)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 12, min_exp: float = 2.0, unit: int = 1 << 25) -> DataFrame:
    """The kept columns, `n_words`, `runs` (start, length and period of each, by start and then period) and
    `collapsed`: the text's words without those that a run holds beyond its first period, joined by one space.

    A row per row of `docs`, in no order. Words are stretches without ASCII white space. A null text counts as empty:
    no words, no runs, an empty collapsed text; repeated rows are told apart and get equal results; an empty table
    gives an empty result. Kept columns must not be named as the results are; other columns play no part, whatever
    their names. Runs of equal extent are one run, of the least period; runs that overlap all count. `min_exp` is at
    least 2, below which a stretch may have periods that its smallest does not divide.

    Texts of any length are scanned whole: those that may need more than `unit` compares as document-lag ranges.
    """
    if {"n_words", "runs", "collapsed"} & set(keep):
        raise ValueError("kept columns must not be named as the results are")
    if min_exp < 2:
        raise ValueError("an exponent below 2 is not supported")
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    # A text of b bytes has at most (b + 1) / 2 words, and n words take some n * n * 3 / 8 compares.
    most = F.pow((F.octet_length("__text") + 1) / 2, F.lit(2)) * 3 / 8

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            strings = as_strings(batch.column(1))
            for lo, hi in slices(strings, _BATCH_BYTES):
                words = split(strings.slice(lo, hi - lo))
                found = scanned(words, least, min_exp)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.per_row), run_lists(words, *found), joined(words, kept_words(len(words.row), *found))],
                    names=["__keep", "n_words", "runs", "collapsed"],
                )

    kind = body.schema["__keep"].dataType.simpleString()
    result = f"__keep {kind}, n_words long, runs {RUNS}, collapsed string"
    small = body.where(most <= unit).mapInArrow(whole, result)

    scratch = Scratch(docs.sparkSession)
    large = scratch.keep(body.where(most > unit).withColumn("at", F.monotonically_increasing_id()))  # numbers are given once

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's word numbers, and the lags at which its ranges of about equal cost begin and end."""
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                words = split(as_strings(batch.column(1).slice(i, 1)))
                n = len(words.row)
                high = int(n / min_exp) + 1
                each = max(unit, LEAST_LAGS * n)
                parts = max(1, math.ceil((n * (high - 1) - high * (high - 1) / 2) / each))
                # The compares of lags below q, n q - q q / 2, reach k / parts of all at these lags.
                share = np.arange(parts + 1) / parts * (n * high - high * high / 2)
                cuts = np.unique(np.clip(np.ceil(n - np.sqrt(np.maximum(0.0, n * n - 2 * share))), 1, high).astype(np.int64))
                cuts = np.union1d(cuts, [1, high]) if high > 1 else np.array([1, 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([word_numbers(words).tobytes()], pa.binary()), pa.array([cuts.tolist()], pa.list_(pa.int64()))], names=["at", "ids", "cuts"]
                )

    dealt = large.select("at", "__text").mapInArrow(ranges, "at long, ids binary, cuts array<long>")
    dealt = dealt.select("at", "ids", F.explode(F.arrays_zip(F.expr("slice(cuts, 1, size(cuts) - 1)").alias("low"), F.expr("slice(cuts, 2, size(cuts) - 1)").alias("high"))).alias("lags"))
    dealt = dealt.select("at", "ids", "lags.low", "lags.high").repartition("at", "low")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at, ids, low, high in zip(*(batch.column(k) for k in range(4)), strict=True):
                numbers = np.frombuffer(ids.as_buffer(), np.int32)
                found = lag_scan(numbers, np.array([len(numbers)]), least, min_exp, low.as_py(), high.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in found)], names=["at", "start", "length", "lag"])

    found = dealt.mapInArrow(scan, "at long, start array<long>, length array<long>, lag array<long>")
    met = found.groupBy("at").agg(*(F.flatten(F.collect_list(F.struct("start", "length", "lag"))[c]).alias(c) for c in ("start", "length", "lag")))  # at most 3/4 LEAST_LAGS'th of the words, a document

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                words = split(as_strings(batch.column(1).slice(i, 1)))
                found = smallest(*(np.array(batch.column(k)[i].as_py(), np.int64) for k in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array(words.per_row), run_lists(words, *found), joined(words, kept_words(len(words.row), *found))],
                    names=["__keep", "n_words", "runs", "collapsed"],
                )

    rest = large.join(met.hint("merge"), "at").select("__keep", "__text", "start", "length", "lag").mapInArrow(collapse, result)
    return small.unionByName(rest).select("__keep.*", "n_words", "runs", "collapsed")


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and texts, a tenth of which repeat themselves from some word on, as the id's checksum says.

    With h the crc32 of the id's decimal text (a null id: the empty text) and g = h div 10, where h mod 10 is 0 and the
    text has n > 0 words: from word a = g mod n on, the words repeat with period 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    body = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), h.alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.expr("h div 10")
        a = (g % n).cast("int")
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        index = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, index(i))), " ")).otherwise("")

    # The words are an array's one element, so that they are split once and not for each place.
    return body.select("doc_id", F.when(F.col("h") % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the greatest one and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = runs.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2(spelled, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
