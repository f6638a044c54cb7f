"""Filter interaction audit: what each filter removes, alone and beside the others, in every order of applying them.

Each document has a mask, one bit for each filter that it fails. All that the audit needs of a part of the corpus is
how many documents have each mask: their removal polynomial f, in which x_i says how far filter i is applied, is the
multilinear extension of "removed by at least one applied filter",

    f(x) = sum over masks S of count(S) * (1 - product over i in S of (1 - x_i)).

At a corner (every x_i 0 or 1) it counts what those filters remove together, so that differences of corners are a
filter's removals after any others. A filter's Shapley value, its removals averaged over all orders, is the integral
of its partial derivative along the diagonal x = (t, ..., t); with the polynomial's coefficients a_T this is the sum
of a_T / |T| over the monomials T that hold the filter, in exact rationals, and times the number of orders an integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import text_of


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients a_T, by mask T, of the multilinear extension of removals, from the number of documents by mask."""
    n = len(counts)
    above = list(counts)  # documents whose mask holds T
    bit = 1
    while bit < n:
        for mask in range(n):
            if not mask & bit:
                above[mask] += above[mask | bit]
        bit <<= 1
    return [0] + [above[t] if t.bit_count() % 2 else -above[t] for t in range(1, n)]


def corners(coefficients: list[int]) -> list[int]:
    """The polynomial's value at each corner, by mask of the variables that are 1: the sum of the monomials within it."""
    out = list(coefficients)
    bit = 1
    while bit < len(out):
        for mask in range(len(out)):
            if mask & bit:
                out[mask] += out[mask ^ bit]
        bit <<= 1
    return out


def shapley(coefficients: list[int], i: int) -> Fraction:
    """The integral over t from 0 to 1 of the derivative by x_i at (t, ..., t): each monomial with x_i gives a t^(|T|-1)."""
    powers = [0] * len(coefficients).bit_length()
    for mask, a in enumerate(coefficients):
        if mask >> i & 1:
            powers[mask.bit_count() - 1] += a
    return sum((Fraction(a, k + 1) for k, a in enumerate(powers)), Fraction(0))


def audit(masked: DataFrame, filters: str, part: str = "part", mask: str = "mask", rows: str | None = None, losses: tuple[str, ...] = ()) -> DataFrame:
    """One row for each part, order of the filters (`filter_order`, their letters) and `step` from 1: long counts of
    the part's documents.

    `masked` has a part and a mask a row: bit i is set if the document fails filter i; `rows`, if given, names the
    number of documents that the row stands for. kept: documents that pass all filters up to the step; removed: those
    that fail this one and none before; redundant: those that fail it but were removed before; unique_fails: those that
    fail it alone; for each boolean column of `losses`, those among the removed for which it holds; shapley: what the
    filter removes, summed over all orders. A null part counts as the empty one, a null mask or number as 0, a null
    loss as false; a part without failing documents has rows of zeros, beside what it keeps; an empty table gives no
    rows. Other columns play no part.

    Documents are counted by part and mask before they are shuffled; a part's group has at most a row a mask.
    """
    n = len(filters)
    stands = F.lit(1).cast("long") if rows is None else F.coalesce(F.col(rows).cast("long"), F.lit(0))
    counted = masked.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(mask).cast("int"), F.lit(0)).alias("mask"), stands.alias("__rows"), *(F.when(F.col(c).cast("boolean"), stands).otherwise(0).alias(c) for c in losses))
    counted = counted.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("__rows", *losses)))
    counted = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "__rows", *losses)).alias("counts"))
    orders = ["".join(o) for o in permutations(filters)]
    places = [[filters.index(c) for c in o] for o in orders]
    own = np.array(places).ravel()
    before = np.array([sum(1 << p for p in o[:k]) for o in places for k in range(n)])
    after = before | 1 << own
    columns = ["kept", "removed", "redundant", "unique_fails", *losses, "shapley"]
    everything = (1 << n) - 1
    names, steps = pa.array([o for o in orders for _ in range(n)]), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                polynomial = {c: removal_polynomial([sum(r[c] for r in counts if r["mask"] == m) for m in range(1 << n)]) for c in ("__rows", *losses)}
                at = {c: np.array(corners(p), np.int64) for c, p in polynomial.items()}
                total = sum(r["__rows"] for r in counts)
                removed = at["__rows"][after] - at["__rows"][before]
                values = [
                    total - at["__rows"][after], removed, at["__rows"][1 << own] - removed, at["__rows"][everything] - at["__rows"][everything ^ 1 << own],
                    *(at[c][after] - at[c][before] for c in losses), np.array([int(shapley(polynomial["__rows"], i) * math.factorial(n)) for i in range(n)], np.int64)[own],
                ]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), names, steps, *(pa.array(v) for v in values)], names=["part", "filter_order", "step", *columns])

    return counted.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in columns)}")


FILTERS = "ABCDE"


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and `rows`, the number of documents that have them, of the five filters ABCDE.

    A: under 200 words; B: fewer than half of the words distinct; C: over 2 % capitals A-Z; D: any of `#$%&*|`; E: a
    document of a smaller id has the same text, anywhere in the table. A null text counts as empty, a null source as
    the part ''. A null id is smaller than none and none is smaller than it, so it neither fails E nor makes others
    fail; rows that share the smallest id of a text do not fail E. A document is good (quality 1) or toxic (toxic 1) if
    any label of its id says so. Texts of any length are judged whole, and meet as SHA-256 sums.

    Equal rows are counted before they meet, and a text's copies meet as a sum for each part, so that neither a hot
    text nor a hot source is gathered in one task: all but those of the least id fail E.
    """
    text = text_of()
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]  # split once
    judged = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), counts.alias("words"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text)).alias("c"), text.rlike("[#$%&*|]").alias("d"),
    )
    failed = (F.col("words.n") < 200, 100 * F.col("words.distinct") < 50 * F.col("words.n"), F.col("c"), F.col("d"))
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))
    ids = judged.select("doc_id", "part", "same", bits.alias("bits")).groupBy("same", "part", "bits", "doc_id").agg(F.count("*").alias("n"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality"), says("toxic"))
    ids = ids.join(known.hint("merge"), "doc_id", "left").withColumns({"good": F.coalesce("quality", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    one = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = ids.groupBy("same", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), one.alias("least"))
    firsts = texts.groupBy("same").agg(F.min("least.doc_id").alias("first"))
    texts = texts.join(firsts.hint("merge"), "same")
    passes = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("bits").alias("mask"), passes.alias("rows")), F.struct((F.col("bits") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - passes).alias("rows")))
    return texts.select("part", "good", "toxic", F.inline(split)).where("rows > 0")
