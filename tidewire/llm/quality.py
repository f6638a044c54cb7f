"""Quality rules: per-text rule statistics, and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import as_strings, materialise, release, shared_dir, slices, smallest_hashes, utf8_view
from tidewire.llm.words import hashes, mix, split, window_hashes

_BATCH_BYTES = 6 << 20
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "word_length", "symbols_per_char", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "exclaim_per_word", "comma_stop_per_word", "mark_word_share", "top_word_share", "lines_per_word",
)


def _by_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


def statistics(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x COUNTS, int64) and features (rows x FEATURES, float64) of a null-free string array."""
    data, offsets = utf8_view(strings)
    n = len(strings)
    w = split(strings)
    n_words = w.per_row
    space = (data == 32) | ((data >= 9) & (data <= 13))
    lead = (data & 0xC0) != 0x80
    word_chars = _by_row(lead & ~space, offsets)
    n_symbols = _by_row(_lut(_SYMBOLS)[data], offsets)

    # Lines: ranges between line feeds; a line counts where an earlier line of its row has the same bytes.
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], feeds + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = offsets[1:][row]
    inner = np.flatnonzero(row[1:] == row[:-1])
    ends[inner] = starts[inner + 1] - 1
    worded = _counts_between(~space, starts, ends) > 0
    starts, ends, row = starts[worded], ends[worded], row[worded]
    n_dup = np.zeros(n, np.int64)
    if len(starts):
        keyed = hashes(data, starts, ends) ^ mix(row.astype(np.uint64) + np.uint64(1))
        _, first = np.unique(keyed, return_index=True)
        n_dup = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)

    # Words in three-word windows that a row holds twice or more.
    n_repeat, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(w.starts):
        h = hashes(data, w.starts, w.ends)
        salt = mix(w.row.astype(np.uint64) + np.uint64(1))
        if len(h) >= 3:
            inside = w.row[:-2] == w.row[2:]
            at = np.flatnonzero(inside)
            _, where, count = np.unique(window_hashes(h, 3)[at] ^ salt[at], return_inverse=True, return_counts=True)
            hit = at[count[where] >= 2]
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[hit + k] = True
            n_repeat = np.bincount(w.row[covered], minlength=n)
        _, first, count = np.unique(h ^ salt, return_index=True, return_counts=True)
        np.maximum.at(top, w.row[first], count)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    latin = np.zeros(len(data), bool)
    latin[1:] = data[:-1] == 0xC3
    n_upper = _by_row(upper | latin & (data >= 0x80) & (data <= 0x9E), offsets)
    n_lower = _by_row(lower | latin & (data >= 0x9F), offsets)
    marks = np.zeros(n, np.int64)
    if len(w.starts):
        letters = upper | lower | (data >= 0x80) | ((data >= 48) & (data <= 57))
        marks = np.bincount(w.row[np.add.reduceat(letters, w.starts, dtype=np.int64) == 0], minlength=n)
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    n_lines = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    features = np.stack(
        [
            word_chars / words, n_symbols / chars, n_dup / np.maximum(n_lines, 1), n_repeat / words,
            n_upper / np.maximum(n_upper + n_lower, 1), _by_row((data >= 48) & (data <= 57), offsets) / chars,
            _by_row(data == 33, offsets) / words, _by_row((data == 44) | (data == 46), offsets) / words,
            marks / words, np.where(n_words >= 20, top / words, 0), n_lines / words,
        ], 1,
    )
    return counts, features.astype(np.float64)


def _counts_between(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return running[ends] - running[starts]


@dataclass
class Forest:
    """Trees as flat arrays; a leaf points to itself and holds its path length."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    norm: float

    def nodes(self, x: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """Each row's node of one tree after `depth` splits, or its leaf."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            right = x[rows, self.feature[tree][node]] >= self.cut[tree][node]
            node = self.child[tree][node, right.astype(np.int64)]
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): near 1 is anomalous, 0.5 and below is ordinary."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            total += self.path[t][self.nodes(x, t, self.depth)]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n rows; on a line between whole numbers."""
    if n != int(n):
        below = expected_path(int(n))
        return below + (n - int(n)) * (expected_path(int(n) + 1) - below)
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


# Values are counted in steps of 0.4 % of them, or of 4e-7 about zero.
_STEPS, _UNIT = 256, 1e-4


def usual_ranges(counts: pd.DataFrame, sample: int) -> np.ndarray:
    """Per feature the lower and upper end of what some `sample` rows span, and the spread of the rows held to it.

    `counts`: rows by feature and step (feature, step, count), of all rows.
    """
    out = []
    for _, part in counts.sort_values(["feature", "step"]).groupby("feature"):
        step, rows = part["step"].to_numpy(np.float64), part["count"].to_numpy(np.float64)
        share = np.cumsum(rows) / rows.sum()
        lo, hi = (np.searchsorted(share, q) for q in (1 / (sample + 1), sample / (sample + 1)))
        value = np.clip(_UNIT * np.sinh((step + 0.5) / _STEPS), *(low_high := _UNIT * np.sinh((step[[lo, hi]] + [0, 1]) / _STEPS)))
        mean = value @ rows / rows.sum()
        out.append([*low_high, max(1e-3, np.sqrt((value - mean) ** 2 @ rows / rows.sum()))])
    return np.array(out)


def grow_forest(
    n_rows: int, ranges: np.ndarray, level_of: Callable[[Forest, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
    trees: int = 128, sample: int = 256, seed: int = 7, margin: float = 0.5,
) -> Forest:
    """Trees of random splits, level by level: every one of the `n_rows` rows passes through every tree.

    `level_of(forest, level)` gives the rows of each tree's nodes of a level, and the least and greatest value of the
    feature that the node's split is drawn for. A split draws its cut from the node's range, as far as usual (`ranges`),
    widened by `margin` of the feature's spread on both sides, so that a value beyond is isolated early as well.
    Paths are told as in trees of `sample` rows: a leaf stands for its share of them, and trees end at their depth.
    Node i's children are 2 i + 1 and 2 i + 2; counts and extremes do not depend on the order of the rows.
    """
    rng = np.random.default_rng(seed)
    sample = min(sample, n_rows)
    depth = int(np.ceil(np.log2(max(2, sample))))
    size = 2 ** (depth + 1) - 1
    feature, drawn = rng.integers(len(ranges), size=(trees, size)), rng.random((trees, size))
    child = np.tile(np.arange(size)[None, :, None], (trees, 1, 2))
    forest = Forest(feature, np.full((trees, size), np.inf), child, np.zeros((trees, size)), depth, expected_path(max(2, sample)))
    inner = np.ones((trees, 1), bool)
    for level in range(depth + 1):
        at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        rows, low, high = level_of(forest, level)
        held = rows * (sample / n_rows)
        forest.path[:, at] = level + np.vectorize(expected_path, otypes=[float])(held)
        if level == depth:
            break
        split = inner & (held > 1)
        lo, hi, spread = np.moveaxis(ranges[feature[:, at]], 2, 0)
        low, high = np.clip(low, lo, hi) - margin * spread, np.clip(high, lo, hi) + margin * spread
        cut = low + drawn[:, at] * (high - low)
        forest.cut[:, at] = np.where(split, cut, np.inf)
        forest.child[:, at] = np.where(split[:, :, None], 2 * at[None, :, None] + [1, 2], at[None, :, None])
        inner = np.repeat(split, 2, axis=1)
    return forest


def _count_level(forest: Forest, level: int, blocks: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`level_of` of the rows of some blocks."""
    first, shape = 2**level - 1, (len(forest.feature), 2**level)
    rows, low, high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
    for x in blocks:
        for t in range(shape[0]):
            node = forest.nodes(x, t, level)
            here = np.flatnonzero(node >= first)
            node = node[here]
            value = x[here, forest.feature[t][node]]
            rows[t] += np.bincount(node - first, minlength=shape[1])
            np.minimum.at(low[t], node - first, value)
            np.maximum.at(high[t], node - first, value)
    return rows, low, high


def fit_forest(x: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 7, margin: float = 0.5) -> Forest:
    """The forest of all rows of an array."""
    steps = np.floor(np.arcsinh(x / _UNIT) * _STEPS).astype(np.int64)
    counts = pd.concat([pd.Series(steps[:, f]).value_counts().rename_axis("step").reset_index(name="count").assign(feature=f) for f in range(x.shape[1])])
    return grow_forest(len(x), usual_ranges(counts, sample), lambda forest, level: _count_level(forest, level, [x]), trees, sample, seed, margin)


def forest_of(rows: DataFrame, names: list[str], trees: int = 128, sample: int = 256) -> Forest | None:
    """The forest of all rows of a written table, which is read once a level; none of less than two rows.

    Tasks send the counts and extremes of their rows by tree and node: some 2 * trees * sample numbers at most.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("feature"), F.floor(F.asinh(F.col(n) / _UNIT) * _STEPS).alias("step")) for i, n in enumerate(names)])
    counts = rows.select(F.explode(steps).alias("s")).groupBy("s.feature", "s.step").count().toPandas()
    n_rows = int(counts["count"].sum()) // len(names)
    if n_rows < 2:
        return None

    def level_of(forest: Forest, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (np.stack([c.to_numpy() for c in b.columns], 1) for b in batches)
            held = _count_level(forest, level, blocks)
            tree, node = np.nonzero(held[0])
            columns = [tree.astype(np.int32), node.astype(np.int32), *(h[tree, node] for h in held)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "n", "low", "high"])

        told = rows.select(*names).mapInArrow(run, "tree int, node int, n long, low double, high double")
        told = told.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        out = np.zeros((trees, 2**level), np.int64), np.zeros((trees, 2**level)), np.zeros((trees, 2**level))
        for held, name in zip(out, ("n", "low", "high"), strict=True):
            held[told["tree"], told["node"]] = told[name]
        return out

    return grow_forest(n_rows, usual_ranges(counts, sample), level_of, trees, sample)


def calibrate(scores: np.ndarray, quality: np.ndarray, clean_weight: float = 4.0, default: float = 0.62, rows: np.ndarray | None = None) -> float:
    """The score from which a text is rejected: best trade of caught poor rows against `clean_weight` times lost
    clean rows, in the middle of the best gap; `default` where one class is absent. A score stands for `rows` rows, or one."""
    cuts, at = np.unique(scores, return_inverse=True)
    rows = np.ones(len(scores)) if rows is None else rows
    good, poor = (np.bincount(at, rows * (quality == k), len(cuts)) for k in (1, 0))
    if not good.sum() or not poor.sum():
        return default
    cuts = np.concatenate([cuts, [cuts[-1] + 1e-3]])
    lost, caught = (1 - np.concatenate([[0], np.cumsum(k)]) / k.sum() for k in (good, poor))
    best = int(np.argmax(caught - clean_weight * lost))
    return float((cuts[best] + (cuts[best - 1] if best else cuts[best])) / 2)


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns of `docs` beside the rule statistics of each whole text, in one pass over the rows."""
    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__rule_text"))
    n_held = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            strings = as_strings(batch.column(n_held))
            for lo, hi in slices(strings, _BATCH_BYTES):
                counts, features = statistics(strings.slice(lo, hi - lo))
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:n_held]]
                columns += [pa.array(np.ascontiguousarray(c)) for c in (*counts.T, *features.T)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f"__{n}" for n in (*COUNTS, *FEATURES))])

    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:n_held]), *(f"__{n} long" for n in COUNTS), *(f"__{n} double" for n in FEATURES)]
    )
    return held.mapInArrow(run, schema)


def quality_rules(
    docs: DataFrame, labels: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    label_rows: int | None = None, trees: int = 128, sample: int = 256, clean_weight: float = 4.0,
) -> DataFrame:
    """The kept columns, the rule counts, base_failed, the forest's score and the verdict `kept`, a row per row.

    Statistics cover every whole text. The forest is grown on all documents, and its threshold weighs all documents
    that have a label (quality 1 or 0) and pass the base rules, whatever the partitioning and whatever other documents
    are labelled; `label_rows` holds the latter to so many with the smallest id hashes. Scores have five places, so that
    a count of labelled rows by score is bounded. `sample` is the size of the trees: the rows that a tree's leaves stand
    for. Without labels of both kinds the threshold is fixed. A null text counts as empty: no words, base_failed.
    Repeated rows get equal verdicts; an empty table gives an empty result. A document labelled twice counts as poor if
    one label says so. Columns of `docs` that are not kept play no part; kept ones must not be named as the results are.
    """
    if {*COUNTS, "base_failed", "anomaly_score", "kept"} & set(keep):
        raise ValueError("kept columns must not be named as the results are")
    spark = docs.sparkSession
    stats = materialise(with_statistics(docs.withColumn("__doc_id", F.col("doc_id")), text, (*keep, "__doc_id")), shared_dir(spark))
    names = [f"__{n}" for n in FEATURES]
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    score = F.pandas_udf(_series_scorer(forest := forest_of(stats, names, trees, sample)), "double")(F.struct(*names))
    threshold = default = 0.62
    if forest is not None:
        known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("__doc_id")).agg(F.min("quality").alias("__quality"))
        labelled = stats.where(~failed).select("__doc_id", *names).join(known.hint("merge"), "__doc_id")
        if label_rows is not None:
            labelled = smallest_hashes(materialise(labelled, shared_dir(spark)), label_rows, "__doc_id", *names)
        rows = labelled.select(score.alias("score"), "__quality").groupBy("score", "__quality").count().toPandas()
        threshold = calibrate(rows["score"].to_numpy(np.float64), rows["__quality"].to_numpy(), clean_weight, default, rows["count"].to_numpy())

    out = stats.withColumn("__score", score)
    return out.select(
        *[F.col(f"`{c}`") for c in keep], *[F.col(f"__{n}").alias(n) for n in COUNTS], failed.alias("base_failed"),
        F.col("__score").alias("anomaly_score"), (~failed & (F.col("__score") < F.lit(threshold))).alias("kept"),
    )


def _series_scorer(forest: Forest | None):  # noqa: ANN202
    def score(values: pd.DataFrame) -> pd.Series:
        return pd.Series(np.round(forest.score(values.to_numpy(np.float64)), 5) if forest else np.zeros(len(values)))

    return score
