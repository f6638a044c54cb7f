"""N-gram Jaccard join: a MinHash LSH forest over word shingles, with exact verification of every candidate.

A tree of the forest is the prefix trie of the sets' labels, a label being the set's minima under the tree's own hash
functions. A set looks for company in every tree. Prefixes are shortened from whole labels, the least crowded subtrees
first, until pairs at the threshold are found with the target recall; then the most crowded subtrees, as many as the
recall allows, stay at longer prefixes. Subtrees, not the corpus, are sorted and searched, each in a task or, when
large, in blocks over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import Scratch, as_strings, ragged, release, slices
from tidewire.llm.words import hashes, mix, split, window_hashes

_BATCH_BYTES = 3 << 20
_SEEDS = np.random.default_rng(20).integers(1, 2**32, (2, 4096), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_LEVEL_BITS = 16  # of a label's minima beyond the shortest prefix, so many bits each are kept


def depth_for_recall(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """How short prefixes may become: level by level from the deepest, until pairs at the threshold meet in some
    tree with at least the wanted probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def spared(crowds: np.ndarray, shortest: int, deepest: int, threshold: float, recall: float) -> np.ndarray:
    """The trees in which a set may keep longer prefixes, from the numbers of sets that share its shortest prefixes.

    All trees are shortened, the least crowded first, until pairs at the threshold meet with the wanted probability in
    one of those, or at whole labels in the others. The others have to be more crowded than each of the first by more than
    one set: then no single partner decides which they are, and the probability holds for each.
    """
    order = np.argsort(crowds, kind="stable")[::-1]
    short, long = math.log1p(-(threshold**shortest)), math.log1p(-(threshold**deepest))
    most = next(k for k in range(len(order), -1, -1) if k == 0 or (len(order) - k) * short + k * long <= math.log(1 - recall))
    while most and (most == len(order) or crowds[order[most - 1]] - 1 <= crowds[order[most]]):
        most -= 1
    return np.sort(order[:most])


def shortened(crowds: np.ndarray, shortest: int, deepest: int, threshold: float, recall: float) -> np.ndarray:
    """A set's prefix length in each tree, from the numbers of sets that share its prefixes (trees x levels, short first).

    Spared trees begin at the deepest level and are shortened as far as they are no more crowded than the most crowded of
    the others, which are read at the shortest.
    """
    depth = np.full(len(crowds), shortest)
    kept = spared(crowds[:, 0], shortest, deepest, threshold, recall)
    if len(kept):
        usual = np.delete(crowds[:, 0], kept).max()
        for t in kept:
            depth[t] = deepest
            while depth[t] > shortest and crowds[t, depth[t] - 1 - shortest] <= usual:
                depth[t] -= 1
    return depth


def shingle_sets(strings: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text (sorted), concatenated, and how many each text has.

    A text of fewer than n words has one shingle, of all its words; a text without words has none.
    """
    w = split(strings)
    h = hashes(w.data, w.starts, w.ends)
    rows = np.arange(len(strings))
    windows = window_hashes(h, n)
    whole = w.row[: len(windows)] == w.row[n - 1 :][: len(windows)] if len(windows) else np.zeros(0, bool)
    values, row = windows[whole], w.row[: len(windows)][whole]
    short = np.flatnonzero((w.per_row > 0) & (w.per_row < n))
    extra = []
    for r in short:
        acc = np.uint64(w.per_row[r])
        for x in h[w.first[r] : w.first[r + 1]]:
            acc = mix(np.array([acc ^ x]))[0]
        extra.append(acc)
    values = np.concatenate([values, np.array(extra, np.uint64)])
    row = np.concatenate([row, short])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[fresh], np.bincount(row[fresh], minlength=len(rows))


def set_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key for each set, whatever the order of its members."""
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mix(running[ends] - running[ends - sizes] + sizes.astype(np.uint64)).astype(np.int64)


def labels(values: np.ndarray, sizes: np.ndarray, trees: int, shortest: int, deepest: int) -> np.ndarray:
    """Each set's label in each tree (sets x trees x 2): the shortest prefix as one number, and the minima beyond it
    packed from the top, so that labels sort as the trie does; empty sets get zeros."""
    some = np.flatnonzero(sizes > 0)
    out = np.zeros((len(sizes), trees, 2), np.uint64)
    if not len(some):
        return out
    begin = (np.cumsum(sizes) - sizes)[some]
    base = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    for t in range(trees):
        acc, rest = np.full(len(some), t + 1, np.uint64), np.zeros(len(some), np.uint64)
        for k in range(deepest):
            i = t * deepest + k
            x = (base ^ _SEEDS[0, i]) * _SEEDS[1, i]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(x, begin).astype(np.uint64)
            if k < shortest:
                acc = mix(acc ^ least)
            else:
                rest |= (mix(least) >> np.uint64(64 - _LEVEL_BITS)) << np.uint64(64 - _LEVEL_BITS * (k - shortest + 1))
        out[some, t, 0], out[some, t, 1] = acc, rest
    return out


def prefix_keys(label: np.ndarray, depth: np.ndarray, shortest: int) -> np.ndarray:
    """One number for each label's prefix of the given length; of the shortest length it is the label's own."""
    beyond = ((depth - shortest) * _LEVEL_BITS).astype(np.uint64)
    kept = np.where(beyond > 0, label[..., 1] >> ((np.uint64(64) - beyond) & np.uint64(63)), np.uint64(0))
    return np.where(beyond > 0, mix(label[..., 0] ^ mix(kept + (beyond << np.uint64(56)) + np.uint64(1))), label[..., 0]).astype(np.int64)


def meet(a: np.ndarray, b: np.ndarray, depth_a: np.ndarray, depth_b: np.ndarray, shortest: int) -> np.ndarray:
    """In which trees two sets meet: their labels agree as far as the one that looks less deep looks."""
    beyond = ((np.minimum(depth_a, depth_b) - shortest) * _LEVEL_BITS).astype(np.uint64)
    apart = a[..., 1] ^ b[..., 1]
    agree = np.where(beyond > 0, apart >> ((np.uint64(64) - beyond) & np.uint64(63)), np.uint64(0)) == 0
    return (a[..., 0] == b[..., 0]) & agree


def _shuffled(df: DataFrame) -> DataFrame:
    """Joins whose sides both grow with the input are planned alike at every size: as shuffles that skew handling can split."""
    return df.hint("merge")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of the edges (u, v); label is the least node of the component.

    Least labels move along the edges and jump to their own labels' labels, in rounds that are each written to
    shared storage; no link or component is gathered anywhere, and both sides of each join can be split.
    """
    both = scratch.keep(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    known = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        sent = both.join(_shuffled(known), both.u == known.node).select(both.v.alias("node"), "label")
        least = scratch.keep(known.union(sent).groupBy("node").agg(F.min("label").alias("label")))
        above = least.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = scratch.keep(least.join(_shuffled(above), "label", "left").select("node", F.least("label", "higher").alias("label")))
        moved = known.withColumnRenamed("label", "old").join(_shuffled(jumped), "node").where("label != old").limit(1).count()
        scratch.drop(known, least)
        known = jumped
        if not moved:
            scratch.drop(both)
            return known


def verified(values: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (sorted by their first) whose exact Jaccard similarity is at least the threshold."""
    _, ids = np.unique(values, return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
    left, right = [], []
    heads, begins, counts = np.unique(first, return_index=True, return_counts=True)
    for a, lo, n in zip(heads.tolist(), begins.tolist(), counts.tolist(), strict=True):
        b = second[lo : lo + n]
        low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        b = b[low >= threshold * high - 1e-9]
        if not len(b):
            continue
        own = ids[begin[a] : begin[a] + sizes[a]]
        mark[own] = 1
        step = max(1, 4_000_000 // max(1, int(sizes[b].max())))
        for lo in range(0, len(b), step):
            part = b[lo : lo + step]
            flat = mark[ids[ragged(begin[part], sizes[part])]]
            common = np.add.reduceat(flat, np.cumsum(sizes[part]) - sizes[part])
            hit = part[common >= threshold * (sizes[a] + sizes[part] - common) - 1e-9]
            left.append(np.full(len(hit), a))
            right.append(hit)
        mark[own] = 0
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given links."""
    parent = list(range(n))
    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def near_duplicates(
    docs: DataFrame, text: str = "text", shingle: int = 5, threshold: float = 0.8, trees: int = 24, deepest: int = 8, recall: float = 0.99999,
    block: int = 768, block_bytes: int = 32 << 20, row: str | None = None,
) -> DataFrame:
    """doc_id, copy_id, class_id and n_links of every document, a row per row.

    Documents with equal shingle sets are copies: copy_id is their least id. Distinct sets look for company in a forest
    of `trees` tries of `deepest` minima; `shortened` says how far each set's prefixes are read, so that a pair at the
    threshold is missed with probability 1 - `recall` at most. Two sets that meet in
    several trees are verified in the first of them, exactly. A large subtree is verified in blocks of about `block` sets and `block_bytes` of shingles, so
    that near copies in any number spread over many tasks and their pairs are counted, never written. class_id is
    the least id among all documents that links connect; n_links counts the other documents at or above the
    threshold. A text of fewer than `shingle` words is one shingle; texts without words (nulls too) are copies of one
    another. Rows without an id take part like others, with a null copy_id where all their copies lack one. An
    empty table gives an empty result; other columns are ignored, whatever their names.

    Rows are known by a number of their own, as ids may repeat or lack. `row` names a column with such numbers; then it
    is returned as well, with `stays`: true for one row a class, the first of its least id.
    """
    if deepest > 8:  # what is kept of a label has room for no more
        raise ValueError("labels have at most 8 minima")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    shortest = max(deepest - 64 // _LEVEL_BITS, depth_for_recall(threshold, trees, deepest, recall))
    key = docs.schema["doc_id"].dataType.simpleString()
    at = F.monotonically_increasing_id() if row is None else F.col(row)
    body = docs.select("doc_id", F.col(text).cast("string").alias("body"), at.alias("at"))
    if row is None:
        body = scratch.keep(body)  # numbers are given once

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            strings = as_strings(batch.column(1))
            for lo, hi in slices(strings, _BATCH_BYTES):
                values, sizes = shingle_sets(strings.slice(lo, hi - lo), shingle)
                signs = labels(values, sizes, trees, shortest, deepest)
                blobs = [p.tobytes() if n else b"" for p, n in zip(signs, sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(set_keys(values, sizes)), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "at", "node", "size", "labels"],
                )

    signed = scratch.keep(body.mapInArrow(sign, f"doc_id {key}, at long, node long, size long, labels binary"))
    # Any of a node's equal labels will do; max() is one that partial aggregation can carry.
    nodes = scratch.keep(
        signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "at")).alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("labels").alias("labels"))
    )

    # 1. Company at the shortest prefix: most sets have none in any tree, and are done.
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(n, p) for n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if p]
            if some:
                own = np.frombuffer(b"".join(p for _, p in some), np.int64).reshape(-1, trees, 2)[:, :, 0]
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat([n for n, _ in some], trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(some)))], names=["bucket", "node", "tree"])

    held = nodes.select("node", "labels").mapInArrow(spread, "bucket long, node long, tree int")
    shared = scratch.keep(held.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    company = held.join(_shuffled(shared), "bucket").groupBy("node").agg(F.collect_list(F.struct("tree", "crowd")).alias("company"))  # at most a tree each
    company = scratch.keep(company.join(_shuffled(nodes.select("node", "size", "labels")), "node"))

    # 2. Longer prefixes, in the trees that a set may spare.
    levels = deepest - shortest

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = np.arange(shortest + 1, deepest + 1)
        for batch in batches:
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, trees, 2)
            crowds = np.ones((len(label), trees), np.int64)
            for i, row in enumerate(batch.column(2).to_pylist()):
                crowds[i, [c["tree"] for c in row]] = [c["crowd"] for c in row]
            full = [spared(row, shortest, deepest, threshold, recall).tolist() for row in crowds]
            i = np.repeat(np.arange(len(full)), [len(f) for f in full])
            t = np.array([t for f in full for t in f], np.int64)
            keys = prefix_keys(np.repeat(label[i, t][:, None], levels, 1), np.broadcast_to(depth, (len(i), levels)), shortest)
            place = (t[:, None] * levels + np.arange(levels)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[i], levels)), pa.array(place.ravel()), pa.array(keys.ravel())], names=["node", "place", "bucket"])

    asked = company.select("node", "labels", "company").mapInArrow(longer, "node long, place int, bucket long")
    crowds = asked.groupBy("bucket").agg(F.count("*").alias("crowd"))
    seen = asked.join(_shuffled(crowds), "bucket").groupBy("node").agg(F.collect_list(F.struct("place", "crowd")).alias("longer"))
    seen = scratch.keep(seen)
    chosen = company.join(_shuffled(seen), "node", "left")

    # 3. Every set's own prefix in each tree, and its seats: the subtrees in which it looks or may be looked for.
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.frombuffer(b"".join(batch.column("labels").to_pylist()), np.uint64).reshape(-1, trees, 2)
            depth = np.full((len(label), trees), shortest)
            crowd = np.ones((len(label), trees, levels + 1), np.int64)
            for i, (near, far) in enumerate(zip(batch.column("company").to_pylist(), batch.column("longer").to_pylist(), strict=True)):
                for c in near:
                    crowd[i, c["tree"], 0] = c["crowd"]
                if far:
                    for c in far:
                        crowd[i, c["place"] // levels, c["place"] % levels + 1] = c["crowd"]  # of spared trees alone
                    depth[i] = shortened(crowd[i], shortest, deepest, threshold, recall)
            own = prefix_keys(label, depth, shortest)
            for d in range(shortest, deepest + 1):
                i, t = np.nonzero((crowd[:, :, 0] > 1) & (depth >= d))
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("node").take(pa.array(i)), batch.column("size").take(pa.array(i)), pa.array(t.astype(np.int32)), pa.array(np.full(len(i), d, np.int32)),
                            pa.array(prefix_keys(label[i, t], np.full(len(i), d), shortest)), pa.array(depth[i, t] == d), pa.array([row.tobytes() for row in depth[i].astype(np.uint8)], pa.binary()),
                            pa.ListArray.from_arrays(np.arange(0, trees * len(i) + 1, trees, dtype=np.int32), pa.array(own[i].ravel())),
                        ],
                        names=["node", "size", "tree", "level", "bucket", "looks", "depths", "own"],
                    )

    seats = chosen.select("node", "size", "labels", "company", "longer").mapInArrow(seat, "node long, size long, tree int, level int, bucket long, looks boolean, depths binary, own array<long>")
    seats = scratch.keep(seats)
    # A subtree all of whose sets have met in one earlier tree has nothing left to verify.
    own = [F.col("own")[t] for t in range(trees)]
    subtrees = seats.groupBy("bucket", "level").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.max("looks").alias("looked"), F.min("tree").alias("of"),
        F.array(*(F.min(c) for c in own)).alias("low"), F.array(*(F.max(c) for c in own)).alias("high"),
    )
    met = F.exists(F.arrays_zip(F.slice("low", 1, F.col("of")), F.slice("high", 1, F.col("of"))), lambda z: z["0"] == z["1"])
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") * 8 / block_bytes)).cast("int")
    subtrees = scratch.keep(subtrees.where(F.col("looked") & (F.col("n") > 1) & ~met).select("bucket", "level", "n", "shingles", blocks.alias("blocks")))
    total = subtrees.where("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("shingles")).first()
    units = max(1, math.ceil(max(total.n / block, total.shingles * 8 / block_bytes)))
    seated = seats.join(_shuffled(subtrees.select("bucket", "level", "blocks")), ["bucket", "level"])
    # A set has at most a seat a tree and level.
    seated = seated.groupBy("node").agg(F.collect_list(F.struct("bucket", "tree", "level", "blocks")).alias("seats"), F.max("depths").alias("depths"))
    members = scratch.keep(seated.join(_shuffled(nodes.select("node", "first.at", "copies", "labels")), "node"))

    # 4. The shingles of those sets, and every first meeting verified.
    texts = members.join(_shuffled(body.drop("doc_id")), "at").select("node", "copies", "labels", "depths", "seats", "body")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            strings = as_strings(batch.column(5))
            for lo, hi in slices(strings, _BATCH_BYTES):
                values, n = shingle_sets(strings.slice(lo, hi - lo), shingle)
                own = np.flatnonzero(set_keys(values, n) == batch.column(0).slice(lo, hi - lo).to_numpy())
                ends = np.cumsum(n)
                sets = [values[ends[i] - n[i] : ends[i]].tobytes() for i in own]
                at = pa.array(own + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(5)), pa.array(sets, pa.binary())], names=["node", "copies", "labels", "depths", "seats", "shingles"])

    ready = texts.mapInArrow(prepare, "node long, copies long, labels binary, depths binary, seats array<struct<bucket:long,tree:int,level:int,blocks:int>>, shingles binary")
    ready = ready.withColumn("seat", F.explode("seats")).select("node", "copies", "labels", "depths", "shingles", "seat.*")
    small = F.col("blocks") == 1
    ready = ready.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    ready = ready.withColumn("other", F.explode(F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    tasks = ready.select(
        F.when(small, F.lit(None)).otherwise(F.col("bucket")).alias("big"), F.when(small, F.lit(None)).otherwise(F.col("level")).alias("big_level"),
        F.when(small, F.pmod(F.xxhash64("bucket", "level"), F.lit(units))).otherwise(F.least("mine", "other").cast("long")).alias("a"), F.greatest("mine", "other").alias("b"),
        "node", "copies", "labels", "depths", "bucket", "tree", "level", "mine", "shingles",
    )

    def verify(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["node"].to_numpy(), group["level"].to_numpy(), group["bucket"].to_numpy()))
        group = group.take(pa.array(order))
        node, bucket, level, tree = (group[c].to_numpy() for c in ("node", "bucket", "level", "tree"))
        label = np.frombuffer(b"".join(group["labels"].to_pylist()), np.uint64).reshape(-1, trees, 2)
        depth = np.frombuffer(b"".join(group["depths"].to_pylist()), np.uint8).reshape(-1, trees).astype(np.int64)
        blobs = group["shingles"].to_pylist()
        size = np.array([len(b) // 8 for b in blobs], np.int64)
        crossing = group["big"][0].is_valid and group["a"][0].as_py() != group["b"][0].as_py()
        mine = group["mine"].to_numpy()
        edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (level[1:] != level[:-1])) + 1
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(node)], strict=True):
            t, d = int(tree[lo]), int(level[lo])
            for a in range(lo, hi - 1):
                b = np.arange(a + 1, hi)
                if crossing:
                    b = b[mine[b] != mine[a]]
                b = b[(node[b] != node[a]) & (np.minimum(depth[a, t], depth[b, t]) == d)]
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                b = b[low >= threshold * high - 1e-9]
                if len(b) and t:
                    b = b[~meet(label[a, :t], label[b, :t], depth[a, :t], depth[b, :t], shortest).any(1)]
                left.append(np.full(len(b), a))
                right.append(b)
        left, right = verified(np.frombuffer(b"".join(blobs), np.uint64), size, np.concatenate(left), np.concatenate(right), threshold)
        copies = group["copies"].to_numpy()
        links = np.bincount(left, copies[right], len(node)) + np.bincount(right, copies[left], len(node))
        linked = np.flatnonzero(links)
        edges = np.array(_forest(len(node), left, right), np.int64).reshape(-1, 2)
        u = np.concatenate([node[linked], node[edges[:, 0]]])
        v = np.concatenate([node[linked], node[edges[:, 1]]])
        w = np.concatenate([links[linked].astype(np.int64), np.zeros(len(edges), np.int64)])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(w, pa.int64())})

    found = scratch.keep(tasks.groupBy("big", "big_level", "a", "b").applyInArrow(verify, "u long, v long, links long"))
    counts = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.where("u != v").select("u", "v"), scratch)
    least = scratch.keep(classes.join(_shuffled(nodes.select("node", "first")), "node").groupBy("label").agg(F.min("first").alias("least")))
    placed = classes.join(_shuffled(least), "label").select("node", "least")
    table = nodes.select("node", "first", "copies").join(_shuffled(placed), "node", "left").join(_shuffled(counts), "node", "left")
    table = table.withColumn("least", F.coalesce("least", "first"))
    table = scratch.keep(
        table.select(
            "node", F.col("first.doc_id").alias("copy_id"), F.col("least.doc_id").alias("class_id"), F.col("least.at").alias("stay"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    rows = scratch.keep(signed.select("doc_id", "at", "node"))  # what the result still reads, without the labels
    scratch.drop_all_but(rows, table)
    mine = [] if row is None else [F.col("at").alias(row), (F.col("at") == F.col("stay")).alias("stays")]
    return rows.join(_shuffled(table), "node").select("doc_id", "copy_id", "class_id", "n_links", *mine)
