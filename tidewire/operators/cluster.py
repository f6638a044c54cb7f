"""Sequential leader clustering of one day's vectors, with a merge pass: the one step that must see its rows in order."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.config import DEFAULTS, Settings


def leader_clusters(vectors: list[dict[str, float]], threshold: float, settings: Settings = DEFAULTS) -> list[list[int]]:
    """Groups of positions. Each vector joins the most similar open cluster at or above the threshold, the one met
    last among equals, or opens one; then clusters of two and more whose sums are similar are united.

    Candidates are the clusters that hold one of the vector's rarer terms. Similarities are summed term by term over
    each term's own table of cluster weights. Vectors without weight are left out.
    """
    frequency: dict[str, int] = defaultdict(int)
    for term in chain.from_iterable(vectors):
        frequency[term] += 1
    common = max(settings.candidate_df_floor, math.ceil(len(vectors) * settings.candidate_df_share))
    weights: dict[str, dict[int, float]] = defaultdict(dict)  # term -> cluster -> summed weight, clusters as first met
    members: list[list[int]] = []
    squares: list[float] = []
    for i, vector in enumerate(vectors):
        length = math.sqrt(sum(w * w for w in vector.values()))
        if length == 0:
            continue
        met = dict.fromkeys(chain.from_iterable(weights[t] for t in vector if frequency[t] <= common and t in weights))
        chosen, reached = None, threshold
        if met:
            dots = dict.fromkeys(met, 0.0)
            for term, w in vector.items():
                table = weights.get(term, {})
                for c in table if len(table) < len(dots) else dots:
                    if c in dots and c in table:
                        dots[c] += w * table[c]
            for c, d in dots.items():
                similarity = d / (length * math.sqrt(squares[c]))
                if similarity >= reached:
                    chosen, reached = c, similarity
        if chosen is None:
            chosen = len(members)
            members.append([])
            squares.append(0.0)
        members[chosen].append(i)
        for term, w in vector.items():
            held = weights[term].get(chosen, 0.0)
            weights[term][chosen] = held + w
            squares[chosen] += w * (w + 2 * held)
    return _united(members, squares, weights, {t for t in weights if frequency[t] <= common}, settings.merge_similarity)


def _united(members: list[list[int]], squares: list[float], weights: dict, rare: set[str], threshold: float) -> list[list[int]]:
    """Unite clusters of two and more by the similarity they have before any is united."""
    large = {c for c, m in enumerate(members) if len(m) > 1}
    shared = {(a, b) for t in rare for a in weights[t] if a in large for b in weights[t] if b in large and a < b}
    dots: dict[tuple[int, int], float] = defaultdict(float)
    if shared:
        for table in weights.values():
            inside = sorted(c for c in table if c in large)
            for k, a in enumerate(inside):
                for b in inside[k + 1 :]:
                    if (a, b) in shared:
                        dots[a, b] += table[a] * table[b]
    root = list(range(len(members)))

    def top(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    for (a, b), d in sorted(dots.items()):
        if d / math.sqrt(squares[a] * squares[b]) >= threshold:
            x, y = top(a), top(b)
            root[y] = x
    groups: dict[int, list[int]] = {}
    for c, m in enumerate(members):
        groups.setdefault(top(c), []).extend(m)
    return list(groups.values())


def cluster_days(vectors: DataFrame, order: list[str], threshold: float, settings: Settings = DEFAULTS, by: str = "day") -> DataFrame:
    """(by, doc_id, cluster, position): one shuffle, a day a group; days run side by side.

    `vectors` has by, doc_id, the order columns, vector_terms and vector_weights.
    """
    day = vectors.schema[by].dataType.simpleString()
    key = vectors.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        rows = [dict(zip(t, w, strict=True)) for t, w in zip(group["vector_terms"].to_pylist(), group["vector_weights"].to_pylist(), strict=True)]
        found = leader_clusters(rows, threshold, settings)
        at = [i for g in found for i in g]
        cluster = [c for c, g in enumerate(found) for _ in g]
        position = [p for g in found for p in range(len(g))]
        picked = group.take(pa.array(at, pa.int64()))
        return pa.table({by: picked[by], "doc_id": picked["doc_id"], "cluster": pa.array(cluster, pa.int64()), "position": pa.array(position, pa.int64())})

    narrow = vectors.select(by, "doc_id", *[F.col(c) for c in order if c not in (by, "doc_id")], "vector_terms", "vector_weights")
    return narrow.groupBy(by).applyInArrow(run, f"{by} {day}, doc_id {key}, cluster long, position long")
