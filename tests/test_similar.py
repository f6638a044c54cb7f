"""Cosine joins against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import similar, terms
from tidewire.sources.articles import articles_of


@pytest.fixture(scope="module")
def sparse(spark):
    """Vectors over terms of very unlike frequency, on two days, with copies and a weightless one."""
    rng = np.random.default_rng(3)
    rows = []
    for day in ("a", "b"):
        for i in range(70):
            for t in {int(x) for x in rng.zipf(1.4, 12) % 200}:
                rows.append((day, i, f"t{t}", float(rng.uniform(0.1, 2) / math.log(2 + 200 / (t + 1)))))
        rows += [(day, 100, "t1", 1.0), (day, 101, "t1", 1.0), (day, 102, "t1", 0.0)]
    return spark.createDataFrame(rows, "day string, id long, term string, weight double")


@pytest.mark.parametrize("least", [0.05, 0.3, 0.8, 1.0])
def test_pruned_join_equals_all_pairs(sparse, least):
    held = {}
    for day, i, term, w in sparse.collect():
        held.setdefault((day, i), {})[term] = w
    norm = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in held.items()}
    cosine = lambda a, b: sum(w * held[b].get(t, 0.0) for t, w in held[a].items()) / (norm[a] * norm[b])
    expected = {(a[0], a[1], b[1]): cosine(a, b) for a in held for b in held if a[0] == b[0] and norm[a] and norm[b]}
    expected = {k: s for k, s in expected.items() if s >= least}
    sides = (sparse.withColumnRenamed("id", name) for name in ("left_id", "right_id"))
    got = {(r.day, r.left_id, r.right_id): r.similarity for r in similar.similarity_join(*sides, ["day"], least).collect()}
    near = {k for k in {*got, *expected} if abs(max(got.get(k, 0), expected.get(k, 0)) - least) < 1e-9}  # the sums' last bits decide
    assert {*got} - near == {*expected} - near
    assert all(math.isclose(s, expected[k]) for k, s in got.items() if k in expected)


def test_few_candidates_on_text(spark, sf_dir):
    """Headlines: pairs that share a term against pairs that are met."""
    articles = articles_of(spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")).where("title <> ''").withColumn("day", F.lit("one"))
    long = terms.tfidf(terms.headline_documents(articles)).select("day", F.col("doc_id").alias("left_id"), "term", "weight").cache()
    sides = long, long.withColumnRenamed("left_id", "right_id")
    sharing = sides[0].join(sides[1], ["day", "term"]).where("left_id < right_id").select("left_id", "right_id").distinct().count()
    frequency = long.unionByName(sides[1].withColumnRenamed("right_id", "left_id")).groupBy("day", "term").agg(F.count("*").alias("df"))
    for least, fewer in ((0.3, 4), (0.5, 20), (0.8, 100)):
        packed = [similar.packed(s, ["day"], k, frequency, least) for s, k in zip(sides, ("left_id", "right_id"), strict=True)]
        met = similar.candidates(*packed, ["day"], "left_id", "right_id").where("left_id < right_id").count()
        assert met * fewer <= sharing
    long.unpersist()


@pytest.mark.parametrize("bounds", [{}, {"broadcast_bytes": 0, "block_bytes": 4000}])
def test_dense_join_equals_all_pairs(spark, bounds):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(200)] + [(200, None), (201, []), (202, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    probes = df.where("id % 10 = 0").withColumnRenamed("id", "probe")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    expected = {(a, b) for a in unit if a % 10 == 0 for b in unit if unit[a] @ unit[b] >= 0.4}
    got = {(r.probe, r.id): r.similarity for r in similar.dense_join(probes, df, 0.4, "probe", "id", **bounds).collect()}
    assert {*got} == expected and all(math.isclose(s, unit[a] @ unit[b], abs_tol=1e-12) for (a, b), s in got.items())
    assert similar.dense_join(probes.limit(0), df, 0.4, "probe", "id", **bounds).count() == 0
    with pytest.raises(ValueError):
        similar.dense_join(probes, df, 0.0, "probe", "id")
