"""Versioned tables: commits, conflicts, readers, keyed upserts by filters, late days, expiry and compaction."""

from __future__ import annotations

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import store
from tidewire.operators.tables import Conflict, Table, bloom, checksum, maybe
from tidewire.storage import materialise

SCHEMA = "url_hash long, day string, title string, summary string, image_url string, seq int"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return sorted((tuple(r) for r in df.select("url_hash", "day", "title", "summary", "image_url").collect()), key=repr)


def test_filters_hold_their_keys():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 5000)
    held = bloom(keys)
    assert maybe(held, keys).all() and maybe(held, others).mean() < 0.003
    assert not maybe(bloom(np.zeros(0, np.int64)), keys).any()


def test_upserts_equal_the_plain_ones(spark, tmp_path):
    """Random batches: the table holds what insert-or-ignore and enriching give over whole tables."""
    rng, table = random.Random(4), Table(spark, f"file://{tmp_path}/t", "day", buckets=4)
    maybe_empty = lambda v: rng.choice((v, v, "", None))
    expected = None
    for number in range(5):
        rows = [(rng.choice((rng.randint(0, 60), rng.randint(0, 60), None)) if number else rng.randint(0, 60), f"2024-01-0{rng.randint(1, 3)}", maybe_empty(f"t{number}"), maybe_empty(f"s{number}"), maybe_empty("i"), i) for i in range(40)]
        batch = rows_of(spark, rows)
        keyed, bare = batch.where("url_hash is not null"), batch.where("url_hash is null").drop("seq")
        before = 0 if expected is None else expected.count()
        expected = store.first_per_key(keyed, "url_hash", "seq").drop("seq") if expected is None else store.upsert(expected, keyed).drop("seq")
        expected = materialise(expected.unionByName(bare))
        counts = table.upsert(batch)
        assert shown(table.read()) == shown(expected) and counts["inserted"] == expected.count() - before and counts["candidates"] == 40
    assert table.version() == 5
    commits = len({c for held in table.manifest()["cells"].values() for c in held})
    table.compact(least=1)
    assert shown(table.read()) == shown(expected) and len({c for held in table.manifest()["cells"].values() for c in held}) < commits
    assert shown(table.read(parts=["2024-01-02"])) == shown(expected.where("day = '2024-01-02'"))


def test_two_writers(spark, tmp_path):
    """Who comes second is told so; retried changes are all kept."""
    table = Table(spark, f"file://{tmp_path}/t", "day")
    first, second = table.manifest(), table.manifest()
    assert table.commit(first) == 1
    with pytest.raises(Conflict):
        table.commit(second)
    writers = [threading.Thread(target=lambda n=n: [table.change(lambda m: m["batches"].update({f"{n}-{k}": {}}), tries=200) for k in range(10)]) for n in range(4)]  # noqa: B023
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert len(table.manifest()["batches"]) == 40 and table.version() == 41


def test_a_reader_during_swaps(spark, tmp_path):
    """Each read sees one version whole while another thread replaces the table and forgets old versions."""
    table = Table(spark, f"file://{tmp_path}/t", "day", key="id", buckets=1)
    put = lambda n: table.replace(spark.range(5).select("id", F.lit("d").alias("day"), F.lit(n).alias("n")), verify=False)
    put(0)
    wrong, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                got = table.read().agg(F.count("*"), F.countDistinct("n")).first()
                if tuple(got) != (5, 1):
                    wrong.append(got)
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 25):
        put(n)
        if n % 5 == 0:
            table.expire(keep=12)
    stop.set()
    reader.join()
    assert not wrong and table.read().first().n == 24 and len(table.files.names("data")) == 16


def test_failed_and_verified_replacements(spark, tmp_path, monkeypatch):
    table = Table(spark, f"file://{tmp_path}/t", "month", key="id", buckets=2)
    rows = lambda *of: spark.createDataFrame([(i, m, "x") for i, m in of], "id long, month string, body string")
    table.replace(rows((1, "2024-01"), (2, "2024-02"), (3, None)))
    with pytest.raises(Exception, match="stop"):
        table.replace(rows((4, "2024-01")).withColumn("body", F.raise_error(F.lit("stop")).cast("string")))
    before = {f for c in table.files.names("data") for f in table.files.names(f"data/{c}/month=2024-02/bucket=0") + table.files.names(f"data/{c}/month=2024-02/bucket=1")}
    table.replace(rows((5, "2024-01")), parts=["2024-01", "2024-03"])
    assert sorted((r.id, r.month) for r in table.read().collect()) == [(2, "2024-02"), (3, None), (5, "2024-01")]
    held = table.manifest()["cells"]["2024-02"]
    after = {f for c, buckets in held.items() for b in buckets for f in table.files.names(f"data/commit={c}/month=2024-02/bucket={b}")}
    assert after <= before and after  # a month that is not touched keeps its files
    import tidewire.operators.tables as tables

    sums = iter([(1, 2, 3), (1, 2, 4)])
    monkeypatch.setattr(tables, "checksum", lambda rows: next(sums))
    with pytest.raises(ValueError, match="written"):
        table.replace(rows((6, "2024-01")))
    assert table.read().count() == 3
    with pytest.raises(ValueError):
        table.write(rows((1, "x")).withColumn("bucket", F.lit(1)), table.manifest())


def test_checksums_know_rows_but_no_order(spark):
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    assert checksum(rows) == checksum(rows.orderBy(F.desc("id")).repartition(7)) != checksum(rows.where("id <> 5"))
    assert checksum(rows) != checksum(rows.withColumn("s", F.when(F.col("id") == 5, "6").otherwise(F.col("s"))))


def test_replayed_batches_and_late_days(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", "day", buckets=2)
    first = rows_of(spark, [(1, "2024-01-01", "a", None, None, 0), (2, "2024-01-02", "b", "", None, 1)])
    counts = table.upsert(first, stream="s", batch_id=0)
    other = rows_of(spark, [(9, "2024-01-02", "never", "never", None, 0)])
    assert table.upsert(other, stream="s", batch_id=0) == counts and table.read().count() == 2  # brought again
    table.close("2024-01-01")
    late = rows_of(spark, [(3, "2024-01-01", "late", None, None, 0), (1, "2024-01-01", "x", "filled", None, 1), (4, "2024-01-02", "d", None, None, 2)])
    got = table.upsert(late, stream="s", batch_id=1)
    assert (got["inserted"], got["late"]) == (2, 1) and table.queue() == ["2024-01-01"]
    assert shown(table.read()) == [(1, "2024-01-01", "a", "filled", None), (2, "2024-01-02", "b", "", None), (4, "2024-01-02", "d", None, None)]
    assert table.upsert(late.withColumn("summary", F.lit("more")), stream="s", batch_id=2)["inserted"] == 0  # late rows are known, and enriched
    assert table.read(late=True).where("url_hash = 3").first().summary == "more"
    table.reopen("2024-01-01")
    assert table.queue() == [] and table.read().count() == 4


def test_few_cells_are_read(spark, tmp_path):
    """A flush whose keys are new or of the last day reads that day's cells and little more."""
    table = Table(spark, f"file://{tmp_path}/t", "day", buckets=8)
    many = spark.range(20_000).select((F.col("id") * 7919).alias("url_hash"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).cast("string").alias("day"), *(F.lit("x").alias(c) for c in ("title", "summary", "image_url")), F.col("id").cast("int").alias("seq"))
    table.upsert(many)
    batch = many.where("day = '2024-01-10'").limit(200).union(many.limit(20).withColumn("url_hash", -F.col("url_hash") - 1))
    got = table.upsert(batch)
    assert got["inserted"] == 20 and got["cells"] == 80 and 8 <= got["cells_read"] <= 14


def test_schema_grows_by_name(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", "day", buckets=1)
    table.upsert(rows_of(spark, [(1, "d", "a", None, None, 0)]))
    table.upsert(rows_of(spark, [(2, "d", "b", None, None, 0)]).withColumn("author", F.lit("me")))
    assert sorted((r.url_hash, r.author) for r in table.read().collect()) == [(1, None), (2, "me")]
    table.upsert(rows_of(spark, []))
    assert table.read().count() == 2
