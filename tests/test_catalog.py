"""Every registered query of the engine against DuckDB, or at least run to its end."""

from __future__ import annotations

import pytest
from tests.oracle import duck, rows

from tidewire import catalog

WITH_SQL = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf_dir, con, name):
    ours, theirs = catalog.queries()[name](spark, sf_dir).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["story_clusters", "follow_up_anchors"])
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).toPandas() is not None


def test_balanced_pool_holds_every_order(spark, sf_dir, con):
    """The best order of each day, of all orders, is among the day's picks."""
    best = con.execute("select o_custkey % 40 as day, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) as id from orders group by 1").fetchall()
    picked = {(r.day, r.id) for r in catalog.queries()["select_balanced"](spark, sf_dir).collect()}
    assert len(best) == len({day for day, _ in picked}) and set(best) <= picked


@pytest.mark.parametrize("name", ["time_parts", "usage_events"])
def test_times_within_half_a_millisecond_of_a_bucket_edge(spark, tmp_path, name):
    """Times on both sides of the next bucket's first half millisecond, after 1970 and before."""
    import duckdb

    edges = [(day, us) for day in ("2024-01-01", "1969-12-30") for us in (-501, -500, -499, -1, 0, 1, 499, 500, 501)]
    when = " union all ".join(f"select timestamp '{day} 05:30:00' + interval ({us}) microsecond as ts" for day, us in edges)
    con = duckdb.connect()
    con.execute(f"create table events as select row_number() over () - 1 as event_id, ts, 1 as user_id, 'view' as event_type from ({when})")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    ours, theirs = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert len(ours) >= len(edges) and rows(ours) == rows(theirs)


def _usage_rows(spark, folder, select: str) -> tuple:
    """Rows of usage_events and of its SQL over events made by `select` (event_id, ts, event_type)."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create table events as {select}")
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    order = "order by request_id, event"
    got = catalog.queries()["usage_events"](spark, str(folder)).orderBy("request_id", "event").collect()
    return [tuple(r) for r in got], con.execute(f"select request_id, event, session, engagement_ms from ({catalog.oracle_sql()['usage_events']}) {order}").fetchall()


def test_usage_events_of_unknown_types_are_page_views_alone(spark, tmp_path):
    types = "unnest(['signup', 'view', 'click', 'purchase', 'error', 'refund', 'Signup', ' view', '', null]) as event_type"
    ours, theirs = _usage_rows(spark, tmp_path, f"select row_number() over () - 1 as event_id, timestamp '2024-01-01 05:30:00' as ts, event_type from (select {types})")
    assert ours == theirs and len(ours) == 15


def test_usage_events_at_far_and_infinite_times(spark, tmp_path):
    """Far years count to the millisecond, infinite times and nulls have no session, and no row stops the job."""
    far = [f"timestamp '{year}-01-01 01:30:00' + interval ({us}) microsecond" for year in (1, 1600, 9999, 150_000, 290_000) for us in (-1000, -501, -500, -499, 0, 499, 500)]
    odd = ["null::timestamp", "timestamp 'infinity'", "timestamp '-infinity'", "make_timestamp(9223372036854775306)", "make_timestamp(9223372036854774806)"]
    ours, theirs = _usage_rows(spark, tmp_path, f"select row_number() over () - 1 as event_id, ts, 'view' as event_type from (select unnest([{', '.join(far + odd)}]) as ts)")
    assert ours == theirs and len(ours) == 2 * len(far + odd)
    assert sum(session is None for _, _, session, _ in ours) == 6
