"""What a larger table must not change: plans that stay bounded, and the same rows."""

import os
from datetime import timedelta

import pytest

from helpers import SF0001, expert, models, ts
from funnelkit.operators import quality, sessions, slices
from funnelkit.session import scratch
from funnelkit.sources.fixtures import load_fixture

T0 = ts("2024-02-05 09:00:00")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def graph(spark):
    ev = lambda i, x, h: (i, x, "signup", T0 + timedelta(hours=h), None)
    return models(
        spark,
        experts=[expert(1), expert(2), expert(2)],
        events=[ev(1, 1, 0), ev(1, 1, 1), ev(2, None, 2), ev(4, 9, 3), ev(5, 9, 4), ev(3, 2, 90)],
    )


def test_known_keys_are_not_broadcast(graph):
    """One row a parent: their number has no bound that a driver could hold."""
    found = quality.failing_rows(graph, "relationships", "funnel_events", "expert_id")
    assert "Broadcast" not in plan(found) and sorted((r.event_id, r.expert_id) for r in found.collect()) == [(4, 9), (5, 9)]
    assert "Broadcast" not in plan(graph.scoped(channel="organic").raw.funnel_events)


def test_repeated_keys_are_found_once(graph):
    """The listing reads keys that were stored: it deals no table by its key."""
    source = quality.failing_rows(graph, "unique", "funnel_events", "event_id")
    staged = quality.failing_rows(graph, "unique", "stg_funnel_events", "event_id")
    for found in (source, staged):
        assert "hashpartitioning" not in plan(found) and [r.event_id for r in found.collect()] == [1, 1]
    assert quality._repeated_keys(graph, "stg_funnel_events", "event_id") is quality._repeated_keys(graph, "funnel_events", "event_id")


def test_raw_tables_are_derived_on_first_use(spark):
    base = scratch(spark, "fixture")
    raw = load_fixture(spark, SF0001, base)
    assert raw.funnel_events.count() > 0
    there = lambda: sorted(os.listdir(base.removeprefix("file://")))
    assert there() == ["funnel_events"]
    assert set(raw.as_dict()) == set(there()) == {"experts", "funnel_events", "engagements", "daily_channel_spend"}


def test_larger_tables_fill_more_tasks(spark, monkeypatch):
    rows = [(i, None if i % 11 == 0 else i % 37, "x", T0 + timedelta(hours=i * 7 % 500), i % 3) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, expert_id long, event_name string, event_at timestamp_ntz, stage_order int")
    monkeypatch.setattr(slices, "TASK_ROWS", 20)
    found = sessions.expert_sessions(events)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert slices.task_parts(spark, 600) == 30 and slices.task_parts(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(sessions.expert_sessions(events, strategy="window"))
    report = quality.timestamp_ordering(events.select("expert_id", "event_at", "stage_order", "event_id"))
    monkeypatch.undo()
    assert report.collect() == quality.timestamp_ordering(events.select("expert_id", "event_at", "stage_order", "event_id")).collect()
