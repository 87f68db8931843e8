"""The rows behind a failed check, and global ranks in slices."""

from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import expert, models, ts
from funnelkit.functions.ranks import down, global_row_numbers
from funnelkit.operators import quality, reports

T0 = ts("2024-02-05 09:00:00")


@pytest.fixture(scope="module")
def graph(spark):
    ev = lambda i, x, name, h: (i, x, name, None if h is None else T0 + timedelta(hours=h), None)
    return models(
        spark,
        experts=[expert(1, source="Paid_Search "), expert(2, source="tv"), expert(2, source="organic"), expert(3, source="paid_social", campaign="c")],
        events=[ev(1, 1, "signup", 0), ev(1, 1, "profile_started", 1), ev(2, 1, "Signup ", 2), ev(3, 9, "signup", 0), ev(4, None, "signup", 0), ev(5, 3, "other", 0),
                ev(6, 3, "verification_submitted", None), ev(7, 3, "signup", 5)],
        engagements=[(1, 1, "survey", T0, None, "x"), (2, 9, "call", T0, Decimal("0.00"), "x"), (3, 3, "survey", T0, Decimal("5.00"), "x")],
        spend=[(T0.date(), None, "c", Decimal("1.00"), 1, 1)],
    )


def listed(m, check):
    return sorted((r.table_name, r.column_name, r.row_key, r.value or "") for r in quality.failures(m, check).collect())


def test_generic_failures(graph):
    assert [x for x in listed(graph, "unique") if not x[0].startswith("expert_")] == [
        ("experts", "expert_id", "2", "2"), ("experts", "expert_id", "2", "2"), ("funnel_events", "event_id", "1", "1"), ("funnel_events", "event_id", "1", "1"),
        ("stg_experts", "expert_id", "2", "2"), ("stg_experts", "expert_id", "2", "2"), ("stg_funnel_events", "event_id", "1", "1"), ("stg_funnel_events", "event_id", "1", "1")]
    assert listed(graph, "relationships") == [("engagements", "expert_id", "2", "9"), ("funnel_events", "expert_id", "3", "9")]
    nulls = listed(graph, "not_null")
    for found in (("funnel_events", "expert_id", "4", ""), ("funnel_events", "event_timestamp", "6", ""), ("stg_funnel_events", "stage_order", "5", ""),
                  ("engagements", "payout_amount", "1", ""), ("daily_channel_spend", "channel", "2024-02-05|c", ""), ("expert_funnel_summary", "expert_id", "", "")):
        assert found in nulls
    accepted = listed(graph, "accepted_values")
    assert ("stg_experts", "signup_source", "2", "tv") in accepted and ("stg_funnel_events", "event_name", "5", "other") in accepted
    assert ("experts", "signup_source", "1", "Paid_Search ") in accepted and ("stg_engagements", "engagement_type", "2", "call") in accepted
    assert not [x for x in accepted if x[:2] == ("stg_experts", "signup_source") and x[3] != "tv"]


def test_failing_rows_keep_their_columns(graph):
    rows = quality.failing_rows(graph, "unique", "experts", "expert_id")
    assert rows.columns == graph.raw.experts.columns and {r.signup_source for r in rows.collect()} == {"tv", "organic"}
    assert [r.event_id for r in quality.failing_rows(graph, "relationships", "funnel_events", "expert_id").collect()] == [3]


def test_listing_agrees_with_the_report(graph):
    report = {(r.check_name, r.table_name, r.column_name): r.failing_rows for r in quality.run_all(graph).collect()}
    for check in ("not_null", "accepted_values", "relationships"):
        found = {}
        for t, c, _, _ in listed(graph, check):
            found[(check, t, c)] = found.get((check, t, c), 0) + 1
        assert found == {k: n for k, n in report.items() if k[0] == check and n}


def test_ratio_failures(graph):
    assert listed(graph, "null_payout") == [("stg_engagements", "payout_amount", "1", ""), ("stg_engagements", "payout_amount", "2", "0.00")]
    # expert 2 with source tv is neither paid nor unpaid by name: it counts as paid, as the check has it
    assert listed(graph, "null_utm") == [("stg_experts", "utm_campaign", "1", "paid_search"), ("stg_experts", "utm_campaign", "2", "tv")]
    assert listed(graph, "timestamp_ordering") == [("stg_funnel_events", "stage_order", "2", "1 after 2")]
    with pytest.raises(ValueError):
        quality.failures(graph, "no such check")


def test_misplaced_events_in_slices(spark):
    """One expert's events cut into many slices: same rows as with one window."""
    rows = [(i, 1, i * 7 % 5, None if i % 50 == 0 else T0 + timedelta(hours=i * 13 % 97)) for i in range(600)] + [(1000 + i, 2, 5 - i, T0) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id bigint, expert_id bigint, stage_order int, event_at timestamp_ntz")
    want = sorted(quality.misplaced_events(df, parts=1).collect())
    assert len(want) > 50 and sorted(quality.misplaced_events(df, parts=60).collect()) == want
    one, many = (quality.timestamp_ordering(df, parts=p).first() for p in (1, 60))
    assert one == many and one.total_experts == 2


def test_global_row_numbers(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 11).cast("double")).alias("v")).repartition(5)
    orders = {"up": [F.col("v"), F.col("id")], "down": [down(F.col("v")), F.col("id")]}
    one = sorted(global_row_numbers(df, orders, 3000).collect())
    many = global_row_numbers(df, orders, 3000, one_task_rows=10)
    assert many.columns == ["id", "v", "up", "down"] and sorted(many.collect()) == one
    assert sorted(r.down for r in one) == list(range(1, 3001)) and all(r.v is None for r in one if r.down > 2571)


def test_campaign_ranks_in_slices(spark):
    experts = [expert(i, source="paid_search", campaign=f"c{i % 40:02d}") for i in range(400)]
    m = models(spark, experts=experts, events=[(i, i, "first_engagement_completed", T0, None) for i in range(0, 400, 3)])
    wide = [sorted(reports.campaign_deep_dive(m.expert_with_engagement, m.channel_spend_summary, min_signups=5, one_task_rows=n).collect()) for n in (1000, 1)]
    assert wide[0] == wide[1] and [r.rank_by_volume for r in wide[0]] == list(range(1, 41))
