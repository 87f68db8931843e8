"""The derived funnel tables have the sizes FIXTURES.md section C records."""

import pytest
from pyspark.sql import functions as F

from helpers import SF0001, SF001
from funnelkit.plans.models import Models


@pytest.mark.parametrize(
    "sf_dir,experts,events,engagements,spend",
    [(SF0001, 1500, 7500, 3119, 512), (SF001, 15000, 75000, 31536, 685)],
)
def test_row_counts(spark, sf_dir, experts, events, engagements, spend):
    m = Models.from_testdata(spark, sf_dir)
    assert m.raw.experts.count() == experts
    assert m.raw.funnel_events.count() == events
    assert m.raw.engagements.count() == engagements
    assert m.raw.daily_channel_spend.count() == spend


def test_stage_reach_sf001(spark):
    m = Models.from_testdata(spark, SF001)
    s = m.expert_funnel_summary
    row = s.selectExpr(
        "count(*) AS n",
        "count_if(reached_signup) AS a",
        "count_if(reached_profile_started) AS b",
        "count_if(reached_profile_completed) AS c",
        "count_if(reached_verification_submitted) AS d",
        "count_if(reached_verified) AS e",
        "count_if(reached_activated) AS f",
        "min(days_to_activate) AS lo",
        "max(days_to_activate) AS hi",
    ).first()
    assert tuple(row) == (15000, 14845, 10215, 6550, 6507, 8931, 5977, 5, 103)


def test_step_pairs_sf001(spark):
    m = Models.from_testdata(spark, SF001)
    agg = m.funnel_step_sessions.groupBy("current_step", "next_step").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("step_duration_hours"), 1).alias("avg"),
        F.expr("round(count_if(required_new_session) * 100.0 / count(*), 1)").cast("double").alias("brk"),
        F.count_if(F.col("step_duration_hours") < 0).alias("neg"),
    )
    got = {(r.current_step, r.next_step): (r.n, r.avg, r.brk, r.neg) for r in agg.collect()}
    assert got[("signup", "profile_started")] == (10111, 19.1, 32.6, 326)
    assert got[("profile_started", "profile_completed")] == (4466, 39.0, 55.1, 510)
    assert got[("profile_completed", "verification_submitted")] == (2807, 4.8, 24.5, 1178)
    assert got[("verification_submitted", "verification_approved")] == (4260, 39.7, 59.2, 405)
    assert got[("verification_submitted", "verification_rejected")] == (600, 46.2, 62.8, 47)
    assert got[("verification_approved", "first_engagement_completed")] == (4307, 1094.3, 98.2, 32)
