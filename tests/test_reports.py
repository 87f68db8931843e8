"""Hand-written cases (FIXTURES.md D) with answers worked out by hand."""

from datetime import timedelta
from decimal import Decimal

from helpers import d, expert, models, ts
from funnelkit.operators import dashboard, edge_cases, funnel, quality, reports, steps

T0 = ts("2024-02-05 09:00:00")  # a Monday


def ev(eid, xid, name, hours, base=T0):
    return (eid, xid, name, base + timedelta(hours=hours), None)


SIX = ["signup", "profile_started", "profile_completed", "verification_submitted", "verification_approved",
       "first_engagement_completed"]


def test_funnel_stages_skip_and_signup_only(spark):
    # D2: expert 1 goes through all six stages, 2 skips profile_started, 3 signs up only
    events = [ev(10 + i, 1, n, 5 * i) for i, n in enumerate(SIX)]
    events += [ev(20, 2, "signup", 0), ev(21, 2, "profile_completed", 3)]
    events += [ev(30, 3, "signup", 0)]
    m = models(spark, experts=[expert(1), expert(2), expert(3)], events=events)
    rows = {r.stage: r for r in funnel.funnel_conversion(m.expert_funnel_summary).collect()}
    assert [rows[s].experts_reached for s in ["signup", "profile_started", "profile_completed",
                                              "verification_submitted", "verified", "activated"]] == [3, 1, 2, 1, 1, 1]
    assert rows["signup"].conversion_from_previous is None
    assert rows["profile_completed"].conversion_from_previous == 200.0
    assert rows["profile_started"].conversion_from_signup == 33.33
    skips = {r.edge_case: r.expert_count for r in edge_cases.stage_skips(m.expert_funnel_summary).collect()}
    assert skips == {"signup_to_completed_skip": 1, "verification_without_profile": 0,
                     "activated_without_verification": 0}
    only = {r.signup_source: (r.signup_only_count, r.pct_of_total)
            for r in edge_cases.signup_only(m.stg_experts, m.expert_funnel_summary).collect()}
    assert only == {"organic": (2, 100.0)}
    pairs = {(r.expert_id, r.current_step, r.next_step): r.step_duration_hours
             for r in m.funnel_step_sessions.collect()}
    assert pairs[(1, "signup", "profile_started")] == 5
    assert (2, "signup", "profile_completed") not in pairs  # only canonical neighbours pair
    assert len([k for k in pairs if k[0] == 1]) == 5


def test_rejected_excluded_and_flagged(spark):
    events = [ev(1, 1, "signup", 0), ev(2, 1, "verification_submitted", 1), ev(3, 1, "verification_rejected", 2),
              ev(4, 1, "first_engagement_completed", 30), ev(5, 1, "Verification_Approved ", 3)]
    m = models(spark, experts=[expert(1)], events=events)
    s = m.expert_funnel_summary.first()
    assert s.is_rejected and not s.reached_verified and not s.reached_activated
    assert [r.expert_id for r in quality.activated_rejected(m.expert_funnel_summary).collect()] == [1]


def test_campaign_without_activation_or_spend(spark):
    # D3 and D4: two campaigns of one channel with spend, one campaign without spend
    experts = [expert(1, source="paid_search", campaign="c1"), expert(2, source="paid_search", campaign="c2"),
               expert(3, source="Paid_Search ", campaign="C3")]
    events = [ev(1, 1, "signup", 0), ev(2, 1, "first_engagement_completed", 48), ev(3, 2, "signup", 0),
              ev(4, 3, "signup", 0)]
    engagements = [(1, 1, "survey", T0 + timedelta(days=2), Decimal("50.00"), "x")]
    spend = [(d("2024-02-05"), "paid_search", "c1", Decimal("100.00"), 1000, 10),
             (d("2024-02-06"), "paid_search", "c1", Decimal("20.00"), 100, 1),
             (d("2024-02-05"), "paid_search", "c2", Decimal("30.00"), 300, 3)]
    m = models(spark, experts=experts, events=events, engagements=engagements, spend=spend)
    camp = {r.utm_campaign: r for r in reports.campaign_deep_dive(m.expert_with_engagement, m.channel_spend_summary).collect()}
    assert camp["c2"].campaign_spend == Decimal("30.00")
    assert camp["c2"].cost_per_activated is None and camp["c2"].ltv_to_cac_ratio is None
    assert camp["c3"].campaign_spend is None and camp["c3"].cost_per_signup is None
    assert camp["c1"].cost_per_activated == 120.0 and camp["c1"].ltv_to_cac_ratio == round(50 / 120, 2)
    ch = {r.signup_source: r for r in reports.channel_performance(m.expert_with_engagement, m.channel_spend_summary).collect()}
    assert ch["paid_search"].total_spend == Decimal("150.00")  # once, not once per campaign
    summed = {r.signup_source: r for r in reports.channel_performance(
        m.expert_with_engagement, m.channel_spend_summary, spend_mode="summed").collect()}
    assert summed["paid_search"].total_spend == Decimal("300.00")  # the reference as written
    assert ch["paid_search"].cost_per_signup == 50.0
    gaps = {r.campaign_name: r.missing_days for r in edge_cases.spend_gaps(m.stg_daily_channel_spend).collect()}
    assert gaps == {}


def test_activation_window_and_weeks(spark):
    # D5: activation on day 60 counts, day 61 does not, negative days count
    sunday = ts("2024-02-04 12:00:00")
    experts = [expert(1, signup="2024-02-04 12:00:00"), expert(2, signup="2024-02-05 12:00:00"),
               expert(3, signup="2024-02-05 13:00:00")]
    events = [ev(1, 1, "signup", 0, sunday), ev(2, 1, "first_engagement_completed", 24 * 60, sunday),
              ev(3, 2, "signup", 0, T0), ev(4, 2, "first_engagement_completed", 24 * 61, T0),
              ev(5, 3, "signup", 0, T0), ev(6, 3, "first_engagement_completed", -48, T0)]
    m = models(spark, experts=experts, events=events)
    days = {r.expert_id: r.days_to_activate for r in m.expert_funnel_summary.collect()}
    assert days == {1: 60, 2: 61, 3: -2}
    weeks = {r.signup_week: r for r in reports.cohort_conversion(m.expert_with_engagement).collect()}
    # D6: a Sunday belongs to the week starting the Monday before
    assert set(weeks) == {d("2024-01-29"), d("2024-02-05")}
    assert weeks[d("2024-01-29")].activated_count == 1
    assert weeks[d("2024-02-05")].activated_count == 1  # day 61 out, day -2 in
    assert weeks[d("2024-02-05")].median_days_to_activate == -2
    assert weeks[d("2024-02-05")].wow_activation_rate_change == 50.0 - 100.0


def test_period_edges(spark):
    # D6/D7: 23:59 on Sep 30 is Q3; zero activations -> pooled 0 -> not significant
    experts = [expert(1, signup="2024-09-30 23:59:00"), expert(2, signup="2024-10-01 00:00:00")]
    m = models(spark, experts=experts, events=[ev(1, 1, "signup", 0), ev(2, 2, "signup", 0)])
    (r,) = reports.period_comparison(m.expert_with_engagement).collect()
    assert (r.q3_signups, r.q4_signups, r.q3_activation_rate, r.q4_activation_rate) == (1, 1, 0.0, 0.0)
    assert r.activation_rate_significance == "NOT SIGNIFICANT" and r.avg_days_pct_change is None
    # one period empty: no row
    m = models(spark, experts=[expert(1, signup="2024-09-30 23:59:00")], events=[ev(1, 1, "signup", 0)])
    assert reports.period_comparison(m.expert_with_engagement).count() == 0


def test_period_significance(spark):
    experts, events = [], []
    for i in range(200):
        q3 = i < 100
        eid = i + 1
        experts.append(expert(eid, signup="2024-08-01 10:00:00" if q3 else "2024-11-01 10:00:00"))
        if (q3 and i < 60) or (not q3 and i < 110):  # 60 % vs 10 %
            base = ts("2024-08-01 10:00:00" if q3 else "2024-11-01 10:00:00")
            events += [ev(eid * 10, eid, "signup", 0, base), ev(eid * 10 + 1, eid, "first_engagement_completed", 240, base)]
    m = models(spark, experts=experts, events=events)
    (r,) = reports.period_comparison(m.expert_with_engagement).collect()
    assert (r.q3_activation_rate, r.q4_activation_rate, r.activation_rate_pp_change) == (60.0, 10.0, -50.0)
    assert r.activation_rate_significance == "SIGNIFICANT (p < 0.05)"
    assert (r.q3_avg_days, r.q4_avg_days, r.avg_days_pct_change) == (10.0, 10.0, 0.0)


def test_quality_reports(spark):
    # D8 unknown event name, D9 orphans, D10 NULL payout
    experts = [expert(1, source="paid_search"), expert(2, source="Bogus")]
    events = [ev(1, 1, "signup", 0), ev(2, 1, "clicked_banner", 1), ev(3, 99, "signup", 0), ev(3, 1, "signup", 2)]
    engagements = [(1, 1, "survey", T0, None, "x"), (2, 98, "interview", T0, Decimal("10.00"), "x"),
                   (3, 1, "survey", T0, Decimal("0.00"), "x"), (4, 1, "survey", T0, Decimal("5.00"), "x")]
    m = models(spark, experts=experts, events=events, engagements=engagements)
    t = quality.source_and_model_tests(m)
    nn = {(r.table_name, r.column_name): r.failing_rows for r in t["dq_not_null"].collect()}
    assert nn[("stg_funnel_events", "stage_order")] == 1
    assert nn[("engagements", "payout_amount")] == 1
    uq = {(r.table_name, r.column_name): r.failing_rows for r in t["dq_unique"].collect()}
    assert uq[("funnel_events", "event_id")] == 1 and uq[("experts", "expert_id")] == 0
    rel = {r.table_name: r.failing_rows for r in t["dq_relationships"].collect()}
    assert rel == {"funnel_events": 1, "engagements": 1}
    av = {(r.table_name, r.column_name): r.failing_rows for r in t["dq_accepted_values"].collect()}
    assert av[("stg_experts", "signup_source")] == 1 and av[("stg_funnel_events", "event_name")] == 1
    (p,) = quality.null_payout(m.stg_engagements).collect()
    assert (p.total_engagements, p.null_or_zero_payouts, p.failed) == (4, 2, True)
    payout = {r.expert_id: r.total_payout for r in m.expert_with_engagement.collect()}
    assert payout == {1: Decimal("5.00"), 2: Decimal("0.00")}  # NULL ignored by the sum
    (u,) = quality.null_utm(m.stg_experts).collect()
    assert (u.total_experts, u.paid_with_all_nulls, u.paid_experts, u.failed) == (2, 2, 2, True)


def test_timestamp_ordering(spark):
    events = [ev(1, 1, "signup", 0), ev(2, 1, "profile_completed", 1), ev(3, 1, "profile_started", 2),
              ev(4, 2, "signup", 0), ev(5, 2, "profile_started", 1)]
    m = models(spark, experts=[expert(1), expert(2)], events=events)
    (r,) = quality.timestamp_ordering(m.stg_funnel_events).collect()
    assert (r.total_experts, r.experts_with_violations, r.failure_ratio, r.failed) == (2, 1, 0.5, True)


def test_step_analysis_and_dashboard(spark):
    events = []
    for x in range(1, 5):
        hours = [0, 2, 30, 31, 80, 400]
        for i, n in enumerate(SIX[: 2 + x]):
            events.append(ev(x * 10 + i, x, n, hours[i]))
    m = models(spark, experts=[expert(x) for x in range(1, 5)], events=events)
    fsa = {r.stage: r for r in steps.funnel_step_analysis(m.expert_sessions).collect()}
    assert fsa["profile_completed"].session_break_rate_pct == 100.0  # 28 h gap > 24 h
    assert fsa["profile_started"].session_break_rate_pct == 0.0
    assert fsa["activated"].experts_reached == 1
    assert fsa["activated"].avg_sessions_to_activate == 4.0  # 0,2 | 30,31 | 80 | 400
    assert fsa["verified"].from_step == "verification_submitted"
    assert fsa["profile_completed"].dropoff_rate_pct == 0.0
    assert fsa["verification_submitted"].dropoff_rate_pct == 25.0
    k = dashboard.kpis(m).first()
    assert k.biggest_dropoff_stage == "activated" and k.biggest_dropoff_pct == 50.0
    assert k.never_submitted == 1 and k.never_submitted_pct == 25.0
    w = dashboard.recovery_whatif(m).first()
    assert (w.never_submitted, w.submitted, w.recovered_experts, w.submission_lift_pct) == (1, 3, 0, 8.3)
    bands = {r.stage: r.drop_band for r in dashboard.funnel_bars(m).collect()}
    assert bands["signup"] is None and bands["activated"] == "high" and bands["verified"] == "medium"
    assert bands["profile_completed"] == "low"
    scoped = dashboard.never_submitted(m.scoped(channel="referral")).first()
    assert scoped.completed_profiles == 0
    assert dashboard.never_submitted(m, channel="organic").first().completed_profiles == 4
    assert dashboard.kpis(m, industry="none such").first().never_submitted == 0


def test_timestamp_ordering_across_slices_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows, eid = [], 0
    for x in range(1, 30):
        n = 400 if x == 1 else rnd.randint(1, 12)  # expert 1 is hot
        for _ in range(n):
            eid += 1
            rows.append((eid, x, rnd.choice(SIX), T0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), None))
    m = models(spark, experts=[expert(x) for x in range(1, 30)], events=rows)
    (r,) = quality.timestamp_ordering(m.stg_funnel_events).collect()
    order = {n: i + 1 for i, n in enumerate(SIX)}
    bad = set()
    by_x = {}
    for e, x, n, t, _ in rows:
        by_x.setdefault(x, []).append((t, order[n], e))
    for x, evs in by_x.items():
        evs.sort()
        if any(b[1] < a[1] for a, b in zip(evs, evs[1:])):
            bad.add(x)
    assert (r.total_experts, r.experts_with_violations) == (len(by_x), len(bad))
    for parts in (1, 9, 200):  # the hot expert in one window, and in many slices
        (rb,) = quality.timestamp_ordering(m.stg_funnel_events, parts=parts).collect()
        assert rb.experts_with_violations == len(bad)


def test_scoped_by_industry_and_gap_parameter(spark):
    experts = [expert(1, industry="tech"), expert(2, industry=" Health "), expert(3, source="referral", industry="tech")]
    events = [ev(1, 1, "signup", 0), ev(2, 1, "profile_started", 2), ev(3, 2, "signup", 0), ev(4, 3, "signup", 0),
              ev(5, 3, "profile_started", 30)]
    m = models(spark, experts=experts, events=events)
    tech = funnel.funnel_conversion(m.scoped(industry="tech").expert_funnel_summary).collect()
    assert {r.stage: r.experts_reached for r in tech}["signup"] == 2
    health = m.scoped(industry="Health")
    assert health.stg_experts.count() == 1 and health.stg_funnel_events.count() == 1
    both = m.scoped(channel="referral", industry="tech")
    assert [r.expert_id for r in both.stg_experts.collect()] == [3]
    # the session gap is a parameter: at 60 minutes expert 3's 30 h gap and
    # expert 1's 2 h gap both split
    from funnelkit.plans.models import Models

    short = Models(m.raw, session_gap_minutes=60)
    n = {r.expert_id: r.n for r in short.expert_sessions.groupBy("expert_id").agg({"session_number": "max"})
         .withColumnRenamed("max(session_number)", "n").collect()}
    assert n == {1: 2, 2: 1, 3: 2}


def test_monthly_signups_lose_no_channel(spark):
    from funnelkit.operators import dashboard

    m = models(spark, experts=[expert(1), expert(2, source="podcast"), expert(3, source=None), expert(4, source="referral")])
    (row,) = dashboard.monthly_signups(m).collect()
    assert (row.organic, row.referral, row.other, row.total) == (1, 1, 2, 4)
