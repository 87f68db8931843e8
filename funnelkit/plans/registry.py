"""Every public report as ``(spark, sf_dir) -> DataFrame``, keyed by name.

Each callable builds its report through the session's model graph of the
test folder (``graph``), whose raw tables are derived from the test parquet
files once (``sources.fixtures``); nothing is collected.
"""

from __future__ import annotations

import threading
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import dashboard, edge_cases, funnel, quality, reports, sessions, steps
from ..sources.fixtures import load_fixture, read_testdata
from .models import Models

Query = Callable[[SparkSession, str], DataFrame]


# One model graph per (session, data folder).  The four raw tables are
# derived from the test tables and loaded once (written under the session's
# spark.checkpoint.dir and read back, as the reference loads its CSVs into
# warehouse tables); every report then plans from those stored tables.
_GRAPHS: "weakref.WeakKeyDictionary[SparkSession, dict[str, Models]]" = weakref.WeakKeyDictionary()
_LOCK = threading.Lock()


def graph(spark: SparkSession, sf_dir: str) -> Models:
    """The model graph of a test-data folder for this session (built once)."""
    # zone-free timestamps are differenced through the session zone: pin UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    with _LOCK:
        per_session = _GRAPHS.setdefault(spark, {})
        if sf_dir not in per_session:
            per_session[sf_dir] = Models(load_fixture(spark, sf_dir))
        return per_session[sf_dir]


def _events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = read_testdata(spark, sf_dir, "events")["events"]
    return sessions.event_sessions(ev)


QUERIES: dict[str, Callable[[Models], DataFrame]] = {
    # staging
    "stg_experts": lambda m: m.stg_experts,
    "stg_funnel_events": lambda m: m.stg_funnel_events,
    "stg_engagements": lambda m: m.stg_engagements,
    "stg_daily_channel_spend": lambda m: m.stg_daily_channel_spend,
    # intermediate
    "expert_funnel_summary": lambda m: m.expert_funnel_summary,
    "expert_with_engagement": lambda m: m.expert_with_engagement,
    "channel_spend_summary": lambda m: m.channel_spend_summary,
    "expert_sessions": lambda m: m.expert_sessions,
    "funnel_step_sessions": lambda m: m.funnel_step_sessions,
    # marts
    "funnel_conversion": lambda m: funnel.funnel_conversion(m.expert_funnel_summary),
    "step_timing": lambda m: steps.step_timing(m.funnel_step_sessions),
    "sessions_to_activate": lambda m: steps.sessions_to_activate(m.expert_sessions),
    "funnel_step_analysis": lambda m: steps.funnel_step_analysis(m.expert_sessions),
    "cohort_conversion": lambda m: reports.cohort_conversion(m.expert_with_engagement),
    "period_comparison": lambda m: reports.period_comparison(m.expert_with_engagement),
    "channel_performance": lambda m: reports.channel_performance(m.expert_with_engagement, m.channel_spend_summary),
    "channel_performance_summed": lambda m: reports.channel_performance(
        m.expert_with_engagement, m.channel_spend_summary, spend_mode="summed"
    ),
    "campaign_deep_dive": lambda m: reports.campaign_deep_dive(m.expert_with_engagement, m.channel_spend_summary),
    # diagnostics
    "edge_signup_only": lambda m: edge_cases.signup_only(m.stg_experts, m.expert_funnel_summary),
    "edge_stage_skips": lambda m: edge_cases.stage_skips(m.expert_funnel_summary),
    "edge_before_signup": lambda m: edge_cases.before_signup(m.stg_funnel_events, m.stg_experts),
    "edge_duplicates": lambda m: edge_cases.duplicates(m.stg_funnel_events),
    "edge_spend_gaps": lambda m: edge_cases.spend_gaps(m.stg_daily_channel_spend),
    "edge_unknown_profile": lambda m: edge_cases.unknown_profile(m.expert_with_engagement),
    # data quality
    "dq_not_null": lambda m: quality.source_and_model_tests(m)["dq_not_null"],
    "dq_unique": lambda m: quality.source_and_model_tests(m)["dq_unique"],
    "dq_accepted_values": lambda m: quality.source_and_model_tests(m)["dq_accepted_values"],
    "dq_relationships": lambda m: quality.source_and_model_tests(m)["dq_relationships"],
    "dq_null_utm": lambda m: quality.null_utm(m.stg_experts),
    "dq_timestamp_ordering": lambda m: quality.timestamp_ordering(m.stg_funnel_events),
    "dq_no_activated_rejected": lambda m: quality.activated_rejected(m.expert_funnel_summary),
    "dq_null_payout": lambda m: quality.null_payout(m.stg_engagements),
    **{f"dq_failures_{c}": (lambda c: lambda m: quality.failures(m, c))(c) for c in (
        "not_null", "unique", "accepted_values", "relationships", "null_utm", "timestamp_ordering", "no_activated_rejected", "null_payout")},
    # dashboard datasets
    "dash_kpis": dashboard.kpis,
    "dash_funnel": dashboard.funnel_bars,
    "dash_step_detail": dashboard.step_detail,
    "dash_never_submitted": dashboard.never_submitted,
    "dash_never_submitted_by_channel": dashboard.never_submitted_by_channel,
    "dash_never_submitted_stale": dashboard.never_submitted_stale,
    "dash_recovery_whatif": dashboard.recovery_whatif,
    "dash_weekly_activation": dashboard.weekly_activation,
    "dash_monthly_days_to_activate": dashboard.monthly_days_to_activate,
    "dash_channel_bubble": dashboard.channel_bubble,
    "dash_monthly_signups": dashboard.monthly_signups,
    "dash_channel_costs": dashboard.channel_costs,
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: (lambda f: lambda spark, sf_dir: f(graph(spark, sf_dir)))(f) for name, f in QUERIES.items()}
    out["expert_sessions_events"] = _events_sessions
    return out
