"""Diagnostics of the funnel data (ad-hoc in the reference, reports here).

Limits are part of these reports (worst 50, top 20) and carry a full
tie-break so the rows kept are deterministic; Spark runs them as a per-task
top-k merged on the driver side of the plan (TakeOrderedAndProject), never a
full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hours_between, pct, share_pct
from ..functions.vocab import BEFORE_SIGNUP_LIMIT, UNKNOWN_PROFILE_LIMIT


def signup_only(stg_experts: DataFrame, summary: DataFrame) -> DataFrame:
    """Experts who never started a profile (including those with no event at
    all, and skippers straight to later stages), by channel, with the share of
    all such experts."""
    j = stg_experts.select("expert_id", "signup_source").join(
        summary.select("expert_id", "profile_started_at"), "expert_id", "left"
    )
    g = j.where(F.col("profile_started_at").isNull()).groupBy("signup_source").agg(
        F.count(F.lit(1)).alias("signup_only_count")
    )
    return g.select(
        "signup_source",
        "signup_only_count",
        share_pct("signup_only_count", F.sum("signup_only_count").over(Window.partitionBy()), 2).alias("pct_of_total"),
    ).orderBy(F.col("signup_only_count").desc(), "signup_source")


def stage_skips(summary: DataFrame) -> DataFrame:
    """Counts of three skip patterns, from one scan of the summary.

    "Activated without verification" looks at the first engagement alone and
    ignores rejection, unlike the activated stage, as in the reference."""
    g = summary.agg(
        F.count_if(F.col("profile_completed_at").isNotNull() & F.col("profile_started_at").isNull()).alias("a"),
        F.count_if(F.col("verification_submitted_at").isNotNull() & F.col("profile_completed_at").isNull()).alias("b"),
        F.count_if(F.col("first_engagement_at").isNotNull() & F.col("verification_approved_at").isNull()).alias("c"),
    )
    return g.select(
        F.expr(
            "stack(3, 'signup_to_completed_skip', a, 'verification_without_profile', b,"
            " 'activated_without_verification', c) AS (edge_case, expert_count)"
        )
    )


def before_signup(stg_events: DataFrame, stg_experts: DataFrame, limit: int = BEFORE_SIGNUP_LIMIT) -> DataFrame:
    """Non-signup events earlier than the expert's signup, the ``limit`` most
    negative hour differences first."""
    fe = stg_events.where(F.col("event_name") != "signup").select("expert_id", "event_name", "event_at")
    e = stg_experts.select("expert_id", "signup_at")
    j = fe.join(e, "expert_id").where(F.col("event_at") < F.col("signup_at"))
    out = j.select(
        "expert_id",
        "event_name",
        F.col("event_at").alias("event_timestamp"),
        F.col("signup_at").alias("signup_timestamp"),
        hours_between("signup_at", "event_at").alias("hours_before_signup"),
    )
    return out.orderBy("hours_before_signup", "expert_id", "event_name", "event_timestamp", "signup_timestamp").limit(
        limit
    )


def duplicates(stg_events: DataFrame) -> DataFrame:
    """(expert, event_name) pairs seen more than once, counted per event_name."""
    pairs = stg_events.groupBy("expert_id", "event_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (
        pairs.groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("duplicate_pairs"))
        .orderBy(F.col("duplicate_pairs").desc(), "event_name")
    )


def spend_gaps(stg_spend: DataFrame) -> DataFrame:
    """Campaign names with missing days between their first and last spend
    day (grouped by name alone, rows counted as days, as in the reference)."""
    g = stg_spend.groupBy("campaign_name").agg(
        F.min("spend_date").alias("first_spend_date"),
        F.max("spend_date").alias("last_spend_date"),
        F.count(F.lit(1)).alias("days_with_data"),
    )
    expected = F.datediff("last_spend_date", "first_spend_date") + 1
    return (
        g.select(
            "campaign_name",
            "first_spend_date",
            "last_spend_date",
            "days_with_data",
            expected.alias("expected_days"),
            (expected - F.col("days_with_data")).alias("missing_days"),
        )
        .where(F.col("missing_days") > 0)
        .orderBy(F.col("missing_days").desc(), "campaign_name")
    )


def unknown_profile(ewe: DataFrame, limit: int = UNKNOWN_PROFILE_LIMIT) -> DataFrame:
    """The unknown channel by country and industry: the ``limit`` largest cells."""
    n_act = F.count_if("reached_activated")
    g = (
        ewe.where(F.col("signup_source") == "unknown")
        .groupBy("country", "industry")
        .agg(
            F.count(F.lit(1)).alias("expert_count"),
            n_act.alias("activated_count"),
            pct(n_act, F.count(F.lit(1)), 2).alias("activation_rate"),
        )
    )
    return g.orderBy(F.col("expert_count").desc(), "country", "industry").limit(limit)
