"""Expert enrichment (profile + funnel + payouts) and spend roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY_SUM = "decimal(28,2)"


def expert_payouts(stg_engagements: DataFrame) -> DataFrame:
    """Per expert: engagement count, total payout, first engagement, LTV proxy.

    The LTV proxy is the total payout over all time (no 12-month limit, as
    in the reference).  Partial aggregation: a hot expert combines map-side.
    """
    return stg_engagements.groupBy("expert_id").agg(
        F.count(F.lit(1)).alias("total_engagements"),
        F.sum("payout_amount").cast(MONEY_SUM).alias("total_payout"),
        F.min("engaged_at").alias("first_engagement_date"),
        F.sum("payout_amount").cast(MONEY_SUM).alias("ltv_12m_proxy"),
    )


def expert_with_engagement(stg_experts: DataFrame, summary: DataFrame, stg_engagements: DataFrame) -> DataFrame:
    """One row per expert: attributes, funnel progression, payouts.

    Experts without events keep NULL reached flags (only payouts are
    coalesced).  Plan: both right sides are aggregates already
    hash-partitioned by expert_id, so only the expert table is exchanged;
    each right side has one row per key, so the joins cannot fan out.
    """
    e = stg_experts.alias("e")
    f = summary.alias("f")
    p = expert_payouts(stg_engagements).alias("p")
    j = e.join(f, F.col("e.expert_id") == F.col("f.expert_id"), "left").join(
        p, F.col("e.expert_id") == F.col("p.expert_id"), "left"
    )
    return j.select(
        F.col("e.expert_id").alias("expert_id"),
        "e.signup_at",
        "e.signup_date",
        "e.signup_week",
        "e.signup_source",
        "e.utm_campaign",
        "e.is_paid_channel",
        "e.country",
        "e.industry",
        "f.reached_signup",
        "f.reached_profile_started",
        "f.reached_profile_completed",
        "f.reached_verification_submitted",
        "f.reached_verified",
        "f.reached_activated",
        "f.is_rejected",
        "f.days_to_activate",
        F.col("f.signup_at").alias("funnel_signup_at"),
        "f.first_engagement_at",
        F.coalesce("p.total_engagements", F.lit(0).cast("bigint")).alias("total_engagements"),
        F.coalesce("p.total_payout", F.lit(0).cast(MONEY_SUM)).alias("total_payout"),
        F.coalesce("p.ltv_12m_proxy", F.lit(0).cast(MONEY_SUM)).alias("ltv_12m_proxy"),
    )


def channel_spend_summary(stg_spend: DataFrame) -> DataFrame:
    """Campaign totals, each row carrying its channel's totals.

    The channel totals are a window sum over the (small) campaign aggregate
    instead of a second aggregate joined back: one shuffle less.  Rows with a
    NULL channel are left out, as an inner join on channel would.
    """
    camp = stg_spend.where(F.col("channel").isNotNull()).groupBy("channel", "campaign_name").agg(
        F.sum("spend_usd").cast(MONEY_SUM).alias("campaign_spend"),
        F.sum("impressions").cast("bigint").alias("campaign_impressions"),
        F.sum("clicks").cast("bigint").alias("campaign_clicks"),
    )
    by_channel = Window.partitionBy("channel")
    return camp.select(
        "*",
        F.sum("campaign_spend").over(by_channel).cast(MONEY_SUM).alias("channel_total_spend"),
        F.sum("campaign_impressions").over(by_channel).cast("bigint").alias("channel_total_impressions"),
        F.sum("campaign_clicks").over(by_channel).cast("bigint").alias("channel_total_clicks"),
    )
