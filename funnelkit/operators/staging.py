"""Staging: cast, trim, lower-case, and add the few derived flags.

One narrow projection per raw table; no shuffle.  Keys are passed through
uncast.  Timestamps stay TIMESTAMP_NTZ (zone-free instants, as loaded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean, week_start
from ..functions.vocab import PAID_CHANNELS, STAGE_ORDER


def stg_experts_columns() -> list[Column]:
    ts = F.col("signup_date").cast("timestamp_ntz")
    source = clean("signup_source")
    return [
        F.col("expert_id"),
        ts.alias("signup_at"),
        F.to_date(ts).alias("signup_date"),
        week_start(F.to_date(ts)).alias("signup_week"),
        source.alias("signup_source"),
        clean("utm_campaign").alias("utm_campaign"),
        clean("utm_medium").alias("utm_medium"),
        clean("utm_source").alias("utm_source"),
        F.trim("country").alias("country"),
        F.trim("industry").alias("industry"),
        F.when(source.isin(PAID_CHANNELS), F.lit(True)).otherwise(F.lit(False)).alias("is_paid_channel"),
    ]


def stg_experts(experts: DataFrame) -> DataFrame:
    return experts.select(*stg_experts_columns())


def stage_order_of(name_col) -> Column:
    """Canonical stage order of a cleaned event name; NULL when unknown."""
    expr = None
    for name, order in STAGE_ORDER:
        expr = F.when(name_col == name, F.lit(order)) if expr is None else expr.when(name_col == name, F.lit(order))
    return expr


def stg_funnel_events_columns() -> list[Column]:
    ts = F.col("event_timestamp").cast("timestamp_ntz")
    name = clean("event_name")
    return [
        F.col("event_id"),
        F.col("expert_id"),
        name.alias("event_name"),
        ts.alias("event_at"),
        F.to_date(ts).alias("event_date"),
        F.col("event_properties"),
        stage_order_of(name).alias("stage_order"),
        (name == F.lit("verification_rejected")).alias("is_rejected"),
    ]


def stg_funnel_events(funnel_events: DataFrame) -> DataFrame:
    return funnel_events.select(*stg_funnel_events_columns())


def stg_engagements_columns() -> list[Column]:
    ts = F.col("engagement_date").cast("timestamp_ntz")
    return [
        F.col("engagement_id"),
        F.col("expert_id"),
        clean("engagement_type").alias("engagement_type"),
        ts.alias("engaged_at"),
        F.to_date(ts).alias("engagement_date"),
        F.col("payout_amount").cast("decimal(18,2)").alias("payout_amount"),
        F.trim("client_industry").alias("client_industry"),
    ]


def stg_engagements(engagements: DataFrame) -> DataFrame:
    return engagements.select(*stg_engagements_columns())


def stg_daily_channel_spend_columns() -> list[Column]:
    return [
        F.col("date").cast("date").alias("spend_date"),
        clean("channel").alias("channel"),
        clean("campaign_name").alias("campaign_name"),
        F.col("spend_usd").cast("decimal(18,2)").alias("spend_usd"),
        F.col("impressions").cast("bigint").alias("impressions"),
        F.col("clicks").cast("bigint").alias("clicks"),
    ]


def stg_daily_channel_spend(spend: DataFrame) -> DataFrame:
    return spend.select(*stg_daily_channel_spend_columns())


STAGING_COLUMNS = {
    "experts": ("stg_experts", stg_experts_columns),
    "funnel_events": ("stg_funnel_events", stg_funnel_events_columns),
    "engagements": ("stg_engagements", stg_engagements_columns),
    "daily_channel_spend": ("stg_daily_channel_spend", stg_daily_channel_spend_columns),
}
