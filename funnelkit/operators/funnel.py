"""The event-stream pivot (one row per expert) and the stage-count reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import days_between, pct
from ..functions.vocab import REPORT_STAGES, STAGE_TIME_COLUMNS


def pivot_aggs() -> list:
    """Aggregates of the per-expert pivot: first time per event name and the
    rejected flag (usable on any frame with event_name and event_at)."""
    name = F.col("event_name")
    aggs = [F.min(F.when(name == ev, F.col("event_at"))).alias(c) for ev, c in STAGE_TIME_COLUMNS]
    aggs.append(
        F.max(F.when(name == "verification_rejected", F.lit(True)).otherwise(F.lit(False))).alias("is_rejected")
    )
    return aggs


def reached_columns() -> list:
    """Reached flags and days_to_activate, over the pivot's columns."""
    not_rej = ~F.col("is_rejected")
    return [
        F.col("signup_at").isNotNull().alias("reached_signup"),
        F.col("profile_started_at").isNotNull().alias("reached_profile_started"),
        F.col("profile_completed_at").isNotNull().alias("reached_profile_completed"),
        F.col("verification_submitted_at").isNotNull().alias("reached_verification_submitted"),
        (F.col("verification_approved_at").isNotNull() & not_rej).alias("reached_verified"),
        (F.col("first_engagement_at").isNotNull() & not_rej).alias("reached_activated"),
        F.when(
            F.col("first_engagement_at").isNotNull() & F.col("signup_at").isNotNull(),
            days_between("signup_at", "first_engagement_at"),
        ).alias("days_to_activate"),
    ]


def expert_funnel_summary(stg_events: DataFrame) -> DataFrame:
    """Pivot cleaned events to one row per expert.

    First time per event name (MIN absorbs duplicates and disorder), the
    rejected flag, six reached flags (verified and activated exclude rejected
    experts) and days_to_activate (calendar days, signed).

    Plan: one hash aggregate keyed by expert_id.  MIN and MAX merge, so the
    partial aggregate combines map-side and a hot expert shrinks to one row
    per partition before the shuffle.
    """
    return stg_events.groupBy("expert_id").agg(*pivot_aggs()).select("*", *reached_columns())


def stage_counts(summary: DataFrame) -> DataFrame:
    """(stage, stage_order, experts_reached) for the six report stages.

    One aggregate of six conditional counts, then a 6-row unpivot: a single
    scan of the summary (a UNION ALL of six counts would scan it six times).
    """
    counts = summary.agg(*[F.count_if(F.col(flag)).alias(stage) for stage, _, flag in REPORT_STAGES])
    rows = ", ".join(f"'{stage}', {order}, `{stage}`" for stage, order, _ in REPORT_STAGES)
    return counts.select(
        F.expr(f"stack({len(REPORT_STAGES)}, {rows}) AS (stage, stage_order, experts_reached)")
    )


def funnel_conversion(summary: DataFrame) -> DataFrame:
    """Six stages: experts reached, % of the previous stage and % of signup.

    Rates have 2 decimals here (the step analysis uses 1, as in the
    reference).  The window runs over the 6 aggregated rows only (never over
    experts).  Conversion may exceed 100 when the funnel is not monotone.
    """
    by_stage = Window.orderBy("stage_order")
    c = stage_counts(summary)
    return (
        c.select(
            "stage",
            "stage_order",
            "experts_reached",
            pct("experts_reached", F.lag("experts_reached").over(by_stage), 2).alias("conversion_from_previous"),
            pct("experts_reached", F.first("experts_reached").over(by_stage), 2).alias("conversion_from_signup"),
        )
        .orderBy("stage_order")
        .drop("stage_order")
    )
