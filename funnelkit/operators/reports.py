"""Marts over the enriched expert table: cohorts, periods, channels, campaigns.

Each report aggregates experts first; the windows and joins that follow run
on the aggregates (one row per week, channel or campaign), never on experts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import histogram_stats
from ..functions.ranks import ONE_TASK_ROWS, down, global_row_numbers
from ..functions.scalar import pct, safe_div
from ..functions.vocab import (
    ACTIVATION_WINDOW_DAYS,
    MIN_SIGNUPS_FOR_RATE_RANK,
    PERIOD_A,
    PERIOD_B,
    QUANTILES,
    TOP_K,
    Z_THRESHOLD,
)
from ..session import checkpoint_dir

MONEY_SUM = "decimal(28,2)"


def activated_within(days: int = ACTIVATION_WINDOW_DAYS):
    """reached_activated and days_to_activate <= days, NULL counted as false.

    Negative days (activation dated before signup) pass, as in the reference.
    """
    return F.coalesce(F.col("reached_activated") & (F.col("days_to_activate") <= F.lit(days)), F.lit(False))


def cohort_conversion(ewe: DataFrame, window_days: int = ACTIVATION_WINDOW_DAYS) -> DataFrame:
    """Weekly signup cohorts: signups, activated within the window, rate,
    days-to-activate median/p75/p90 (of those activated in the window) and
    the change of the rate on the prior week (2 decimals).

    Recent cohorts have had less than the window to activate (right
    censoring); nothing corrects for it, as in the reference.  One histogram
    pass over (week, days) gives counts and exact quantiles; the
    week-over-week window runs on one row per week.
    """
    d = F.when(activated_within(window_days), F.col("days_to_activate"))
    st = histogram_stats(ewe, ["signup_week"], d, QUANTILES, ["_q50", "_q75", "_q90"])
    by_week = Window.orderBy("signup_week")
    rate = pct("_n", "_rows", 2)
    return st.select(
        "signup_week",
        F.col("_rows").alias("total_signups"),
        F.col("_n").alias("activated_count"),
        rate.alias("activation_rate_pct"),
        F.col("_q50").alias("median_days_to_activate"),
        F.col("_q75").alias("p75_days_to_activate"),
        F.col("_q90").alias("p90_days_to_activate"),
        F.round(rate - F.lag(rate).over(by_week), 2).alias("wow_activation_rate_change"),
    ).orderBy("signup_week")


def period_comparison(
    ewe: DataFrame,
    period_a: tuple[str, str] = PERIOD_A,
    period_b: tuple[str, str] = PERIOD_B,
    window_days: int = ACTIVATION_WINDOW_DAYS,
    z_threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Two signup-date ranges side by side (columns q3_* = period A, q4_* =
    period B): signups, activation rate, average days, changes, and a
    two-proportion z-test flag.

    One scan and one global aggregate with conditional counts replace the
    reference's group-by-quarter plus self cross join.  As there, the rates in
    z are the rounded ones, and no row comes out when a period is empty.  A
    zero pooled variance gives NOT SIGNIFICANT instead of an error.
    """
    d = F.col("signup_date")
    in_a = d.between(F.lit(period_a[0]).cast("date"), F.lit(period_a[1]).cast("date"))
    in_b = d.between(F.lit(period_b[0]).cast("date"), F.lit(period_b[1]).cast("date"))
    act = activated_within(window_days)
    days = F.col("days_to_activate")
    # the same range on the zone-free signup time, which reaches the parquet
    # scan (row groups outside both periods are skipped)
    lo, hi = min(period_a[0], period_b[0]), max(period_a[1], period_b[1])
    bounds = (F.col("signup_at") >= F.lit(lo).cast("timestamp_ntz")) & (
        F.col("signup_at") < F.date_add(F.lit(hi).cast("date"), 1).cast("timestamp_ntz")
    )
    g = (
        ewe.where(bounds & (in_a | in_b))
        .agg(
            F.count_if(in_a).alias("q3_signups"),
            F.count_if(in_b).alias("q4_signups"),
            F.count_if(in_a & act).alias("q3_activated"),
            F.count_if(in_b & act).alias("q4_activated"),
            F.round(F.avg(F.when(in_a & act, days)), 1).alias("q3_avg_days"),
            F.round(F.avg(F.when(in_b & act, days)), 1).alias("q4_avg_days"),
        )
        .where((F.col("q3_signups") > 0) & (F.col("q4_signups") > 0))
    )
    g = g.withColumns(
        {
            "q3_activation_rate": pct("q3_activated", "q3_signups", 2),
            "q4_activation_rate": pct("q4_activated", "q4_signups", 2),
            "pooled_rate": safe_div(F.col("q3_activated") + F.col("q4_activated"), F.col("q3_signups") + F.col("q4_signups")),
        }
    )
    p = F.col("pooled_rate")
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.lit(1.0) / F.col("q3_signups") + F.lit(1.0) / F.col("q4_signups")))
    z = F.try_divide(F.col("q3_activation_rate") / F.lit(100.0) - F.col("q4_activation_rate") / F.lit(100.0), se)
    return g.select(
        "q3_signups",
        "q4_signups",
        pct(F.col("q4_signups") - F.col("q3_signups"), "q3_signups", 2).alias("signups_pct_change"),
        "q3_activation_rate",
        "q4_activation_rate",
        F.round(F.col("q4_activation_rate") - F.col("q3_activation_rate"), 2).alias("activation_rate_pp_change"),
        "q3_avg_days",
        "q4_avg_days",
        pct(F.col("q4_avg_days") - F.col("q3_avg_days"), "q3_avg_days", 2).alias("avg_days_pct_change"),
        F.when(F.abs(z) > F.lit(z_threshold), F.lit("SIGNIFICANT (p < 0.05)"))
        .otherwise(F.lit("NOT SIGNIFICANT"))
        .alias("activation_rate_significance"),
    )


def channel_performance(ewe: DataFrame, spend_summary: DataFrame, spend_mode: str = "once") -> DataFrame:
    """Per signup source: signups, activation rate, payouts, payout and LTV per
    activated expert, cost per signup / per activated expert, LTV:CAC.

    ``spend_mode="once"`` takes each channel's total once (``max`` over its
    campaign rows, which all carry the same total); ``"summed"`` reproduces
    the reference as written, summing the repeated total once per campaign.
    Unpaid channels have no spend row, so their cost metrics are NULL.
    Total payouts cover all experts of the channel, the per-activated
    averages only activated ones (as in the reference).
    The spend side is one row per channel; AQE broadcasts it once its
    runtime size is known to be under the broadcast threshold.
    """
    act = F.col("reached_activated")
    n_act = F.count_if(act)
    ce = ewe.groupBy("signup_source").agg(
        F.count(F.lit(1)).alias("total_signups"),
        n_act.alias("activated_count"),
        pct(n_act, F.count(F.lit(1)), 2).alias("activation_rate_pct"),
        F.sum("total_payout").cast(MONEY_SUM).alias("total_payouts"),
        F.round(safe_div(F.sum(F.when(act, F.col("total_payout")).otherwise(F.lit(0))), n_act), 2).alias(
            "avg_payout_per_activated"
        ),
        F.round(safe_div(F.sum(F.when(act, F.col("ltv_12m_proxy")).otherwise(F.lit(0))), n_act), 2).alias(
            "avg_ltv_per_activated"
        ),
    )
    if spend_mode == "once":
        total = F.max("channel_total_spend")
    elif spend_mode == "summed":
        total = F.sum("channel_total_spend")
    else:
        raise ValueError(spend_mode)
    cs = spend_summary.groupBy(F.col("channel").alias("signup_source")).agg(total.cast(MONEY_SUM).alias("total_spend"))
    j = ce.join(cs, "signup_source", "left")
    return j.select(
        "signup_source",
        "total_signups",
        "activation_rate_pct",
        "total_payouts",
        "avg_payout_per_activated",
        F.round(safe_div("total_spend", "total_signups"), 2).alias("cost_per_signup"),
        F.round(safe_div("total_spend", "activated_count"), 2).alias("cost_per_activated"),
        "total_spend",
        F.round(
            F.try_divide(F.col("avg_ltv_per_activated"), safe_div("total_spend", "activated_count")), 2
        ).alias("ltv_to_cac_ratio"),
    ).orderBy(F.col("total_signups").desc(), "signup_source")


def campaign_deep_dive(
    ewe: DataFrame,
    spend_summary: DataFrame,
    min_signups: int = MIN_SIGNUPS_FOR_RATE_RANK,
    top_k: int = TOP_K,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Paid campaigns: volume, activation, spend, cost, LTV:CAC, three ranks
    and a top-k flag.

    Ranks are row numbers over all campaigns with (signup_source,
    utm_campaign) as the tie-break; campaign names are free text, so more than
    ``one_task_rows`` of them are numbered in slices (``functions.ranks``).  Campaigns under
    ``min_signups`` rank after the others on activation and can still be top
    when fewer than ``top_k`` qualify, as in the reference.
    """
    act = F.col("reached_activated")
    n_act = F.count_if(act)
    ce = (
        ewe.where(F.col("is_paid_channel") & F.col("utm_campaign").isNotNull())
        .groupBy("signup_source", "utm_campaign")
        .agg(
            F.count(F.lit(1)).alias("total_signups"),
            n_act.alias("activated_count"),
            pct(n_act, F.count(F.lit(1)), 2).alias("activation_rate_pct"),
            F.sum(F.when(act, F.col("ltv_12m_proxy")).otherwise(F.lit(0))).cast(MONEY_SUM).alias("total_ltv_activated"),
        )
    )
    cs = spend_summary.select(
        F.col("channel").alias("signup_source"), F.col("campaign_name").alias("utm_campaign"), "campaign_spend"
    )
    j = ce.join(cs, ["signup_source", "utm_campaign"], "left")
    nz_act = F.nullif(F.col("activated_count"), F.lit(0))
    j = j.withColumns(
        {
            "cost_per_signup": F.round(safe_div("campaign_spend", "total_signups"), 2),
            "cost_per_activated": F.round(safe_div("campaign_spend", "activated_count"), 2),
            "ltv_to_cac_ratio": F.round(
                F.try_divide(safe_div("total_ltv_activated", nz_act), safe_div("campaign_spend", nz_act)), 2
            ),
        }
    )
    tie = [F.col("signup_source"), F.col("utm_campaign")]
    rate_if_big = F.when(F.col("total_signups") >= F.lit(min_signups), F.col("activation_rate_pct"))
    # one row a campaign, kept: its ranks read it several times
    checkpoint_dir(j.sparkSession)
    j = j.checkpoint()
    ranked = global_row_numbers(
        j,
        {
            "rank_by_volume": [down(F.col("total_signups")), *tie],
            "rank_by_activation": [down(rate_if_big), *tie],
            "rank_by_ltv_cac": [down(F.col("ltv_to_cac_ratio")), *tie],
        },
        j.count(),
        one_task_rows,
    )
    k = F.lit(top_k)
    return ranked.select(
        "signup_source",
        "utm_campaign",
        "total_signups",
        "activated_count",
        "activation_rate_pct",
        "campaign_spend",
        "cost_per_signup",
        "cost_per_activated",
        "ltv_to_cac_ratio",
        "rank_by_volume",
        "rank_by_activation",
        "rank_by_ltv_cac",
        ((F.col("rank_by_volume") <= k) | (F.col("rank_by_activation") <= k) | (F.col("rank_by_ltv_cac") <= k)).alias(
            "is_top_campaign"
        ),
    ).orderBy("rank_by_volume")
