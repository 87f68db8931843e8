"""Datasets behind the growth dashboard.

The reference page holds hand-typed numbers; these are the tables that feed
it, computed from the models.  Every function takes the model graph ``m``;
every function takes the page's two filters, ``channel=`` and ``industry=``,
which narrow the expert set at the sources (``m.scoped(...)``), so every
number on the page follows.  All combining happens on one-row or per-stage
aggregates (a handful of rows), never on experts.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import histogram_stats
from ..functions.scalar import month_start, pct
from ..functions.vocab import ACTIVATION_WINDOW_DAYS, PERIOD_A, PERIOD_B, REPORT_STAGES, SIGNUP_SOURCES
from . import reports, steps

# --- fixed values: bands shown on the page ---------------------------------
DROP_BANDS = [(35.0, "high"), (25.0, "medium")]  # >= threshold, else "low"
NEVER_SUBMITTED_BANDS = [(50.0, "high"), (35.0, "medium")]  # > threshold, else "low"
STALE_AFTER_DAYS = 30
DEFAULT_AS_OF = "2024-12-31"
DEFAULT_RECOVERY_RATE = 0.25


def _filterable(fn):
    """Give a dashboard dataset the page's two filters: ``channel=`` and
    ``industry=`` narrow the expert set at the sources (``Models.scoped``)."""

    @functools.wraps(fn)
    def wrapper(m, *args, channel: str | None = None, industry: str | None = None, **kw):
        return fn(m.scoped(channel=channel, industry=industry), *args, **kw)

    return wrapper


def _band(c, bands, strict: bool):
    expr = None
    for t, name in bands:
        cond = (c > F.lit(t)) if strict else (c >= F.lit(t))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.when(c.isNotNull(), expr.otherwise(F.lit("low")))


def _never_submitted_flag():
    return F.col("reached_profile_completed") & ~F.col("reached_verification_submitted")


@_filterable
def never_submitted(m) -> DataFrame:
    """Experts who completed a profile but never submitted for verification."""
    s = m.expert_funnel_summary
    g = s.agg(
        F.count_if("reached_profile_completed").alias("completed_profiles"),
        F.count_if(_never_submitted_flag()).alias("never_submitted"),
        F.count_if("reached_verification_submitted").alias("submitted"),
    )
    return g.select(
        "completed_profiles",
        "submitted",
        "never_submitted",
        pct("never_submitted", "completed_profiles", 1).alias("never_submitted_pct"),
    )


@_filterable
def never_submitted_by_channel(m) -> DataFrame:
    g = m.expert_with_engagement.groupBy("signup_source").agg(
        F.count_if("reached_profile_completed").alias("completed_profiles"),
        F.count_if(_never_submitted_flag()).alias("never_submitted"),
    )
    rate = pct("never_submitted", "completed_profiles", 1)
    return g.select(
        "signup_source",
        "completed_profiles",
        "never_submitted",
        rate.alias("never_submitted_pct"),
        _band(rate, NEVER_SUBMITTED_BANDS, strict=True).alias("band"),
    ).orderBy(F.col("never_submitted_pct").desc_nulls_last(), "signup_source")


@_filterable
def never_submitted_stale(m, as_of: str = DEFAULT_AS_OF, stale_after_days: int = STALE_AFTER_DAYS) -> DataFrame:
    """Share of never-submitted experts whose profile was completed more than
    ``stale_after_days`` days before ``as_of``."""
    s = m.expert_funnel_summary.where(_never_submitted_flag())
    stale = F.datediff(F.lit(as_of).cast("date"), F.to_date("profile_completed_at")) > F.lit(stale_after_days)
    g = s.agg(F.count(F.lit(1)).alias("never_submitted"), F.count_if(stale).alias("stale_count"))
    return g.select(
        F.lit(as_of).cast("date").alias("as_of_date"),
        "never_submitted",
        "stale_count",
        pct("stale_count", "never_submitted", 1).alias("stale_pct"),
    )


@_filterable
def recovery_whatif(m, recovery_rate: float = DEFAULT_RECOVERY_RATE) -> DataFrame:
    """Recover a share of the never-submitted: experts added and the lift on
    verification submissions."""
    ns = never_submitted(m)
    added = F.col("never_submitted") * F.lit(float(recovery_rate))
    return ns.select(
        F.lit(float(recovery_rate)).alias("recovery_rate"),
        "never_submitted",
        "submitted",
        F.floor(added).cast("bigint").alias("recovered_experts"),
        F.round(F.try_divide(added * F.lit(100.0), F.col("submitted").cast("double")), 1).alias("submission_lift_pct"),
    )


@_filterable
def kpis(m, period_a=PERIOD_A, period_b=PERIOD_B, window_days: int = ACTIVATION_WINDOW_DAYS) -> DataFrame:
    """The four headline cards: signup-to-activated %, its change between the
    two periods, never-submitted count and share, sessions to activate, and
    the stage with the largest drop-off.

    One pass: the experts are joined (full outer, co-partitioned by
    expert_id) to the per-expert rollup of the sessions, and a single global
    histogram aggregate yields the stage counts, the never-submitted count,
    the session-count median and the two periods' counts; the card is
    arithmetic on that one row.  Stage counts cover every expert with events
    (orphans included), period counts every expert profile, as in the
    funnel and period reports.
    """
    r = steps.expert_rollup(m.expert_sessions)
    e = m.stg_experts.select(F.col("expert_id").alias("_eid"), "signup_date")
    j = e.join(r, e["_eid"] == r["expert_id"], "full_outer")
    d = F.col("signup_date")
    in_a = d.between(F.lit(period_a[0]).cast("date"), F.lit(period_a[1]).cast("date"))
    in_b = d.between(F.lit(period_b[0]).cast("date"), F.lit(period_b[1]).cast("date"))
    act = reports.activated_within(window_days)
    flags = {stage: F.col(flag).cast("bigint") for stage, _, flag in REPORT_STAGES}
    flags["_completed"] = F.col("reached_profile_completed").cast("bigint")
    flags["_never"] = _never_submitted_flag().cast("bigint")
    period = {
        "_a_n": in_a.cast("bigint"),
        "_b_n": in_b.cast("bigint"),
        "_a_act": (in_a & act).cast("bigint"),
        "_b_act": (in_b & act).cast("bigint"),
    }
    st = histogram_stats(
        j, [], F.when(F.col("reached_activated"), F.col("max_session")), [0.5], ["_q50"], sums={**flags, **period}
    )
    counts = [*flags, *period]
    st = st.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts})  # 0 on no rows
    stages = [stage for stage, _, _ in REPORT_STAGES]
    drops = [
        F.struct(
            F.round(
                F.lit(100.0) - F.try_divide(F.col(cur).cast("double"), F.col(prev).cast("double")) * F.lit(100.0), 1
            ).alias("dropoff"),
            F.lit(cur).alias("stage"),
        )
        for prev, cur in zip(stages, stages[1:])
    ]
    # the period report's arithmetic: rates rounded to 2 decimals first; no
    # change when a period has no signups
    rate_a, rate_b = pct("_a_act", "_a_n", 2), pct("_b_act", "_b_n", 2)
    both = (F.col("_a_n") > 0) & (F.col("_b_n") > 0)
    head = st.select(
        pct("activated", "signup", 1).alias("signup_to_activated_pct"),
        F.when(both, F.round(rate_b - rate_a, 2)).alias("period_activation_pp_change"),
        F.col("_never").alias("never_submitted"),
        pct("_never", "_completed", 1).alias("never_submitted_pct"),
        F.round(F.try_divide(F.col("_sum").cast("double"), F.col("_n").cast("double")), 2).alias(
            "avg_sessions_to_activate"
        ),
        F.col("_q50").alias("median_sessions_to_activate"),
        F.array_max(F.array(*drops)).alias("_worst"),
    )
    return head.select(
        "signup_to_activated_pct",
        "period_activation_pp_change",
        "never_submitted",
        "never_submitted_pct",
        "avg_sessions_to_activate",
        "median_sessions_to_activate",
        # no stage has a drop-off (e.g. no experts): no biggest one either
        F.when(F.col("_worst.dropoff").isNotNull(), F.col("_worst.stage")).alias("biggest_dropoff_stage"),
        F.col("_worst.dropoff").alias("biggest_dropoff_pct"),
    )


@_filterable
def funnel_bars(m) -> DataFrame:
    """Stage bars: count, conversion, drop, session break, avg hours, drop
    band and bar width (% of signup)."""
    fsa = steps.funnel_step_analysis(m.expert_sessions)
    return fsa.select(
        "stage",
        "stage_order",
        "experts_reached",
        "conversion_from_previous_pct",
        "dropoff_rate_pct",
        "session_break_rate_pct",
        "avg_hours_to_reach",
        _band(F.col("dropoff_rate_pct"), DROP_BANDS, strict=False).alias("drop_band"),
        F.col("conversion_from_signup_pct").alias("bar_width_pct"),
    ).orderBy("stage_order")


@_filterable
def step_detail(m) -> DataFrame:
    """One row per transition into a report stage: experts reaching it,
    hours avg/median/p90, session break rate, drop-off."""
    fsa = steps.funnel_step_analysis(m.expert_sessions)
    return (
        fsa.where(F.col("from_step").isNotNull())
        .select(
            F.concat(F.col("from_step"), F.lit(" -> "), F.col("stage")).alias("transition"),
            "stage_order",
            F.col("experts_reached").alias("experts"),
            F.col("avg_hours_to_reach").alias("avg_hours"),
            F.col("median_hours_to_reach").alias("median_hours"),
            F.col("p90_hours_to_reach").alias("p90_hours"),
            "session_break_rate_pct",
            "dropoff_rate_pct",
        )
        .orderBy("stage_order")
    )


@_filterable
def weekly_activation(m) -> DataFrame:
    """Activation rate per signup week, with the week's running number."""
    cc = reports.cohort_conversion(m.expert_with_engagement)
    return cc.select(
        "signup_week",
        F.row_number().over(Window.orderBy("signup_week")).alias("week_number"),
        "total_signups",
        "activation_rate_pct",
    ).orderBy("signup_week")


@_filterable
def monthly_days_to_activate(m, window_days: int = 60) -> DataFrame:
    """Days to activate by signup month (activations inside the window):
    count, average, median, p90 -- one histogram pass."""
    d = F.when(reports.activated_within(window_days), F.col("days_to_activate"))
    base = m.expert_with_engagement.select(month_start("signup_date").alias("signup_month"), d.alias("d"))
    st = histogram_stats(base, ["signup_month"], "d", [0.5, 0.9], ["median_days_to_activate", "p90_days_to_activate"])
    return st.select(
        "signup_month",
        F.col("_n").alias("activated_count"),
        F.round(F.try_divide(F.col("_sum").cast("double"), F.col("_n").cast("double")), 1).alias("avg_days_to_activate"),
        "median_days_to_activate",
        "p90_days_to_activate",
    ).orderBy("signup_month")


@_filterable
def channel_bubble(m) -> DataFrame:
    cp = reports.channel_performance(m.expert_with_engagement, m.channel_spend_summary)
    return cp.select("signup_source", "total_signups", "activation_rate_pct", "total_payouts")


@_filterable
def monthly_signups(m) -> DataFrame:
    """Signups per month, one column per listed channel, ``other`` for every
    other one (NULL too) and ``total``: each signup is in one channel column."""
    e = m.stg_experts.select(month_start("signup_date").alias("signup_month"), "signup_source")
    listed = F.coalesce(F.col("signup_source").isin(*SIGNUP_SOURCES), F.lit(False))
    return e.groupBy("signup_month").agg(
        *[F.count_if(F.col("signup_source") == c).alias(c) for c in SIGNUP_SOURCES],
        F.count_if(~listed).alias("other"),
        F.count(F.lit(1)).alias("total"),
    ).orderBy("signup_month")


@_filterable
def channel_costs(m) -> DataFrame:
    """Cost table per channel; unpaid channels keep NULL costs (the page's $0
    and infinity are display choices)."""
    cp = reports.channel_performance(m.expert_with_engagement, m.channel_spend_summary)
    return cp.select(
        "signup_source",
        "total_signups",
        "activation_rate_pct",
        "total_spend",
        "cost_per_signup",
        "cost_per_activated",
        "ltv_to_cac_ratio",
    )


__all__ = [
    "channel_bubble",
    "channel_costs",
    "funnel_bars",
    "kpis",
    "monthly_days_to_activate",
    "monthly_signups",
    "never_submitted",
    "never_submitted_by_channel",
    "never_submitted_stale",
    "recovery_whatif",
    "step_detail",
    "weekly_activation",
]
