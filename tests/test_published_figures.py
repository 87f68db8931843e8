"""
fed the published counts, the reports give the published rates."""

from decimal import Decimal

from pyspark.sql import functions as F

from funnelkit.operators import funnel, reports

STAGES = ["signup", "profile_started", "profile_completed", "verification_submitted", "verified", "activated"]
COUNTS = [12000, 8529, 6055, 3734, 3206, 1348]
CONVERSION_1DP = [None, 71.1, 71.0, 61.7, 85.9, 42.0]
DROPOFF_1DP = [None, 28.9, 29.0, 38.3, 14.1, 58.0]


def test_funnel_rates(spark):
    flags = {
        "reached_signup": 0,
        "reached_profile_started": 1,
        "reached_profile_completed": 2,
        "reached_verification_submitted": 3,
        "reached_verified": 4,
        "reached_activated": 5,
    }
    summary = spark.range(COUNTS[0]).select(*[(F.col("id") < COUNTS[i]).alias(n) for n, i in flags.items()])
    rows = {r.stage: r for r in funnel.funnel_conversion(summary).collect()}
    assert [rows[s].experts_reached for s in STAGES] == COUNTS
    for s, conv, drop in zip(STAGES, CONVERSION_1DP, DROPOFF_1DP):
        c = rows[s].conversion_from_previous
        if conv is None:
            assert c is None
        else:
            assert round(c, 1) == conv and round(100 - c, 1) == drop
    assert round(rows["activated"].conversion_from_signup, 1) == 11.2  # signup -> activated card


def test_channel_costs(spark):
    # paid search: 2,023 signups, 7.1 % activated, $599,429 -> CPS $296, CPA $4,163
    ewe = spark.range(2023).select(
        F.lit("paid_search").alias("signup_source"),
        (F.col("id") < 144).alias("reached_activated"),
        F.lit(0).cast("decimal(28,2)").alias("total_payout"),
        F.lit(0).cast("decimal(28,2)").alias("ltv_12m_proxy"),
    )
    spend = spark.createDataFrame(
        [("paid_search", "c1", Decimal("599429.00"))], "channel string, campaign_name string, channel_total_spend decimal(28,2)"
    )
    (r,) = reports.channel_performance(ewe, spend).collect()
    assert round(r.activation_rate_pct, 1) == 7.1
    assert round(r.cost_per_signup) == 296 and round(r.cost_per_activated) == 4163
