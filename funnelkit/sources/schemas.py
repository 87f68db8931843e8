"""Explicit schemas of the four raw tables (no schema inference at read)."""

from pyspark.sql import types as T

TS = T.TimestampNTZType()
MONEY = T.DecimalType(18, 2)

EXPERTS = T.StructType(
    [
        T.StructField("expert_id", T.LongType(), False),
        T.StructField("signup_date", TS, True),
        T.StructField("signup_source", T.StringType(), True),
        T.StructField("utm_campaign", T.StringType(), True),
        T.StructField("utm_medium", T.StringType(), True),
        T.StructField("utm_source", T.StringType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("industry", T.StringType(), True),
    ]
)

FUNNEL_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("expert_id", T.LongType(), True),
        T.StructField("event_name", T.StringType(), True),
        T.StructField("event_timestamp", TS, True),
        T.StructField("event_properties", T.StringType(), True),
    ]
)

ENGAGEMENTS = T.StructType(
    [
        T.StructField("engagement_id", T.LongType(), False),
        T.StructField("expert_id", T.LongType(), True),
        T.StructField("engagement_type", T.StringType(), True),
        T.StructField("engagement_date", TS, True),
        T.StructField("payout_amount", MONEY, True),
        T.StructField("client_industry", T.StringType(), True),
    ]
)

DAILY_CHANNEL_SPEND = T.StructType(
    [
        T.StructField("date", T.DateType(), True),
        T.StructField("channel", T.StringType(), True),
        T.StructField("campaign_name", T.StringType(), True),
        T.StructField("spend_usd", MONEY, True),
        T.StructField("impressions", T.LongType(), True),
        T.StructField("clicks", T.LongType(), True),
    ]
)

RAW_SCHEMAS = {
    "experts": EXPERTS,
    "funnel_events": FUNNEL_EVENTS,
    "engagements": ENGAGEMENTS,
    "daily_channel_spend": DAILY_CHANNEL_SPEND,
}

#: columns that hold keys; their type is the source's (staging never casts them)
KEY_COLUMNS = ("expert_id", "event_id", "engagement_id")


def raw_schemas(key_type: str = "bigint") -> dict[str, T.StructType]:
    """The four schemas with keys of another type, e.g. ``string``."""
    kind = T.StructType.fromDDL(f"k {key_type}")["k"].dataType
    return {
        name: T.StructType([T.StructField(f.name, kind if f.name in KEY_COLUMNS else f.dataType, f.nullable) for f in schema])
        for name, schema in RAW_SCHEMAS.items()
    }
