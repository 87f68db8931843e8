"""Literal raw tables for the tests, and where the test data lies."""

from datetime import date, datetime

from funnelkit.plans.models import Models
from funnelkit.sources.raw import RawTables
from funnelkit.sources.schemas import RAW_SCHEMAS

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def d(text: str) -> date:
    return date.fromisoformat(text)


def expert(eid, signup="2024-01-01 10:00:00", source="organic", campaign=None, country="US", industry="tech"):
    medium = "cpc" if campaign else None
    src = "ads" if campaign else None
    return (eid, ts(signup), source, campaign, medium, src, country, industry)


def raw_tables(spark, experts=(), events=(), engagements=(), spend=()):
    def mk(name, rows):
        return spark.createDataFrame(list(rows), RAW_SCHEMAS[name])

    return RawTables(
        experts=mk("experts", experts),
        funnel_events=mk("funnel_events", events),
        engagements=mk("engagements", engagements),
        daily_channel_spend=mk("daily_channel_spend", spend),
    )


def models(spark, **kw) -> Models:
    return Models(raw_tables(spark, **kw))
