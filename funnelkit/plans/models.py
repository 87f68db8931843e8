"""The model graph: raw tables -> staging -> intermediate, built lazily.

Each node is a DataFrame built once per ``Models`` object and shared by every
report that reads it, so one Python session plans the shared subtrees once.
``persist_shared()`` caches the two nodes with several consumers (the
enriched expert table and the sessions) when many reports run in one
session; ``materialize()`` writes them to the cluster's checkpoint folder to
cut lineage before a long build.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clean

from ..operators import enrich, funnel, sessions, staging, steps
from ..sources.fixtures import fixture_tables
from ..sources.raw import RawTables


class Models:
    def __init__(self, raw: RawTables, session_gap_minutes: int = 1440):
        self.raw = raw
        self.session_gap_minutes = session_gap_minutes

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Models":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return cls(fixture_tables(spark, sf_dir), **kw)

    # staging
    @cached_property
    def stg_experts(self) -> DataFrame:
        return staging.stg_experts(self.raw.experts)

    @cached_property
    def stg_funnel_events(self) -> DataFrame:
        return staging.stg_funnel_events(self.raw.funnel_events)

    @cached_property
    def stg_engagements(self) -> DataFrame:
        return staging.stg_engagements(self.raw.engagements)

    @cached_property
    def stg_daily_channel_spend(self) -> DataFrame:
        return staging.stg_daily_channel_spend(self.raw.daily_channel_spend)

    # intermediate
    @cached_property
    def expert_funnel_summary(self) -> DataFrame:
        return funnel.expert_funnel_summary(self.stg_funnel_events)

    @cached_property
    def expert_with_engagement(self) -> DataFrame:
        return enrich.expert_with_engagement(self.stg_experts, self.expert_funnel_summary, self.stg_engagements)

    @cached_property
    def channel_spend_summary(self) -> DataFrame:
        return enrich.channel_spend_summary(self.stg_daily_channel_spend)

    @cached_property
    def expert_sessions(self) -> DataFrame:
        return sessions.expert_sessions(self.stg_funnel_events, gap_minutes=self.session_gap_minutes)

    @cached_property
    def funnel_step_sessions(self) -> DataFrame:
        return steps.funnel_step_sessions(self.expert_sessions)

    def scoped(self, channel: str | None = None, industry: str | None = None) -> "Models":
        """The same graph over a subset of experts (a dashboard filter).

        Experts are filtered on their cleaned channel / industry; events and
        engagements keep only those experts (a left-semi join on expert_id).
        Spend is not per expert and stays whole.
        """
        if channel is None and industry is None:
            return self
        e = self.raw.experts
        cond = F.lit(True)
        if channel is not None:
            cond = cond & (clean("signup_source") == F.lit(channel))
        if industry is not None:
            cond = cond & (F.trim("industry") == F.lit(industry))
        e = e.where(cond)
        ids = e.select("expert_id").hint("merge")  # as many as experts: not for a broadcast
        raw = RawTables(
            experts=e,
            funnel_events=self.raw.funnel_events.join(ids, "expert_id", "left_semi"),
            engagements=self.raw.engagements.join(ids, "expert_id", "left_semi"),
            daily_channel_spend=self.raw.daily_channel_spend,
        )
        return Models(raw, session_gap_minutes=self.session_gap_minutes)

    def register_views(self, prefix: str = "") -> list[str]:
        """Register the raw, staging and intermediate nodes as temp views (the
        reference's view layer), for users who write SQL on top."""
        names = []
        for name, df in self.raw.as_dict().items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        for name in (
            "stg_experts",
            "stg_funnel_events",
            "stg_engagements",
            "stg_daily_channel_spend",
            "expert_funnel_summary",
            "expert_with_engagement",
            "channel_spend_summary",
            "expert_sessions",
            "funnel_step_sessions",
        ):
            getattr(self, name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    def persist_shared(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "Models":
        """Cache the multi-consumer nodes (recomputed from lineage if lost)."""
        for name in ("expert_with_engagement", "expert_sessions", "expert_funnel_summary"):
            getattr(self, name).persist(level)
        return self

    def unpersist(self) -> None:
        for name in ("expert_with_engagement", "expert_sessions", "expert_funnel_summary"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
