"""Build the whole project: the counterpart of running every model.

Staging stays lazy (views); the multi-consumer intermediate models are
written once as tables under the session's ``spark.checkpoint.dir`` (shared
storage on a cluster) and read back, which cuts their lineage -- a lost
executor then recomputes from those files, not from the raw sources -- and
lets every mart reuse them.  Marts go to a sink: by default tables that are
replaced as a whole (``sources.tables``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import funnel, quality, reports, steps
from ..session import run_folder
from ..sources.raw import RawTables
from ..sources.tables import read_table, write_table
from .models import Models

SHARED = ["expert_funnel_summary", "expert_with_engagement", "channel_spend_summary", "expert_sessions", "funnel_step_sessions"]

MARTS: dict[str, Callable[[Models], DataFrame]] = {
    "mart_funnel_conversion": lambda m: funnel.funnel_conversion(m.expert_funnel_summary),
    "mart_cohort_conversion": lambda m: reports.cohort_conversion(m.expert_with_engagement),
    "mart_period_comparison": lambda m: reports.period_comparison(m.expert_with_engagement),
    "mart_channel_performance": lambda m: reports.channel_performance(m.expert_with_engagement, m.channel_spend_summary),
    "mart_campaign_deep_dive": lambda m: reports.campaign_deep_dive(m.expert_with_engagement, m.channel_spend_summary),
    "mart_funnel_step_analysis": lambda m: steps.funnel_step_analysis(m.expert_sessions),
}


def materialize(spark: SparkSession, m: Models, names=SHARED, base: str | None = None) -> Models:
    """Write the named nodes as parquet tables and rebind them to the files."""
    base = base or f"{run_folder(spark)}/models-{uuid.uuid4().hex[:12]}"
    for name in names:
        path = f"{base}/{name}"
        getattr(m, name).write.mode("overwrite").parquet(path)
        m.__dict__[name] = spark.read.parquet(path)  # the cached node now reads the table
    return m


def build_all(
    spark: SparkSession,
    sf_dir: str | None = None,
    raw: RawTables | None = None,
    sink: Callable[[DataFrame], None] | None = None,
    out_dir: str | None = None,
    run_tests: bool = False,
) -> dict[str, DataFrame]:
    """Build intermediates once, then every mart (and optionally the tests)."""
    m = Models(raw) if raw is not None else Models.from_testdata(spark, sf_dir)
    m = materialize(spark, m)
    out = {name: f(m) for name, f in MARTS.items()}
    if run_tests:
        out["dq_report"] = quality.run_all(m)
    for name, df in out.items():
        if sink is not None:
            sink(df)
        elif out_dir is not None:
            write_table(df, f"{out_dir}/{name}")
            out[name] = read_table(spark, f"{out_dir}/{name}")
    return out
