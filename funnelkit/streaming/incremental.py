"""Streaming forms of the two event-stream models.

The reference refreshes its models in batch; these run the same logic on a
stream of raw funnel events so the per-expert pivot and the sessions stay
current as events arrive.

* ``summary_stream``: staging + the per-expert pivot as a streaming
  aggregation.  Its state is one row per expert (MIN/MAX buffers), bounded
  by the number of experts, not by the events.
* ``session_stream``: one row per closed session via ``session_window``.
  Spark merges an event that lands exactly on a session's end, so the gap
  that reproduces "more than 1440 whole minutes starts a session" is 1440
  minutes plus 59.999999 seconds.  Session numbers need a key's whole
  history and stay a batch concern.

``run_available_now`` drains what is available and stops -- the scheduled
(e.g. weekly) refresh -- keeping its progress in a checkpoint folder on
shared storage.  Closed sessions append to a parquet table;
``refresh_summary_table`` rewrites the per-expert table from the pivot's
state each refresh (file sinks only append, so it goes through
``foreachBatch``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.funnel import pivot_aggs, reached_columns
from ..operators.staging import stg_funnel_events
from ..sources.schemas import FUNNEL_EVENTS
from ..sources.tables import write_table


def session_gap(gap_minutes: int = 1440) -> str:
    """The ``session_window`` gap equal to 'more than ``gap_minutes`` whole minutes'."""
    return f"{gap_minutes} minutes 59 seconds 999 milliseconds 999 microseconds"


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw funnel events arriving as parquet files in ``path`` (explicit schema)."""
    r = spark.readStream.schema(FUNNEL_EVENTS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def summary_stream(raw_events: DataFrame) -> DataFrame:
    """Per-expert pivot of a raw event stream (output modes: update, complete)."""
    stg = stg_funnel_events(raw_events)
    return stg.groupBy("expert_id").agg(*pivot_aggs()).select("*", *reached_columns())


def session_stream(
    raw_events: DataFrame, gap_minutes: int = 1440, watermark: str = "7 days", dedupe: bool = True
) -> DataFrame:
    """Sessions of a raw event stream: expert, start, end, event count.

    Events later than ``watermark`` behind the newest event are dropped, and
    a session is final once the watermark passes its end.  ``dedupe`` drops
    replayed events (same id, expert, name and time) seen within the watermark.
    """
    # event time must be zone-aware for watermarks: the UTC instant of the
    # zone-free time (the session zone is UTC, see funnelkit.session)
    stg = stg_funnel_events(raw_events).withColumn("_et", F.col("event_at").cast(T.TimestampType()))
    stg = stg.withWatermark("_et", watermark)
    if dedupe:
        stg = stg.dropDuplicatesWithinWatermark(["event_id", "expert_id", "event_name", "_et"])
    g = stg.groupBy("expert_id", F.session_window("_et", session_gap(gap_minutes)).alias("w")).agg(
        F.min("event_at").alias("session_start_at"),
        F.max("event_at").alias("session_end_at"),
        F.count(F.lit(1)).alias("events_in_session"),
    )
    return g.select("expert_id", "session_start_at", "session_end_at", "events_in_session")


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Process everything available, write it, stop (a scheduled refresh)."""
    q = (
        df.writeStream.outputMode(mode)
        .format(fmt)
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def refresh_summary_table(raw_events: DataFrame, table_path: str, checkpoint: str):
    """Bring the per-expert summary table at ``table_path`` up to date.

    The streaming pivot keeps one row per expert in its state; each refresh
    replaces the table by the whole state (complete mode), so the table is
    always the summary of every event seen so far (``sources.tables.read_table``).
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        write_table(batch, table_path)

    q = (
        summary_stream(raw_events)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q
