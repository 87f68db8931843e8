"""The streaming pivot and sessions agree with the batch models."""

import tempfile

from pyspark.sql import functions as F

from helpers import SF0001
from funnelkit.plans.models import Models
from funnelkit.sources.raw import write_raw
from funnelkit.sources.tables import read_table
from funnelkit.streaming.incremental import read_event_stream, session_stream, summary_stream


def _collect_stream(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_matches_batch(spark):
    m = Models.from_testdata(spark, SF0001)
    base = tempfile.mkdtemp(prefix="funnelkit-stream-")
    write_raw(m.raw, base)
    stream = read_event_stream(spark, f"{base}/funnel_events", max_files_per_trigger=1)

    got = _collect_stream(summary_stream(stream), "complete", "summary_stream_t")
    want = m.expert_funnel_summary
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0

    sessions = _collect_stream(session_stream(stream, watermark="36500 days"), "complete", "session_stream_t")
    batch = m.expert_sessions.select("expert_id", "session_start_at", "session_end_at", "events_in_session").distinct()
    a = sessions.select(batch.columns)
    assert a.count() == batch.count()
    assert a.exceptAll(batch).count() == 0
    assert sessions.agg(F.sum("events_in_session")).first()[0] == m.stg_funnel_events.count()


def test_refresh_to_tables(spark):
    from funnelkit.streaming.incremental import refresh_summary_table, run_available_now

    m = Models.from_testdata(spark, SF0001)
    base = tempfile.mkdtemp(prefix="funnelkit-stream-files-")
    write_raw(m.raw, base)
    events = f"{base}/funnel_events"
    refresh_summary_table(read_event_stream(spark, events), f"{base}/summary", f"{base}/ckpt_summary")
    got = read_table(spark, f"{base}/summary")
    want = m.expert_funnel_summary
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0 and got.count() == want.count()
    # closed sessions append to a parquet table: only sessions the watermark
    # has passed are final, so the table holds a subset of the batch sessions
    # and every row of it is one of them
    run_available_now(session_stream(read_event_stream(spark, events), watermark="1 hour"), f"{base}/sessions",
                      f"{base}/ckpt_sessions")
    closed = spark.read.parquet(f"{base}/sessions")
    batch = m.expert_sessions.select("expert_id", "session_start_at", "session_end_at", "events_in_session").distinct()
    assert closed.count() > 0
    assert closed.select(batch.columns).exceptAll(batch).count() == 0


def test_late_event_merges_into_its_session(spark):
    from datetime import datetime, timedelta

    from funnelkit.sources.schemas import FUNNEL_EVENTS

    base = tempfile.mkdtemp(prefix="funnelkit-late-")
    t0 = datetime(2024, 3, 1, 8, 0, 0)
    first = [(1, 1, "signup", t0, None), (2, 1, "profile_completed", t0 + timedelta(hours=48), None)]
    # arrives later, but lies between the two: 23 h after signup, 25 h before
    # the second event -- still more than 1440 minutes from it
    late = [(3, 1, "profile_started", t0 + timedelta(hours=23), None)]
    spark.createDataFrame(first, FUNNEL_EVENTS).coalesce(1).write.parquet(f"{base}/events/part=1")
    spark.createDataFrame(late, FUNNEL_EVENTS).coalesce(1).write.parquet(f"{base}/events/part=2")
    stream = spark.readStream.schema(FUNNEL_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/events/*")
    got = _collect_stream(session_stream(stream, watermark="30 days"), "complete", "late_sessions_t")
    rows = sorted((r.session_start_at, r.events_in_session) for r in got.collect())
    assert rows == [(t0, 2), (t0 + timedelta(hours=48), 1)]
