"""Sessionisation: split each key's events into inactivity sessions.

Rule (kept from the reference): order a key's events by time (then the given
tie-breakers); an event starts a new session when it is the key's first or
when the whole minutes elapsed since the previous event exceed ``gap_minutes``
(strict: a gap of 24:00:59 does not split at 1440).

Two plans give the same rows:

``sliced`` (default).  Heavy keys are cut into slices (see ``slices``), and
windows run per (key, slice).  A slice knows all its sessions but the one that
is open at its start and the one that is open at its end.  For each slice of
a heavy key a summary row tells its first and last time, the sessions that
start inside, and the parts of the sessions at its two ends; merged along the
key, these rows number the sessions and join the parts.  They come back to the
events as a broadcast, for there are no more of them than slices.  Without a
heavy key this is the textbook plan.

``window``: the textbook plan whatever the keys, three window functions over
one exchange by key.  One key's rows are sorted in one task.  Kept as the
independent second implementation for tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import minutes_between
from .slices import Sliced, sliced, spread

# columns added to every event
SESSION_COLUMNS = [
    "prev_event_at",
    "gap_minutes",
    "is_new_session",
    "session_number",
    "session_start_at",
    "session_end_at",
    "events_in_session",
]


def sessionize(
    df: DataFrame,
    key: str,
    ts: str,
    order_cols: Sequence[str] = (),
    gap_minutes: int = 1440,
    carry: Sequence[str] | None = None,
    strategy: str = "sliced",
    parts: int | None = None,
) -> DataFrame:
    """Add the session columns to every event.

    ``carry``: input columns to keep (default: all).  ``order_cols``: tie
    breakers after ``ts``; pass a unique column last for a deterministic
    order.  ``parts``: see ``slices.sliced``.
    """
    carry = list(df.columns if carry is None else carry)
    order_cols = list(order_cols)
    if strategy == "window":
        return _sessionize_window(df, key, ts, order_cols, gap_minutes, carry)
    if strategy != "sliced":
        raise ValueError(f"unknown strategy {strategy!r}")
    needed = list(dict.fromkeys([*carry, key, ts, *order_cols]))
    cut = sliced(df.select(*needed), key, [ts, *order_cols], parts)
    if cut.heavy is None:
        return _sessionize_window(spread(df.select(*needed), cut.parts, key), key, ts, order_cols, gap_minutes, carry)
    return _sessionize_sliced(cut, ts, order_cols, gap_minutes, carry)


def _is_new(prev, cur, gap_minutes):
    return prev.isNull() | (minutes_between(prev, cur) > F.lit(gap_minutes))


def _sessionize_window(df, key, ts, order_cols, gap_minutes, carry):
    order = Window.partitionBy(key).orderBy(ts, *order_cols)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = df.select(*carry, *([] if key in carry else [key]), *([] if ts in carry else [ts]))
    ev = ev.withColumn("prev_event_at", F.lag(ts).over(order))
    ev = ev.withColumn("gap_minutes", minutes_between("prev_event_at", ts))
    ev = ev.withColumn("is_new_session", _is_new(F.col("prev_event_at"), F.col(ts), gap_minutes))
    ev = ev.withColumn("session_number", F.count_if("is_new_session").over(running))
    per_session = Window.partitionBy(key, "session_number")
    ev = ev.select(
        *carry,
        "prev_event_at",
        "gap_minutes",
        "is_new_session",
        "session_number",
        F.min(ts).over(per_session).alias("session_start_at"),
        F.max(ts).over(per_session).alias("session_end_at"),
        F.count(F.lit(1)).over(per_session).alias("events_in_session"),
    )
    return ev


def _in_slices(rows: DataFrame, ts: str, order_cols: Sequence[str], gap_minutes: int) -> DataFrame:
    """``_prev`` (time before, in the slice), ``_first`` and ``_in``: sessions
    that started in the slice up to this event, not counting its first event."""
    order = Window.partitionBy(*Sliced.PART).orderBy(ts, *order_cols)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = rows.withColumns({"_prev": F.lag(ts).over(order), "_first": F.row_number().over(order) == 1})
    ev = ev.withColumn("_new", ~F.col("_first") & _is_new(F.col("_prev"), F.col(ts), gap_minutes))
    return ev.withColumn("_in", F.count_if("_new").over(running))


def _stitched(cut: Sliced, ts: str, order_cols: Sequence[str], gap_minutes: int) -> DataFrame:
    """What each slice of a heavy key takes from its neighbours: the time
    before it, the number of the session open at its start (``_base``), the
    index of its last session (``_m``), and the start, end and size of the
    sessions at its two ends."""
    ev = _in_slices(cut.of_heavy().select(*Sliced.PART, ts, *[c for c in order_cols if c != ts]), ts, order_cols, gap_minutes)
    each = ev.groupBy(*Sliced.PART, "_in").agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"), F.count("*").alias("_n"))
    part = F.struct("_a", "_z", "_n")
    ends = each.groupBy(*Sliced.PART).agg(
        F.max("_in").alias("_m"), F.max("_z").alias("_last"), F.min("_a").alias("_start"),
        F.max_by(part, -F.col("_in")).alias("_head"), F.max_by(part, F.col("_in")).alias("_tail"))
    # along the key: one row a slice
    along = cut.per_key()
    ends = ends.withColumn("_before", F.lag("_last").over(along))
    ends = ends.withColumn("_opens", _is_new(F.col("_before"), F.col("_head._a"), gap_minutes))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("_base", F.sum(F.col("_opens").cast("bigint") + F.col("_m")).over(upto) - F.col("_m"))
    # the parts of the sessions at the ends, added up by session
    head = ends.select("_k", "_kn", "_s", F.col("_base").alias("_id"), "_head.*")
    tail = ends.where("_m > 0").select("_k", "_kn", "_s", (F.col("_base") + F.col("_m")).alias("_id"), "_tail.*")
    whole = Window.partitionBy("_k", "_kn", "_id")
    joined = head.unionByName(tail).select(
        "_k", "_kn", "_s", "_id", F.struct(F.min("_a").over(whole).alias("a"), F.max("_z").over(whole).alias("z"), F.sum("_n").over(whole).alias("n")).alias("_whole"))
    low = joined.groupBy(*Sliced.PART).agg(F.min_by("_whole", "_id").alias("_low"), F.max_by("_whole", "_id").alias("_high"))
    return ends.select(*Sliced.PART, "_before", "_opens", "_base", "_m").join(low, list(Sliced.PART))


def _sessionize_sliced(cut: Sliced, ts, order_cols, gap_minutes, carry):
    ev = _in_slices(cut.rows, ts, order_cols, gap_minutes)
    mine = Window.partitionBy(*Sliced.PART, "_in")
    ev = ev.withColumns({"_a": F.min(ts).over(mine), "_z": F.max(ts).over(mine), "_n": F.count(F.lit(1)).over(mine)})
    # no more rows than slices
    j = ev.join(F.broadcast(_stitched(cut, ts, order_cols, gap_minutes)), list(Sliced.PART), "left")
    prev = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))
    is_new = F.when(F.col("_first"), F.coalesce("_opens", F.lit(True))).otherwise(F.col("_new"))
    end = F.when(F.col("_in") == 0, F.col("_low")).when(F.col("_in") == F.col("_m"), F.col("_high"))
    pick = lambda field, own: F.when(end.isNotNull(), end[field]).otherwise(F.col(own))
    return j.select(
        *carry,
        prev.alias("prev_event_at"),
        minutes_between(prev, F.col(ts)).alias("gap_minutes"),
        is_new.alias("is_new_session"),
        (F.coalesce("_base", F.lit(1)) + F.col("_in")).cast("bigint").alias("session_number"),
        pick("a", "_a").alias("session_start_at"),
        pick("z", "_z").alias("session_end_at"),
        pick("n", "_n").alias("events_in_session"),
    )


def expert_sessions(stg_events: DataFrame, gap_minutes: int = 1440, strategy: str = "sliced", parts: int | None = None) -> DataFrame:
    """Sessions of the funnel events: ordered by (event_at, stage_order, event_id)."""
    return sessionize(
        stg_events,
        key="expert_id",
        ts="event_at",
        order_cols=["stage_order", "event_id"],
        gap_minutes=gap_minutes,
        carry=["event_id", "expert_id", "event_name", "event_at", "stage_order"],
        strategy=strategy,
        parts=parts,
    )


def event_sessions(events: DataFrame, gap_minutes: int = 1440, strategy: str = "sliced", parts: int | None = None) -> DataFrame:
    """The same operator on the generic ``events`` table (user_id, ts, event_id)."""
    return sessionize(
        events,
        key="user_id",
        ts="ts",
        order_cols=["event_id"],
        gap_minutes=gap_minutes,
        carry=["event_id", "user_id", "event_type", "ts"],
        strategy=strategy,
        parts=parts,
    )
