"""Step transitions: pairs of funnel milestones per expert, their timing,
session breaks, and the step-analysis report.

The reference's step model is missing (its file holds the report body and
reads itself); it is rebuilt from its consumer and its description: per
expert, the first event of each name (by time, then event_id) with its
session number; canonical neighbouring milestones are paired when both
exist; duration in whole hours (may be negative), session distance = next
minus current session number, a new session is needed when it is positive.

Plan: every report here reads the sessions once.  One aggregate keyed by
expert_id (the *rollup*: pivot, first event per name, last session number;
all MIN/MAX, so hot experts combine map-side) feeds everything; pairs come
out of it with ``inline`` -- no self-join, no window over experts -- and the
statistics are one histogram pass (see ``histogram_stats``).  Only
aggregates of a few rows are joined or windowed afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import histogram_stats
from ..functions.scalar import hours_between, pct
from ..functions.vocab import EVENT_NAMES, QUANTILES, REPORT_STAGES, STAGE_TIME_COLUMNS, STEP_DEST_STAGE, STEP_PAIRS
from .funnel import pivot_aggs, reached_columns

_Q_NAMES = ["_q50", "_q75", "_q90"]


_TIME_COL = dict(STAGE_TIME_COLUMNS)


def expert_rollup(expert_sessions: DataFrame) -> DataFrame:
    """One row per expert from the sessionised events: the funnel pivot and
    reached flags, the session of the first event of each name
    (``session_<event>``), and the last session number.

    Session numbers never decrease along an expert's time order and events at
    the same instant share a session, so the first event's session is the
    smallest session number among that name's events: plain MIN/MAX over
    primitive columns, which the hash aggregate runs with map-side combine.
    """
    name, at = F.col("event_name"), F.col("event_at")
    first_session = [
        F.min(F.when((name == ev) & at.isNotNull(), F.col("session_number"))).alias(f"session_{ev}") for ev in EVENT_NAMES
    ]
    g = expert_sessions.groupBy("expert_id").agg(
        *pivot_aggs(), *first_session, F.max("session_number").alias("max_session")
    )
    return g.select("*", *reached_columns())


def _end(ev: str):
    """(time, session) of the first event of a name, from the rollup."""
    return F.col(_TIME_COL[ev]), F.col(f"session_{ev}")


def _pair_rows():
    rows = []
    for a, b in STEP_PAIRS:
        (a_at, a_s), (b_at, b_s) = _end(a), _end(b)
        rows.append(
            F.struct(
                F.lit(a).alias("current_step"),
                F.lit(b).alias("next_step"),
                a_at.alias("current_step_at"),
                b_at.alias("next_step_at"),
                (b_s - a_s).alias("sessions_gap"),
            )
        )
    return F.array(*rows)


def _pairs(rollup: DataFrame) -> DataFrame:
    rows = rollup.select("expert_id", F.inline(_pair_rows())).where(
        F.col("current_step_at").isNotNull() & F.col("next_step_at").isNotNull()
    )
    return rows.select(
        "expert_id",
        "current_step",
        "next_step",
        "current_step_at",
        "next_step_at",
        hours_between("current_step_at", "next_step_at").alias("step_duration_hours"),
        "sessions_gap",
        (F.col("sessions_gap") > 0).alias("required_new_session"),
    )


def funnel_step_sessions(expert_sessions: DataFrame) -> DataFrame:
    """One row per expert and canonical transition whose two ends exist."""
    return _pairs(expert_rollup(expert_sessions))


def _avg(sum_col: str, n_col: str, digits: int):
    return F.round(F.try_divide(F.col(sum_col).cast("double"), F.col(n_col).cast("double")), digits)


def _timing_stats(pairs: DataFrame, keys) -> DataFrame:
    return histogram_stats(
        pairs,
        keys,
        "step_duration_hours",
        QUANTILES,
        _Q_NAMES,
        sums={
            "_gap": F.col("sessions_gap"),
            "_gapn": F.col("sessions_gap").isNotNull().cast("bigint"),
            "_brk": F.col("required_new_session").cast("bigint"),
        },
    )


def step_timing(steps: DataFrame) -> DataFrame:
    """Per transition: experts, hours avg/median/p75/p90, session-break %, avg session gap."""
    keys = ["current_step", "next_step"]
    st = _timing_stats(steps, keys)
    return st.select(
        *keys,
        F.col("_rows").alias("experts_with_transition"),
        _avg("_sum", "_n", 1).alias("avg_hours"),
        F.col("_q50").alias("median_hours"),
        F.col("_q75").alias("p75_hours"),
        F.col("_q90").alias("p90_hours"),
        F.round(F.try_divide(F.col("_brk").cast("double") * F.lit(100.0), F.col("_rows").cast("double")), 1).alias(
            "session_break_rate_pct"
        ),
        _avg("_gap", "_gapn", 2).alias("avg_sessions_gap"),
    )


def sessions_to_activate(expert_sessions: DataFrame) -> DataFrame:
    """Mean and median of the last session number of activated experts (one row)."""
    r = expert_rollup(expert_sessions).where(F.col("reached_activated"))
    st = histogram_stats(r, [], "max_session", [0.5], ["_q50"])
    return st.select(
        _avg("_sum", "_n", 2).alias("avg_sessions_to_activate"), F.col("_q50").alias("median_sessions_to_activate")
    )


# measure ids of the step analysis: 0 = the expert, 1..6 = the step pairs in
# STEP_PAIRS order, 7 = the activated expert's session count
_PAIR_MID = {pair: i + 1 for i, pair in enumerate(STEP_PAIRS)}
_STA_MID = len(STEP_PAIRS) + 1


def _stage_dim(spark) -> DataFrame:
    """The six report stages, each with the step pair leading into it."""
    into = {stage: (a, b) for a, b in STEP_PAIRS for ev, stage in STEP_DEST_STAGE if ev == b}
    rows = []
    for i, (stage, order, _) in enumerate(REPORT_STAGES):
        pair = into.get(stage)
        rows.append(
            F.struct(
                F.lit(stage).alias("stage"),
                F.lit(order).alias("stage_order"),
                F.lit(i).alias("stage_idx"),
                F.lit(_PAIR_MID.get(pair)).cast("int").alias("pair_mid"),
                F.lit(pair[0] if pair else None).cast("string").alias("pair_from"),
            )
        )
    return spark.range(1).select(F.inline(F.array(*rows)))


def funnel_step_analysis(expert_sessions: DataFrame) -> DataFrame:
    """Six report stages with conversion (1 decimal, the funnel report uses 2),
    drop-off, the timing of the transition into the stage, and
    sessions-to-activate on every row.  The submitted-to-rejected transition
    leads into no report stage, so it appears in ``step_timing`` only, as in
    the reference.

    One pass: the rollup emits per expert one row carrying its six reached
    flags, one row per step pair it completed and, if activated, one row
    with its session count -- all keyed by a small integer measure id.  One
    histogram aggregate turns them into at most 8 statistic rows, which are
    folded onto the six stages.
    """
    return step_analysis_of_rollup(expert_rollup(expert_sessions))


def step_analysis_of_rollup(r: DataFrame) -> DataFrame:
    null_l = F.lit(None).cast("bigint")
    n_stages = len(REPORT_STAGES)

    def row(mid, v, g, keep, flags=None):
        flags = flags or [null_l] * n_stages
        return F.struct(
            F.lit(mid).alias("mid"),
            v.alias("v"),
            g.alias("g"),
            keep.alias("keep"),
            *[f.alias(f"r{i}") for i, f in enumerate(flags)],
        )

    measures = [row(0, null_l, null_l, F.lit(True), [F.col(flag).cast("bigint") for _, _, flag in REPORT_STAGES])]
    for (a, b), mid in _PAIR_MID.items():
        (a_at, a_s), (b_at, b_s) = _end(a), _end(b)
        measures.append(row(mid, hours_between(a_at, b_at), b_s - a_s, a_at.isNotNull() & b_at.isNotNull()))
    measures.append(row(_STA_MID, F.col("max_session"), null_l, F.col("reached_activated")))
    rows = r.select(F.inline(F.array(*measures))).where(F.col("keep"))
    sums = {
        "_gap": F.col("g"),
        "_gapn": F.col("g").isNotNull().cast("bigint"),
        "_brk": (F.col("g") > 0).cast("bigint"),
    }
    sums.update({f"_r{i}": F.col(f"r{i}") for i in range(n_stages)})
    st = histogram_stats(rows, ["mid"], "v", QUANTILES, _Q_NAMES, sums=sums)
    dim = _stage_dim(rows.sparkSession)
    on = (st.mid == 0) | (st.mid == dim.pair_mid) | (st.mid == _STA_MID)
    j = dim.join(F.broadcast(st), on, "left")  # at most 8 statistic rows

    def pick(mid, c):
        return F.max(F.when(F.col("mid") == mid, c))

    reached = None
    for i in range(n_stages):
        c = F.col(f"_r{i}")
        reached = F.when(F.col("stage_idx") == i, c) if reached is None else reached.when(F.col("stage_idx") == i, c)
    pair = F.col("pair_mid")
    # the pair's name is a grouping key (a dimension attribute), so the fold
    # stays a hash aggregate; it shows only when the pair has statistics
    per_stage = j.groupBy("stage", "stage_order", "pair_from").agg(
        F.coalesce(pick(0, reached), F.lit(0).cast("bigint")).alias("experts_reached"),
        pick(pair, F.lit(1)).alias("_has_pair"),
        pick(pair, _avg("_sum", "_n", 1)).alias("avg_hours_to_reach"),
        pick(pair, F.col("_q50")).alias("median_hours_to_reach"),
        pick(pair, F.col("_q75")).alias("p75_hours_to_reach"),
        pick(pair, F.col("_q90")).alias("p90_hours_to_reach"),
        pick(
            pair,
            F.round(F.try_divide(F.col("_brk").cast("double") * F.lit(100.0), F.col("_rows").cast("double")), 1),
        ).alias("session_break_rate_pct"),
        pick(pair, _avg("_gap", "_gapn", 2)).alias("avg_sessions_gap"),
        pick(_STA_MID, _avg("_sum", "_n", 2)).alias("avg_sessions_to_activate"),
        pick(_STA_MID, F.col("_q50")).alias("median_sessions_to_activate"),
    )
    by_stage = Window.orderBy("stage_order")
    prev = F.lag("experts_reached").over(by_stage)
    return per_stage.select(
        "stage",
        "stage_order",
        "experts_reached",
        pct("experts_reached", prev, 1).alias("conversion_from_previous_pct"),
        pct("experts_reached", F.first("experts_reached").over(by_stage), 1).alias("conversion_from_signup_pct"),
        F.round(
            F.lit(100.0) - F.try_divide(F.col("experts_reached").cast("double"), prev.cast("double")) * F.lit(100.0), 1
        ).alias("dropoff_rate_pct"),
        F.when(F.col("_has_pair").isNotNull(), F.col("pair_from")).alias("from_step"),
        "avg_hours_to_reach",
        "median_hours_to_reach",
        "p75_hours_to_reach",
        "p90_hours_to_reach",
        "session_break_rate_pct",
        "avg_sessions_gap",
        "avg_sessions_to_activate",
        "median_sessions_to_activate",
    ).orderBy("stage_order")
