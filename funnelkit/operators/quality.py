"""Data-quality checks: the generic column tests and the four business tests.

Every check returns a report -- one row per (table, column) for the generic
tests, one row for each business test -- with the failing and total row
counts and a ``failed`` flag, so a passing check is a row too.  Checks on
the same table share one scan where they can (all not-null columns of a
table are one aggregate); a uniqueness test is one aggregate keyed by the
column (map-side combined).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..functions.vocab import (
    ENGAGEMENT_TYPES,
    EVENT_NAMES,
    NULL_PAYOUT_THRESHOLD,
    NULL_UTM_THRESHOLD,
    PAID_CHANNELS,
    SIGNUP_SOURCES,
    TIMESTAMP_ORDER_THRESHOLD,
    UNPAID_CHANNELS,
)
from ..session import stored
from .slices import Sliced, sliced
from .staging import STAGING_COLUMNS

REPORT_COLUMNS = ["check_name", "table_name", "column_name", "failing_rows", "total_rows", "failed"]


def _report(df: DataFrame, check: str, table: str, column: str, failing, total) -> DataFrame:
    return df.agg(failing.cast("bigint").alias("failing_rows"), total.cast("bigint").alias("total_rows")).select(
        F.lit(check).alias("check_name"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        "failing_rows",
        "total_rows",
        (F.col("failing_rows") > 0).alias("failed"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Rows with NULL, per column; one scan for all columns of the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.select(
        F.lit("not_null").alias("check_name"),
        F.lit(table).alias("table_name"),
        F.expr(f"stack({len(columns)}, {rows}) AS (column_name, failing_rows)"),
        F.col("_total").alias("total_rows"),
    ).select(*REPORT_COLUMNS[:-1], (F.col("failing_rows") > 0).alias("failed"))


def unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """Number of non-NULL values that occur more than once."""
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return _report(
        per_value, "unique", table, column, F.count_if(F.col(column).isNotNull() & (F.col("_n") > 1)), F.sum("_n")
    )


def accepted_values(df: DataFrame, table: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is outside the list (NULL passes)."""
    return _report(df, "accepted_values", table, column, F.count_if(~F.col(column).isin(list(values))), F.count(F.lit(1)))


def relationships(child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent row.

    Both sides are first reduced to one row per key (the child side with a
    map-side-combined count), so the join sees distinct keys only: a hot
    child key costs one row, and the join cannot fan out.
    """
    child_keys = child.groupBy(F.col(column).alias("_ck")).agg(F.count(F.lit(1)).alias("_n"))
    keys = parent.select(F.col(parent_column).alias("_pk")).where(F.col("_pk").isNotNull()).distinct()
    keys = keys.withColumn("_hit", F.lit(True))
    j = child_keys.join(keys.hint("merge"), F.col("_ck") == F.col("_pk"), "left")
    orphan = F.col("_ck").isNotNull() & F.col("_hit").isNull()
    return _report(
        j, "relationships", table, column, F.sum(F.when(orphan, F.col("_n")).otherwise(F.lit(0))), F.sum("_n")
    )


# declared tests per source table: source columns, and the staging model's
# columns, that must not be NULL; the key that must be unique; accepted values
SOURCE_TESTS = {
    "experts": {
        "not_null": ["expert_id", "signup_date", "signup_source", "country", "industry"],
        "stg_not_null": ["expert_id", "signup_source"],
        "unique": "expert_id",
        "accepted": ("signup_source", SIGNUP_SOURCES),
    },
    "funnel_events": {
        "not_null": ["event_id", "expert_id", "event_name", "event_timestamp"],
        "stg_not_null": ["event_id", "expert_id", "stage_order"],
        "unique": "event_id",
        "accepted": ("event_name", EVENT_NAMES),
    },
    "engagements": {
        "not_null": ["engagement_id", "expert_id", "engagement_type", "engagement_date", "payout_amount", "client_industry"],
        "stg_not_null": ["engagement_id", "payout_amount"],
        "unique": "engagement_id",
        "accepted": ("engagement_type", ENGAGEMENT_TYPES),
    },
    "daily_channel_spend": {
        "not_null": ["date", "channel", "campaign_name", "spend_usd", "impressions", "clicks"],
        "stg_not_null": ["spend_usd"],
        "unique": None,
        "accepted": ("channel", PAID_CHANNELS),
    },
}


def _source_checks(raw: DataFrame, table: str, spec: dict, kind: str) -> DataFrame:
    """The source-level and staging-level checks of one table in one scan.

    Staging is a projection of its source (same rows), so both sets of
    column checks are conditional counts of a single aggregate over the
    source; the report has one row per (table, column).
    """
    stg_name, stg_cols = STAGING_COLUMNS[table]
    combined = raw.select(*[F.col(c).alias(f"raw__{c}") for c in raw.columns], *stg_cols())
    checks = []  # (table, column, failing-row condition)
    if kind == "not_null":
        checks += [(table, c, F.col(f"raw__{c}").isNull()) for c in spec["not_null"]]
        checks += [(stg_name, c, F.col(c).isNull()) for c in spec["stg_not_null"]]
    else:
        col, values = spec["accepted"]
        checks += [(table, col, ~F.col(f"raw__{col}").isin(list(values)))]
        checks += [(stg_name, col, ~F.col(col).isin(list(values)))]
    counts = combined.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(c).alias(f"_f{i}") for i, (_, _, c) in enumerate(checks)])
    rows = ", ".join(f"'{t}', '{c}', `_f{i}`" for i, (t, c, _) in enumerate(checks))
    return counts.select(
        F.lit(kind).alias("check_name"),
        F.expr(f"stack({len(checks)}, {rows}) AS (table_name, column_name, failing_rows)"),
        F.col("_total").alias("total_rows"),
    ).select(*REPORT_COLUMNS[:-1], (F.col("failing_rows") > 0).alias("failed"))


def _unique_both(raw: DataFrame, table: str, column: str) -> DataFrame:
    """Uniqueness of a key that staging passes through unchanged: one
    aggregate, reported for the source and for the staging model."""
    stg_name = STAGING_COLUMNS[table][0]
    r = unique(raw, table, column)
    return r.unionByName(r.withColumn("table_name", F.lit(stg_name)))


def source_and_model_tests(m) -> dict[str, DataFrame]:
    """The declared column tests of sources, staging, intermediate and marts."""
    from . import funnel, reports

    raw = m.raw.as_dict()
    fc = funnel.funnel_conversion(m.expert_funnel_summary)
    cc = reports.cohort_conversion(m.expert_with_engagement)
    cp = reports.channel_performance(m.expert_with_engagement, m.channel_spend_summary)
    nn = [_source_checks(raw[t], t, spec, "not_null") for t, spec in SOURCE_TESTS.items()]
    nn += [
        not_null(m.expert_funnel_summary, "expert_funnel_summary", ["expert_id"]),
        not_null(m.expert_with_engagement, "expert_with_engagement", ["expert_id"]),
        not_null(m.expert_sessions, "expert_sessions", ["event_id"]),
        not_null(fc, "funnel_conversion", ["stage", "experts_reached"]),
        not_null(cc, "cohort_conversion", ["signup_week"]),
        not_null(cp, "channel_performance", ["signup_source"]),
    ]
    uq = [_unique_both(raw[t], t, spec["unique"]) for t, spec in SOURCE_TESTS.items() if spec["unique"]]
    uq += [
        unique(m.expert_funnel_summary, "expert_funnel_summary", "expert_id"),
        unique(m.expert_with_engagement, "expert_with_engagement", "expert_id"),
        unique(m.expert_sessions, "expert_sessions", "event_id"),
        unique(cc, "cohort_conversion", "signup_week"),
        unique(cp, "channel_performance", "signup_source"),
    ]
    av = [_source_checks(raw[t], t, spec, "accepted_values") for t, spec in SOURCE_TESTS.items()]
    rel = [
        relationships(raw["funnel_events"], "funnel_events", "expert_id", raw["experts"], "expert_id"),
        relationships(raw["engagements"], "engagements", "expert_id", raw["experts"], "expert_id"),
    ]
    return {
        "dq_not_null": _union(nn),
        "dq_unique": _union(uq),
        "dq_accepted_values": _union(av),
        "dq_relationships": _union(rel),
    }


def null_utm(stg_experts: DataFrame, threshold: float = NULL_UTM_THRESHOLD) -> DataFrame:
    """Paid experts with all three UTMs NULL, over all experts (> threshold
    fails); the share over paid experts alone is reported alongside."""
    all_null = F.col("utm_campaign").isNull() & F.col("utm_medium").isNull() & F.col("utm_source").isNull()
    paid = ~F.col("signup_source").isin(UNPAID_CHANNELS)
    g = stg_experts.agg(
        F.count(F.lit(1)).alias("total_experts"),
        F.count_if(all_null & paid).alias("paid_with_all_nulls"),
        F.count_if(paid).alias("paid_experts"),
    )
    ratio = safe_div("paid_with_all_nulls", "total_experts")
    return g.select(
        "total_experts",
        "paid_with_all_nulls",
        "paid_experts",
        F.round(ratio, 6).alias("failure_ratio"),
        F.round(safe_div("paid_with_all_nulls", "paid_experts"), 6).alias("paid_only_ratio"),
        F.coalesce(ratio > F.lit(threshold), F.lit(False)).alias("failed"),
    )


def timestamp_ordering(
    stg_events: DataFrame, threshold: float = TIMESTAMP_ORDER_THRESHOLD, parts: int | None = None
) -> DataFrame:
    """Experts with an event whose stage is lower than the previous event's
    (time order, ties by stage then event_id), over all experts.

    Rows are ordered per expert, heavy experts' rows per slice (see
    ``slices``): a slice yields its violations and its first and last stage,
    and each of its borders is checked along the expert's slices.
    """
    order = ["event_at", "stage_order", "event_id"]
    cut = sliced(stg_events.select("expert_id", *order), "expert_id", order, parts)
    w = Window.partitionBy(*Sliced.PART).orderBy(*order)
    prev = F.lag("stage_order").over(w)
    ev = cut.rows.select(*Sliced.PART, F.row_number().over(w).alias("_i"), "stage_order", (prev.isNotNull() & (F.col("stage_order") < prev)).alias("_v"))
    if cut.heavy is None:
        per_expert = ev.groupBy(*Sliced.PART).agg(F.count_if("_v").alias("_v"))
    else:
        per_slice = ev.groupBy(*Sliced.PART).agg(
            F.count_if("_v").alias("_in"), F.min_by("stage_order", "_i").alias("_first"), F.max_by("stage_order", "_i").alias("_last"))
        before = F.lag("_last").over(cut.per_key())
        per_slice = per_slice.withColumn("_at", before.isNotNull() & (F.col("_first") < before))
        per_expert = per_slice.groupBy("_k", "_kn").agg((F.sum("_in") + F.count_if("_at")).alias("_v"))
    g = per_expert.agg(
        F.count_if(~F.col("_kn")).alias("total_experts"), F.count_if(F.col("_v") > 0).alias("experts_with_violations")
    )
    ratio = safe_div("experts_with_violations", "total_experts")
    return g.select(
        "total_experts",
        "experts_with_violations",
        F.round(ratio, 6).alias("failure_ratio"),
        F.coalesce(ratio > F.lit(threshold), F.lit(False)).alias("failed"),
    )


def activated_rejected(summary: DataFrame) -> DataFrame:
    """Rejected experts that nevertheless have a first engagement (any row fails)."""
    return summary.where(F.col("is_rejected") & F.col("first_engagement_at").isNotNull()).select(
        "expert_id", "is_rejected", "reached_activated"
    )


def null_payout(stg_engagements: DataFrame, threshold: float = NULL_PAYOUT_THRESHOLD) -> DataFrame:
    """NULL or zero payouts over all engagements (> threshold fails)."""
    g = stg_engagements.agg(
        F.count(F.lit(1)).alias("total_engagements"),
        F.count_if(F.col("payout_amount").isNull() | (F.col("payout_amount") == 0)).alias("null_or_zero_payouts"),
    )
    ratio = safe_div("null_or_zero_payouts", "total_engagements")
    return g.select(
        "total_engagements",
        "null_or_zero_payouts",
        F.round(ratio, 6).alias("failure_ratio"),
        F.coalesce(ratio > F.lit(threshold), F.lit(False)).alias("failed"),
    )


def run_all(m) -> DataFrame:
    """Every check of the project as one report (check, table, column,
    failing rows, total rows, failed): the generic column tests plus the four
    business tests, the latter failing on their thresholds."""
    generic = source_and_model_tests(m)
    no_col = F.lit(None).cast("string")

    def row(df: DataFrame, check: str, table: str, failing: str, total: str) -> DataFrame:
        return df.select(
            F.lit(check).alias("check_name"),
            F.lit(table).alias("table_name"),
            no_col.alias("column_name"),
            F.col(failing).cast("bigint").alias("failing_rows"),
            F.col(total).cast("bigint").alias("total_rows"),
            "failed",
        )

    rejected = m.expert_funnel_summary.agg(
        F.count_if(F.col("is_rejected") & F.col("first_engagement_at").isNotNull()).alias("_bad"),
        F.count(F.lit(1)).alias("_all"),
    ).withColumn("failed", F.col("_bad") > 0)
    singular = [
        row(null_utm(m.stg_experts), "null_utm", "stg_experts", "paid_with_all_nulls", "total_experts"),
        row(
            timestamp_ordering(m.stg_funnel_events),
            "timestamp_ordering",
            "stg_funnel_events",
            "experts_with_violations",
            "total_experts",
        ),
        row(rejected, "no_activated_rejected", "expert_funnel_summary", "_bad", "_all"),
        row(null_payout(m.stg_engagements), "null_payout", "stg_engagements", "null_or_zero_payouts", "total_engagements"),
    ]
    return _union([*generic.values(), *singular])


# ------------------------------------------------------ the rows that fail

#: key columns of every checked table
TABLE_KEYS = {
    "experts": ["expert_id"],
    "funnel_events": ["event_id"],
    "engagements": ["engagement_id"],
    "daily_channel_spend": ["date", "channel", "campaign_name"],
    "stg_experts": ["expert_id"],
    "stg_funnel_events": ["event_id"],
    "stg_engagements": ["engagement_id"],
    "stg_daily_channel_spend": ["spend_date", "channel", "campaign_name"],
    "expert_funnel_summary": ["expert_id"],
    "expert_with_engagement": ["expert_id"],
    "expert_sessions": ["event_id"],
    "funnel_conversion": ["stage"],
    "cohort_conversion": ["signup_week"],
    "channel_performance": ["signup_source"],
}

#: columns of the models and marts, beside those of ``SOURCE_TESTS``
MODEL_NOT_NULL = {
    "expert_funnel_summary": ["expert_id"],
    "expert_with_engagement": ["expert_id"],
    "expert_sessions": ["event_id"],
    "funnel_conversion": ["stage", "experts_reached"],
    "cohort_conversion": ["signup_week"],
    "channel_performance": ["signup_source"],
}
MODEL_UNIQUE = {
    "expert_funnel_summary": "expert_id",
    "expert_with_engagement": "expert_id",
    "expert_sessions": "event_id",
    "cohort_conversion": "signup_week",
    "channel_performance": "signup_source",
}


def checked_table(m, table: str) -> DataFrame:
    """A table of the graph by the name that checks report it under."""
    from . import funnel, reports

    if table in SOURCE_TESTS:
        return m.raw.table(table)
    if table == "funnel_conversion":
        return funnel.funnel_conversion(m.expert_funnel_summary)
    if table == "cohort_conversion":
        return reports.cohort_conversion(m.expert_with_engagement)
    if table == "channel_performance":
        return reports.channel_performance(m.expert_with_engagement, m.channel_spend_summary)
    return getattr(m, table)


def declared(check: str) -> list[tuple[str, str]]:
    """(table, column) of every place where a generic check is declared."""
    staged = {t: STAGING_COLUMNS[t][0] for t in SOURCE_TESTS}
    if check == "not_null":
        found = [(t, c) for t, spec in SOURCE_TESTS.items() for c in spec["not_null"]]
        found += [(staged[t], c) for t, spec in SOURCE_TESTS.items() for c in spec["stg_not_null"]]
        return found + [(t, c) for t, cols in MODEL_NOT_NULL.items() for c in cols]
    if check == "unique":
        found = [(name, spec["unique"]) for t, spec in SOURCE_TESTS.items() if spec["unique"] for name in (t, staged[t])]
        return found + list(MODEL_UNIQUE.items())
    if check == "accepted_values":
        return [(name, spec["accepted"][0]) for t, spec in SOURCE_TESTS.items() for name in (t, staged[t])]
    if check == "relationships":
        return [("funnel_events", "expert_id"), ("engagements", "expert_id")]
    raise ValueError(f"no generic check {check!r}")


def _repeated_keys(m, table: str, column: str) -> DataFrame:
    """The column's values that occur more than once, stored.  Staging passes
    keys through unchanged, so a source and its staging model share them."""
    source = next((t for t in SOURCE_TESTS if table == STAGING_COLUMNS[t][0]), table)
    found = m.__dict__.setdefault("_repeated", {})
    if (source, column) not in found:
        df = checked_table(m, source)
        bad = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        found[source, column] = stored(bad.select(column), f"repeated-{source}")
    return found[source, column]


def failing_rows(m, check: str, table: str, column: str) -> DataFrame:
    """The rows of ``table`` that fail a generic check, with all their columns.

    Uniqueness finds the bad keys first, by an aggregate with map-side combine,
    and stores them, so that the semi-join that reads the table once more is
    planned by their real size: few are broadcast, many are joined.  A key that
    a third of the rows repeat is one bad key.  For relationships, rows with a
    key are joined to the known keys once.  Those are as many as there are
    parents and never broadcast: the statistics of a compressed file tell less
    than they take on the driver.  Skewed joins are split at run time.
    """
    df = checked_table(m, table)
    if check == "not_null":
        return df.where(F.col(column).isNull())
    if check == "accepted_values":
        source = next(t for t in SOURCE_TESTS if table in (t, STAGING_COLUMNS[t][0]))
        return df.where(~F.col(column).isin(list(SOURCE_TESTS[source]["accepted"][1])))
    if check == "unique":
        return df.join(_repeated_keys(m, table, column), column, "left_semi").select(*df.columns)
    if check == "relationships":
        known = m.raw.experts.select(F.col("expert_id").alias(column)).where(F.col(column).isNotNull())
        return df.where(F.col(column).isNotNull()).join(known.hint("merge"), column, "left_anti").select(*df.columns)
    raise ValueError(f"no generic check {check!r}")


def misplaced_events(stg_events: DataFrame, parts: int | None = None) -> DataFrame:
    """Events whose stage is lower than that of the expert's event before
    (time order, ties by stage then event_id), with ``previous_stage_order``."""
    order = ["event_at", "stage_order", "event_id"]
    cut = sliced(stg_events, "expert_id", order, parts)
    w = Window.partitionBy(*Sliced.PART).orderBy(*order)
    ev = cut.rows.withColumns({"_i": F.row_number().over(w), "previous_stage_order": F.lag("stage_order").over(w)})
    if cut.heavy is not None:
        # the last stage of the slice before, one row a slice
        rows = cut.of_heavy().select(*Sliced.PART, F.row_number().over(w).alias("_i"), "stage_order")
        last = rows.groupBy(*Sliced.PART).agg(F.max_by("stage_order", "_i").alias("_last"))
        before = last.select(*Sliced.PART, F.lag("_last").over(cut.per_key()).alias("_before"))
        ev = ev.join(F.broadcast(before), list(Sliced.PART), "left")
        ev = ev.withColumn("previous_stage_order", F.when(F.col("_i") == 1, F.col("_before")).otherwise(F.col("previous_stage_order")))
    return ev.where(F.col("stage_order") < F.col("previous_stage_order")).select(*stg_events.columns, "previous_stage_order")


def failures(m, check: str) -> DataFrame:
    """Every offending row of a check: check_name, table_name, column_name,
    row_key (the row's key, as text) and value (what is wrong there, as text).

    ``check`` is a generic check (not_null, unique, accepted_values,
    relationships) over all the places where it is declared, or null_utm,
    timestamp_ordering, no_activated_rejected, null_payout.  A listing never
    depends on a check's threshold.
    """

    def rows(df: DataFrame, table: str, column: str, value) -> DataFrame:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in TABLE_KEYS[table]])
        return df.select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.lit(column).cast("string").alias("column_name"), key.alias("row_key"),
                         value.cast("string").alias("value"))

    if check == "null_utm":
        bad = F.coalesce("utm_campaign", "utm_medium", "utm_source").isNull() & ~F.col("signup_source").isin(UNPAID_CHANNELS)
        return rows(m.stg_experts.where(bad), "stg_experts", "utm_campaign", F.col("signup_source"))
    if check == "timestamp_ordering":
        found = misplaced_events(m.stg_funnel_events)
        return rows(found, "stg_funnel_events", "stage_order", F.concat_ws(" after ", F.col("stage_order").cast("string"), F.col("previous_stage_order").cast("string")))
    if check == "no_activated_rejected":
        return rows(activated_rejected(m.expert_funnel_summary), "expert_funnel_summary", "is_rejected", F.col("is_rejected"))
    if check == "null_payout":
        bad = F.coalesce(F.col("payout_amount") == 0, F.lit(True))
        return rows(m.stg_engagements.where(bad), "stg_engagements", "payout_amount", F.col("payout_amount"))
    return _union([rows(failing_rows(m, check, t, c), t, c, F.col(c)) for t, c in declared(check)])
