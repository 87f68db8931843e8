"""Per-group quantiles that stay distributed.

``exact`` (default) gives the discrete quantile -- the smallest value whose
cumulative count reaches ceil(p * n) -- the value an element-returning
quantile (no interpolation) picks.  It never holds a group's rows in one
task: rows are first reduced to a histogram ``(group, value) -> count`` with
map-side combine, so a group holding a third of all rows costs no more than
its number of *distinct* values.  The running count then runs over that
histogram, partitioned by group.  Use it for discrete measures (whole hours,
days, session counts), whose distinct values are bounded by the time range.

``approx`` is ``percentile_approx`` (a mergeable sketch, relative rank error
1/accuracy) for continuous measures with unbounded distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import col_


def group_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value: str | Column,
    probs: Sequence[float],
    names: Sequence[str],
    method: str = "exact",
    accuracy: int = 10000,
) -> DataFrame:
    """One row per group with one column per probability (NULLs ignored).

    Groups whose values are all NULL do not appear; left-join the result to
    the group's other aggregates to keep them.
    """
    group_cols = list(group_cols)
    v = col_(value).alias("_qv")
    base = df.select(*group_cols, v).where(F.col("_qv").isNotNull())
    if method == "approx":
        arr = F.percentile_approx("_qv", list(probs), accuracy)
        out = base.groupBy(*group_cols).agg(arr.alias("_qs"))
        return out.select(*group_cols, *[F.col("_qs")[i].alias(n) for i, n in enumerate(names)])
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")

    hist = base.groupBy(*group_cols, "_qv").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group_cols).orderBy("_qv").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group_cols)
    hist = hist.withColumn("_cum", F.sum("_n").over(running)).withColumn("_tot", F.sum("_n").over(whole))
    picks = []
    for p, name in zip(probs, names):
        rank = F.greatest(F.ceil(F.lit(float(p)) * F.col("_tot")), F.lit(1))
        picks.append(F.min(F.when(F.col("_cum") >= rank, F.col("_qv"))).alias(name))
    return hist.groupBy(*group_cols).agg(*picks)


def histogram_stats(
    df: DataFrame,
    group_cols: Sequence[str],
    value: str | Column,
    probs: Sequence[float] = (),
    names: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Counts, sums and exact discrete quantiles of ``value`` per group, in one pass.

    Rows are reduced once to ``(group, value)`` buckets -- map-side combined,
    so a hot group costs its number of distinct values -- carrying the row
    count and any extra per-row sums; everything else is computed from those
    buckets.  Output per group: ``_rows`` (all rows), ``_n`` (rows with a
    non-NULL value), ``_sum`` (sum of the value, exact for integers), each
    extra sum under its name, and one column per quantile.  Callers derive
    averages as ``_sum / _n``: the exact sum divided once, as SQL's AVG of
    an integer column gives.
    """
    group_cols = list(group_cols)
    sums = dict(sums or {})
    base = df.select(*group_cols, col_(value).alias("_qv"), *[c.alias(f"_s_{k}") for k, c in sums.items()])
    hist = base.groupBy(*group_cols, "_qv").agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums]
    )
    nn = F.when(F.col("_qv").isNotNull(), F.col("_c")).otherwise(F.lit(0))
    part = Window.partitionBy(*group_cols)
    running = part.orderBy("_qv").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum(nn).over(running)).withColumn("_tot", F.sum(nn).over(part))
    picks = []
    for p, name in zip(probs, names):
        rank = F.greatest(F.ceil(F.lit(float(p)) * F.col("_tot")), F.lit(1))
        picks.append(F.min(F.when(F.col("_qv").isNotNull() & (F.col("_cum") >= rank), F.col("_qv"))).alias(name))
    return hist.groupBy(*group_cols).agg(
        F.coalesce(F.sum("_c"), F.lit(0).cast("bigint")).alias("_rows"),  # 0, not NULL, on empty input
        F.coalesce(F.sum(nn), F.lit(0).cast("bigint")).alias("_n"),
        F.sum(F.col("_qv") * F.col("_c")).alias("_sum"),
        *[F.sum(f"_s_{k}").alias(k) for k in sums],
        *picks,
    )
