"""Ordered work within a key, with heavy keys cut into slices.

A window partitioned by a key sorts all rows of the key in one task.  That is
right for as long as no key holds more than a task's share of the rows.  Here
a bounded sample tells which keys do; their rows, and only theirs, are cut
into slices at sampled places of the key's order (time and tie-breakers
together, so one instant or a stretch of NULL times can be cut too).  A row
finds its slice by a binary search among its key's cuts.  Work then runs per
(key, slice), with one exchange of the rows, and what crosses a cut is carried
by one row per slice of a heavy key: never more rows than there are slices.

The sample only decides where work is cut, not what is computed: any cuts
give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: sampled rows for each slice that the input would fill
SAMPLE = 48
#: a key is heavy if it holds this many shares of the input
HEAVY = 2
#: rows that one task sorts
TASK_ROWS = 1_000_000


def task_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for ordered work on so many rows: the session's, or more if
    a task would then sort more than ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` where that takes more partitions than the
    session's; else windows on the keys deal it themselves."""
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts, *keys)


def stand_in(key, dtype):
    """A never-NULL column that is equal where the keys are (a NULL key gets
    the value of some other key, from which ``_kn`` tells it)."""
    if isinstance(dtype, T.NumericType):
        return F.coalesce(key, F.lit(0).cast(dtype))
    if isinstance(dtype, T.BinaryType):
        key = F.hex(key)
    return F.coalesce(key.cast("string"), F.lit(""))


@dataclass
class Sliced:
    """Rows with their key (``_k``, ``_kn``) and slice (``_s``)."""

    rows: DataFrame
    heavy: DataFrame | None  # (_k, _kn, _cuts) of the keys that are cut, if any
    parts: int  # partitions that the rows fill

    PART = ("_k", "_kn", "_s")

    def of_heavy(self) -> DataFrame:
        """The heavy keys' rows alone."""
        return self.rows.where(F.col("_cut"))

    def per_key(self):
        """Order of a key's slices."""
        return Window.partitionBy("_k", "_kn").orderBy("_s")


def _heavy_keys(keyed: DataFrame, order: Sequence[str], parts: int, total: int) -> DataFrame | None:
    """(_k, _kn, _cuts): the keys with ``HEAVY`` shares of ``parts`` or more
    in a sample of the ``total`` rows, each with its cuts.  Together fewer
    cuts than parts."""
    if not total:
        return None
    share = min(1.0, SAMPLE * parts / total)
    here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sampled = keyed.select("_k", "_kn", here.alias("_at"))
    if share < 1:
        sampled = sampled.sample(share, seed=17)
    per_part = max(1.0, min(total, SAMPLE * parts) / parts)
    found = sampled.groupBy("_k", "_kn").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("_at")).alias("_all"))
    found = found.where(F.col("_n") >= HEAVY * per_part)
    pieces = F.ceil(F.col("_n") / F.lit(per_part)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("_all", F.floor(i * F.col("_n") / pieces).cast("int")))
    # fixed on the driver, so that every reader cuts alike
    found = found.select("_k", "_kn", F.array_distinct(cuts).alias("_cuts"))
    rows = found.collect()
    return keyed.sparkSession.createDataFrame(rows, found.schema) if rows else None


def sliced(df: DataFrame, key: str, order: Sequence[str], parts: int | None = None) -> Sliced:
    """``df`` with slices; ``order`` is the key's order, ascending, NULLs first.

    ``parts``: slices that the whole input is meant to fill, by default the
    session's shuffle partitions or one for every ``TASK_ROWS`` rows, whichever
    is more.
    """
    total = df.count()
    parts = parts or task_parts(df.sparkSession, total)
    keyed = df.withColumns({"_k": stand_in(F.col(key), df.schema[key].dataType), "_kn": F.col(key).isNull()})
    heavy = _heavy_keys(keyed, order, parts, total)
    if heavy is None:
        return Sliced(spread(keyed, parts, "_k", "_kn").withColumns({"_s": F.lit(0), "_cut": F.lit(False)}), None, parts)
    longest = max(len(r["_cuts"]) for r in heavy.select("_cuts").collect())
    here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(longest.bit_length()))])

    def further(place, step):
        to = place + step
        return F.when((to <= F.size("_cuts")) & (F.get("_cuts", to - 1) <= F.col("_here")), to).otherwise(place)

    # at most ``parts`` cuts in all
    joined = keyed.join(F.broadcast(heavy), ["_k", "_kn"], "left").withColumn("_here", here)
    found = joined.withColumns({"_s": F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), further)), "_cut": F.col("_cuts").isNotNull()})
    return Sliced(spread(found.drop("_cuts", "_here"), parts, *Sliced.PART), heavy, parts)
