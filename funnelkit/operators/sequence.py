"""Time buckets for ordered work within a key, without sorting a whole key in
one task.

Operators that need a key's rows in time order (sessions, ordering checks)
sort only (key, time bucket) slices and carry what crosses a bucket border
through a summary of one row per key and bucket, built with map-side
combine.  A key holding a third of all rows is thus spread over its buckets;
only its summary -- bounded by its time span over the bucket width -- is
ordered per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_BUCKET = -(2**63)  # bucket of NULL times; sorts first, as NULL times do
BUCKET_MINUTES = {"minute": 1, "hour": 60, "day": 1440}


def stand_in(key, dtype):
    """A never-NULL column that is equal where the keys are (a NULL key gets
    the value of some other key, from which ``_kn`` tells it)."""
    if isinstance(dtype, T.NumericType):
        return F.coalesce(key, F.lit(0).cast(dtype))
    if isinstance(dtype, T.BinaryType):
        key = F.hex(key)
    return F.coalesce(key.cast("string"), F.lit(""))


def with_bucket_keys(df: DataFrame, key: str, ts: str, bucket: str) -> DataFrame:
    """Add ``_k``, ``_kn`` (key, key-is-null) and ``_b`` (time bucket index).

    NULL keys and NULL times get non-null stand-ins so equi-joins keep them.
    """
    width_us = BUCKET_MINUTES[bucket] * 60_000_000
    epoch = F.lit("1970-01-01 00:00:00").cast(df.schema[ts].dataType)
    return df.select(
        "*",
        stand_in(F.col(key), df.schema[key].dataType).alias("_k"),
        F.col(key).isNull().alias("_kn"),
        F.coalesce(
            F.floor(F.timestamp_diff("MICROSECOND", epoch, F.col(ts)) / F.lit(float(width_us))).cast("bigint"),
            F.lit(NO_BUCKET).cast("bigint"),
        ).alias("_b"),
    )
