"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.slices import sliced

#: rows up to which one task may number a table
ONE_TASK_ROWS = 100_000


def down(value: Column) -> Column:
    """Sort key that puts large numbers first and NULLs last, ascending."""
    return F.coalesce(-value.cast("double"), F.lit(float("inf")))


def global_row_numbers(df: DataFrame, orders: dict[str, list[Column]], rows: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``df`` (of ``rows`` rows, stored) with a row number for each named order.

    A small table is numbered by one window.  A larger one is cut into slices
    of the order at sampled places; a row's number is its place in the slice
    after all slices before it, whose sizes come back as a broadcast of one row
    per slice.  Orders are ascending and must not have ties.
    """
    for name, order in orders.items():
        if rows <= one_task_rows:
            df = df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
            continue
        columns = [f"_o{i}" for i in range(len(order))]
        keyed = df.withColumns({c: o for c, o in zip(columns, order, strict=True)} | {"_all": F.lit(0)})
        cut = sliced(keyed, "_all", columns)
        placed = cut.rows.withColumn("_place", F.row_number().over(Window.partitionBy(*cut.PART).orderBy(*columns)))
        before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
        sizes = cut.rows.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        df = placed.join(F.broadcast(sizes), "_s").withColumn(name, (F.col("_before") + F.col("_place")).cast("int"))
        df = df.drop(*columns, "_all", "_k", "_kn", "_s", "_cut", "_place", "_before")
    return df
