"""Shared helpers: stored intermediates and columns that clash with no input."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.session import scratch, stored  # noqa: F401


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it;
    on a cluster that installs the package (or gets --py-files) it adds nothing."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (own := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, own)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> F.Column:
    """The text column by exact name, null read as empty."""
    return F.coalesce(df[f"`{column}`"].cast("string"), F.lit(""))


def held_out(doc_id: F.Column) -> F.Column:
    """The evaluation fold: crc32 of the id as text, remainder 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
