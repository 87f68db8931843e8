"""Spark session settings the engine expects, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every job relies on: UTC (zone-free timestamps are
# differenced through the session zone) and AQE for runtime re-planning
# (partition coalescing, skew-join splitting, broadcast only after a stage's
# real size is known).  Every cast names its timestamp type explicitly, so
# the session's default timestamp type is left as the user set it.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra) -> SparkSession:
    """Local/test session. On a cluster use the cluster's session instead and
    call ``configure(spark)``."""
    b = SparkSession.builder.appName("funnelkit")
    if master:
        b = b.master(master)
    conf = dict(ENGINE_CONF)
    conf.update(
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("FUNNELKIT_DRIVER_MEMORY", "16g"),
        }
    )
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in ENGINE_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset in local mode (local runs
    and tests) is a fresh scratch folder set.  On a cluster the setting must
    name shared storage, and an unset one is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is invisible to other executors
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        d = tempfile.mkdtemp(prefix="funnelkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def run_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables in the shared folder;
    it is removed when the application ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/funnelkit-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, removed when the
    application ends."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and
    every reader after it sees the same rows even if executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run, from the input size and the core count.

    Shuffle partitions are sized so one partition holds about
    ``target_partition_bytes`` of the largest shuffle (the event stream keyed
    by expert, roughly the size of its projected columns), rounded up to a
    multiple of the cores so waves are full; AQE then coalesces small ones
    and splits skewed ones.  Scans read ``target_partition_bytes`` per task.
    """
    parts = max(cores, -(-input_bytes // target_partition_bytes))
    parts = -(-parts // cores) * cores
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        # broadcast only what AQE measured small at runtime
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }
