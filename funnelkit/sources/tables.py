"""Tables that are replaced as a whole.

A table is a folder of versions and a pointer, a small file that names the
version in force.  A write makes a new version and moves the pointer last, by a
rename that replaces: readers see the old table or the new one, and a write
that dies half-way leaves the old one.  Folders begin with an underscore, so
that nothing takes several versions for one table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file context for a path, and the path's Java class."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version in force, None if there is no table."""
    jvm, fs, _ = _fs(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}")
    if not fs.exists(pointer):
        return None
    source = fs.open(pointer)
    try:
        name = bytes(source.readAllBytes()).decode()
    finally:
        source.close()
    return f"{path}/{name}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    jvm, fs, context = _fs(spark, path)
    new, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"{_POINTER}-{name}", _POINTER))
    out = fs.create(new, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, pointer, rename)


def write_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Replace the table at ``path`` by ``df``, which may read that table.

    The last ``keep`` versions stay, for readers that resolved the pointer
    before the write; older ones are removed.
    """
    spark = df.sparkSession
    before = current_version(spark, path)
    name = f"_v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{name}")
    _point(spark, path, name)
    jvm, fs, _ = _fs(spark, path)
    versions = [s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if s.isDirectory() and s.getPath().getName().startswith("_v-")]
    kept = {name, before.rsplit("/", 1)[1] if before else name}
    for old in sorted(versions, key=lambda s: -s.getModificationTime())[max(1, keep):]:
        if old.getPath().getName() not in kept:
            fs.delete(old.getPath(), True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version in force; what is read does not change if it is replaced."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(version)
