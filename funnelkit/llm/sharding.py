"""Two-pass external shuffle into shards, with DataFrame operations alone.

Pass one scatters records into memory-sized buckets by a seeded hash, shuffles
each bucket (Spark's ``shuffle`` is a Fisher-Yates pass over an array) and
writes it.  Pass two reads the bucket sizes back, which place every bucket in
its shard.  The stored files are what decides: a lost task is run again and
committed once, and every reader after that sees one order.

Shards follow the ``key`` law: doc_id and the number of shards decide alone,
by the largest of one seeded hash per shard (rendezvous hashing), so one more
shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import scratch, text_of
from funnelkit.llm.native import let

#: mean bytes of text in a bucket
BUCKET_BYTES = 8 << 20
#: buckets up to which their places (two numbers each) are broadcast
BROADCAST_BUCKETS = 1 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard (0-based) whose seeded hash of the key is largest."""
    draws = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["s"]


def write_shards(docs: DataFrame, path: str, *, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shuffle all rows into ``shards`` folders under ``path``.

    Returns what was written: shard, bucket, place (0-based in the bucket),
    size, grown_shard, record (the whole input row, so that no column name
    can clash) and slot, gapless from 0 in each shard.

    A null text has size 1 and a null doc_id hashes as any other key.
    Repeated rows stay separate: the bucket's hash also takes the row's
    place in the input, so one key with a third of all rows fills its shard
    but no single bucket.  ``docs`` should be a scan or a stored table (its
    row places must not change when a task runs again).  An empty table
    writes nothing and returns no rows.
    """
    spark = docs.sparkSession
    size = (F.octet_length(text_of(docs)) + 1).cast("long")
    total = docs.select(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    key, text = docs["doc_id"], text_of(docs)
    rows = docs.select(
        shard_of(key, shards, seed).alias("shard"),
        F.xxhash64(key, text, F.lit(seed), F.monotonically_increasing_id()).alias("hash"),
        size.alias("size"),
        shard_of(key, shards + 1, seed).alias("grown_shard"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record"),
    ).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))

    def in_order(r: Column) -> Column:
        """A bucket's rows by their hash, whatever order they arrived in."""
        places = F.array_sort(F.transform(r, lambda x, i: F.struct(x["hash"].alias("h"), i.alias("i"))))
        return F.transform(places, lambda p: F.get(r, p["i"]))

    # every bucket in one place before its array is built: no partial arrays
    # are made on the map side
    shuffled = (
        rows.repartition("shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.collect_list(F.struct("hash", "size", "grown_shard", "record")).alias("rows"))
        # a task draws for its buckets one after the other: in a fixed order
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", F.posexplode(F.shuffle(let(F.col("rows"), in_order), F.lit(seed))).alias("place", "row"))
        .select("shard", "bucket", "place", "row.size", "row.grown_shard", "row.record")
    )
    shuffled.write.partitionBy("shard").parquet(path)
    written = spark.read.schema(shuffled.schema).parquet(path)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = written.groupBy("shard", "bucket").count().select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("bucket_start"))
    if shards * buckets <= BROADCAST_BUCKETS:
        places = F.broadcast(places)
    return written.join(places, ["shard", "bucket"]).withColumn(
        "slot", (F.col("bucket_start") + F.col("place")).cast("long")).drop("bucket_start")


def op7(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """The digest of the written shards (see the query's contract)."""
    out = write_shards(docs, scratch(docs.sparkSession, "shards"), shards=shards, seed=seed)
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        "size",
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
