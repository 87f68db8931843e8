"""Mixing sources to target weights by blocks of words.

1. Every source's documents, in the order of the scan, are one long row of
   words cut into blocks of ``block_words``.
2. Targets: a share by weight of all words, at most ``cap`` times the source;
   what is cut off is shared again by weight.
3. The output has so many blocks of each source (its quota, exact), dealt over
   shards: every shard's counts are a multinomial draw given the quotas, made
   by halving the range of shards again and again, so a task finds its own
   shard's counts without the others'.
4. The j-th block that a shard takes of a source is the block at place j of a
   pseudorandom permutation of the source's block numbers (one per epoch).
5. The permutations are turned round where the documents are read: a block
   tells its places in the mix, so its words go to their shards at once, by the
   one shuffle that texts take part in, and the shards are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, floor, lgamma, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import scratch, stored, text_of
from funnelkit.llm.native import word_array

BLOCK_WORDS = 16
SHARD_SLOTS = 1 << 16
#: running sums inside a source are cut into so many hash buckets
BUCKETS = 1024
#: the plan of a mix has a row per source on the driver; more are refused
MAX_SOURCES = 1_000_000
#: (scan partition, source) pairs whose starts are sent to the tasks
MAX_STARTS = 5_000_000


@dataclass
class Plan:
    source: list[str | None]
    size: np.ndarray     # words
    target: np.ndarray   # words wanted
    blocks: np.ndarray   # blocks it has
    quota: np.ndarray    # blocks the mix takes, repeats counted


def targets(size: np.ndarray, weight: np.ndarray, cap: float = 3.0) -> np.ndarray:
    """Shares of ``size.sum()`` by weight, at most cap times each size; the
    excess goes to the others by weight until none is above its cap."""
    size, weight = size.astype(float), weight.astype(float)
    out, free, left = np.zeros(len(size)), np.ones(len(size), dtype=bool), size.sum()
    while free.any():
        share = left * weight / weight[free].sum()
        over = free & (share >= cap * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap * size[over]
        left -= out[over].sum()
        free &= ~over
    return out


def make_plan(rows: list, weights: tuple[float, ...], cap: float, block_words: int) -> Plan:
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    size = np.array([r["size"] for r in rows], dtype=np.int64)
    want = targets(size, np.array([weights[k % len(weights)] for k in range(len(rows))]), cap)
    blocks = -(-size // block_words)
    quota = np.rint(want * blocks / np.maximum(size, 1)).astype(np.int64)
    return Plan([r["source"] for r in rows], size, want, blocks, np.minimum(quota, (cap * blocks).astype(np.int64)))


def _rise(a: int, k: int) -> float:
    """log((a + k)! / a!), without taking the difference of large logarithms."""
    x, y = a + 1, a + 1 + k
    if min(x, y) < 16:
        return lgamma(y) - lgamma(x)
    return (x - 0.5) * log1p(k / x) + k * log(y) - k + (1 / y - 1 / x) / 12 - (1 / y**3 - 1 / x**3) / 360


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """Good ones among ``take`` drawn without replacement, for any size:
    rejection from a hat around the mode (ratio of uniforms), or inversion
    where the result has few values."""
    total = good + bad
    low, high = max(0, take - bad), min(good, take)
    if low >= high:
        return low
    mode = (take + 1) * (good + 1) // (total + 2)

    def log_weight(z: int) -> float:
        """Of z against the mode: the four factorials that z is in."""
        k = z - mode
        return -_rise(mode, k) - _rise(good - mode, -k) - _rise(take - mode, -k) - _rise(bad - take + mode, k)

    if high - low <= 64:
        weight = np.cumsum([exp(log_weight(z)) for z in range(low, high + 1)])
        return low + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))
    mean = take * (good / total)
    spread = sqrt((total - take) * mean / total * (bad / (total - 1)) + 0.5)
    hat = 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = 1 - rng.random(), rng.random()
        z = floor(mean + 0.5 + hat * (v - 0.5) / u)
        if low <= z <= high and 2 * log(u) <= log_weight(z):
            return z


def split(quota: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` slots go to each source: drawn without replacement
    from the quotas, one source after the other."""
    out, rest = np.zeros_like(quota), int(quota.sum())
    for s in np.flatnonzero(quota).tolist():
        rest -= int(quota[s])
        out[s] = hypergeometric(int(quota[s]), rest, take, rng)
        take -= int(out[s])
    return out


def shard_counts(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, count) of each source in one shard of the mix."""
    lo, hi, first, total = 0, shards, np.zeros_like(quota), int(quota.sum())
    edge = lambda k: total * k // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(quota, edge(mid) - edge(lo), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            quota, hi = left, mid
        else:
            quota, first, lo = quota - left, first + left, mid
    return first, quota


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v * np.uint64(0x9E3779B97F4A7C15)
    v = v ^ (v >> np.uint64(29))
    return v * np.uint64(0xBF58476D1CE4E5B9)


def _walked(place: np.ndarray, n: np.ndarray | int, keys: list[np.ndarray], back: bool) -> np.ndarray:
    """Each place through a Feistel network with a round for each of ``keys``
    (one key for all places or one a place), walked until below ``n``."""
    half = np.uint64(max(1, (int(np.max(n) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    n = np.broadcast_to(np.asarray(n, dtype=np.uint64), place.shape)
    keys = [np.broadcast_to(k, place.shape) for k in keys]
    out = place.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ ((_mixed(left + k[todo]) >> np.uint64(32)) & mask), left
            else:
                left, right = right, left ^ ((_mixed(right + k[todo]) >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def permuted(place: np.ndarray, n: int, key: tuple[int, ...], back: bool = False) -> np.ndarray:
    """Places 0 .. n-1 through a keyed permutation, or ``back`` through it: a
    four-round Feistel network over the next even number of bits, walked until
    inside."""
    if not len(place):
        return place.astype(np.int64)
    return _walked(place, n, list(np.random.default_rng(key).integers(1, 1 << 63, 4, dtype=np.uint64)), back)


def slot_of(item: np.ndarray, shard: np.ndarray, total: int, shards: int, seed: int) -> np.ndarray:
    """The slot of a shard's items (source by source): a permutation of each
    shard's own, for many shards at once."""
    if not len(item):
        return item.astype(np.int64)
    edge = lambda k: np.array([total * int(x) // shards for x in k], dtype=np.int64)
    which, back = np.unique(shard, return_inverse=True)
    n = (edge(which + 1) - edge(which))[back]
    base = _mixed(_mixed(shard.astype(np.uint64) + np.uint64(1)) + np.uint64(seed % (1 << 64)))
    return _walked(item, n, [_mixed(base + np.uint64(r)) for r in range(1, 5)], False)


def slots(spark: SparkSession, plan: Plan, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of the mix: shard, slot, src (place in the plan), block."""
    shards = max(1, -(-int(plan.quota.sum()) // shard_slots))
    quota, blocks = plan.quota, plan.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (s for b in batches for s in b.column(0).to_pylist()):
            first, count = shard_counts(quota, shards, shard, seed)
            src = np.repeat(np.arange(len(count)), count)
            block = np.zeros(len(src), dtype=np.int64)
            at = 0
            for s in np.flatnonzero(count):
                j = first[s] + np.arange(count[s])
                for epoch in np.unique(j // blocks[s]):
                    mine = j // blocks[s] == epoch
                    block[at : at + count[s]][mine] = permuted(j[mine] % blocks[s], int(blocks[s]), (seed, 1, int(s), int(epoch)))
                at += count[s]
            place = slot_of(np.arange(len(src)), np.full(len(src), shard), int(quota.sum()), shards, seed)
            order = np.empty(len(src), dtype=np.int64)
            order[place] = np.arange(len(src))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(src), shard)), pa.array(np.arange(len(src))), pa.array(src[order].astype(np.int32)), pa.array(block[order])],
                names=["shard", "slot", "src", "block"])

    if not int(plan.quota.sum()):
        return spark.createDataFrame([], "shard long, slot long, src int, block long")
    return spark.range(0, shards, 1, min(shards, max(1, shards // 4, spark.sparkContext.defaultParallelism))).mapInArrow(
        run, "shard long, slot long, src int, block long")


def packed(docs: DataFrame, weights: tuple[float, ...], cap: float, block_words: int, seed: int) -> tuple[DataFrame, Plan]:
    """Sizes and places: row (the row's place in ``docs``), doc_id, source, same
    (hash of the row's text), size, src, start (words of the source before it),
    stored in the shared folder.

    Places are running sums over (source, hash bucket) and inside each of
    them, so a source with a third of all rows is spread over ``BUCKETS``.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.xxhash64(text).alias("same"), F.size(word_array(text)).cast("long").alias("size")), "mix-sizes")
    in_bucket = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "same", F.lit(seed)), F.lit(BUCKETS)))
    by_bucket = in_bucket.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sources = by_bucket.groupBy("source").agg(F.sum("n").alias("size"))
    found = sources.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = make_plan([r.asDict() for r in found], weights, cap, block_words)
    names = spark.createDataFrame(list(zip(range(len(found)), plan.source, strict=True)), "src int, source string")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "same", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = in_bucket.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("a").join(
        starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
    placed = placed.select("a.row", "a.doc_id", "a.source", "a.same", "a.size", (F.col("bucket_start") + F.col("in_bucket")).alias("start")).alias("p")
    named = placed.join(names.alias("n"), F.col("p.source").eqNullSafe(F.col("n.source"))).select("p.*", "n.src")
    return stored(named, "mix-places"), plan


def block_times(spark: SparkSession, plan: Plan, seed: int) -> DataFrame:
    """(src, block, times): how often the mix takes each block it takes.
    Stored, so that joins are planned by its real size."""
    return stored(slots(spark, plan, seed).groupBy("src", "block").agg(F.count("*").alias("times")), "mix-times")


_MIX = "shard long, slot long, at long, source string, doc_id long, row long, first long, n_words long, text string"


def _numbers(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of integers on the driver."""
    found = df.toArrow()
    return [c.to_numpy() for c in found.columns]


def in_scan_order(docs: DataFrame, weights: tuple[float, ...], cap: float, block_words: int) -> tuple[DataFrame, DataFrame, Plan]:
    """Places as ``packed`` gives them, a source's documents in the order of the
    scan, and (part, src, start): where each partition of the scan begins in
    the sources it holds.  Stored in the shared folder."""
    spark = docs.sparkSession
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.size(word_array(text_of(docs))).cast("long").alias("size")), "mix-sizes")
    in_part = rows.withColumn("part", F.shiftright("row", 33))
    by_part = in_part.groupBy("source", "part").agg(F.sum("size").alias("n"))
    found = by_part.groupBy("source").agg(F.sum("n").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = make_plan([r.asDict() for r in found], weights, cap, block_words)
    names = spark.createDataFrame(list(zip(range(len(found)), plan.source, strict=True)), "src int, source string").alias("n")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).alias("b")
    starts = stored(starts.join(names, F.col("b.source").eqNullSafe(F.col("n.source"))).select("b.*", "src"), "mix-starts")
    inside = Window.partitionBy("source", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = in_part.withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("a").join(
        starts.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a.part") == F.col("s.part")))
    places = placed.select("a.row", "a.doc_id", "a.source", "a.size", "s.src", (F.col("s.start") + F.col("in_part")).alias("start"))
    return stored(places, "mix-places"), starts.select("part", "src", "start"), plan


def _shares(spark: SparkSession, plan: Plan, shards: int, seed: int) -> list[np.ndarray]:
    """(src, first, shard, item) by source and first place: which places of a
    source a shard takes, and the number of the first of them in the shard."""
    quota = plan.quota

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (s for b in batches for s in b.column(0).to_pylist()):
            first, count = shard_counts(quota, shards, shard, seed)
            has = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (has, first[has], np.full(len(has), shard), (np.cumsum(count) - count)[has])], names=["src", "first", "shard", "item"])

    tasks = min(shards, max(1, shards // 4, spark.sparkContext.defaultParallelism))
    found = _numbers(spark.range(0, shards, 1, tasks).mapInArrow(run, "src long, first long, shard long, item long"))
    order = np.lexsort((found[1], found[0]))
    return [x[order] for x in found]


def _pieces(plan: Plan, shares, starts, shards: int, shard_slots: int, block_words: int, seed: int):
    """Cuts documents (row, doc_id, source, text, and start if it is known) into
    the pieces that the mix takes: place, span, src, doc_id, row, text."""
    total, wide = int(plan.quota.sum()), block_words + 1

    def takes(src: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``block``, place in the mix) of every take."""
        at, src_of, first_of, shard_of, item_of = [], *shares.value
        places = []
        for s in np.unique(src).tolist():
            mine, n, quota = np.flatnonzero(src == s), int(plan.blocks[s]), int(plan.quota[s])
            lo, hi = np.searchsorted(src_of, [s, s + 1])
            for epoch in range(-(-quota // n)):
                j = epoch * n + permuted(block[mine], n, (seed, 1, s, epoch), back=True)
                has = j < quota
                k = lo + np.searchsorted(first_of[lo:hi], j[has], "right") - 1
                shard = shard_of[k]
                places.append(shard * shard_slots + slot_of(item_of[k] + j[has] - first_of[k], shard, total, shards, seed))
                at.append(mine[has])
        return (np.concatenate(at), np.concatenate(places)) if at else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {name: k for k, name in enumerate(plan.source)}
        following, here = {}, None
        for big in batches:
            for k in range(0, big.num_rows, 1_000):
                batch = big.slice(k, 1_000)
                row, doc_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "doc_id_or_0"))
                src = np.array([names[x] for x in batch.column("source").to_pylist()], dtype=np.int64)
                known = batch.column("start").to_numpy() if starts is None else None
                if len(row) and known is None and int(row[0] >> 33) != here:
                    here = int(row[0] >> 33)
                    lo, hi = np.searchsorted(starts.value[0], [here, here + 1])
                    following = dict(zip(starts.value[1][lo:hi].tolist(), starts.value[2][lo:hi].tolist(), strict=True))
                doc, block, at, first, size, text = [], [], [], [], [], []
                for d, (s, x) in enumerate(zip(src.tolist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)):
                    words = x.split()  # at the white space of ASCII
                    start = int(known[d]) if known is not None else following[s]
                    end = start + len(words)
                    following[s] = end
                    for b in range(start // block_words, -(-end // block_words) if words else 0):
                        lo = max(b * block_words, start)
                        hi = min((b + 1) * block_words, end)
                        doc.append(d)
                        block.append(b)
                        at.append(lo - b * block_words)
                        first.append(lo - start)
                        size.append(hi - lo)
                        text.append(b" ".join(words[lo - start : hi - start]))
                doc = np.array(doc, dtype=np.int64)
                index, place = takes(src[doc], np.array(block, dtype=np.int64))
                span = (np.array(first, dtype=np.int64) * wide + np.array(at, dtype=np.int64)) * wide + np.array(size, dtype=np.int64)
                no_id = batch.column("no_id").to_numpy(zero_copy_only=False)
                for lo in range(0, len(index), 50_000):
                    i = index[lo : lo + 50_000]
                    d = doc[i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place[lo : lo + 50_000]), pa.array(span[i]), pa.array(src[d].astype(np.int32)), pa.array(doc_id[d], mask=no_id[d]), pa.array(row[d]),
                         pa.array([text[x] for x in i.tolist()], pa.binary()).view(pa.string())],
                        names=["place", "span", "src", "doc_id", "row", "text"])

    return run


def write_mix(docs: DataFrame, path: str, *, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, block_words: int = BLOCK_WORDS, seed: int = 5,
              shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, Plan]:
    """Write the mix at ``path`` and return the documents' places and the plan.

    A row of the mix is a piece of a slot's block: shard, slot, at (the words
    of the block before it), source, doc_id, row (the document's place in
    ``docs``), first (the piece's first word in the document), n_words and text
    (those words, one space between).  A shard lies in one part of the output,
    in slot order.  ``docs`` should be a scan or a stored table: it is read
    twice, in the same order.

    Documents are cut where they are read, for the tasks know where their part
    of the scan begins in each source and which places each shard takes of it:
    texts are shuffled once, by shard.
    """
    spark = docs.sparkSession
    places, starts, plan = in_scan_order(docs, weights, cap, block_words)
    total = int(plan.quota.sum())
    if not total:
        spark.createDataFrame([], _MIX).write.parquet(path)
        return places, plan
    shards = max(1, -(-total // shard_slots))
    shares = spark.sparkContext.broadcast(_shares(spark, plan, shards, seed))
    doc_id = docs["doc_id"].cast("long")
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(doc_id, F.lit(0)).alias("doc_id_or_0"), doc_id.isNull().alias("no_id"),
                       docs["source"].cast("string").alias("source"), text_of(docs).alias("text"))
    known = None
    if starts.count() <= MAX_STARTS:
        part, src, start = _numbers(starts)
        order = np.argsort(part, kind="stable")
        known = spark.sparkContext.broadcast([part[order], src[order], start[order]])
    else:  # too many to send to every task: each document gets its own
        text = text.join(places.select("row", "start").hint("merge"), "row")
    taken = text.mapInArrow(_pieces(plan, shares, known, shards, shard_slots, block_words, seed), "place long, span long, src int, doc_id long, row long, text string")
    wide = block_words + 1
    over = F.expr(f"span div {wide}")
    names = spark.createDataFrame(list(zip(range(len(plan.source)), plan.source, strict=True)), "src int, source string")
    dealt = taken.repartition(shards, F.expr(f"place div {shard_slots}")).join(F.broadcast(names), "src")
    out = dealt.select(
        F.expr(f"place div {shard_slots}").alias("shard"), (F.col("place") % shard_slots).alias("slot"), (over % wide).alias("at"), "source", "doc_id", "row",
        F.expr(f"span div {wide * wide}").alias("first"), (F.col("span") % wide).alias("n_words"), "text").sortWithinPartitions("shard", "slot", "at")
    out.write.option("compression", "zstd").parquet(path)
    return places, plan


def read_mix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MIX).parquet(path)


def op5(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, block_words: int = BLOCK_WORDS, seed: int = 5) -> DataFrame:
    """Write the mix to the shared folder and return what it took of every
    document, counted from the shards (see the query's contract).

    A null or empty text has size 0 and nothing is taken of it; a null source
    is a source of its own, last in order; repeated rows are documents of
    their own; a very long text is many blocks; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "mix")
    places, plan = write_mix(docs, path, weights=weights, cap=cap, block_words=block_words, seed=seed)
    taken = read_mix(spark, path).groupBy("row").agg(F.sum("n_words").alias("taken"))
    of = spark.createDataFrame(
        [(k, int(plan.size[k]), float(plan.target[k])) for k in range(len(plan.source))], "src int, source_size long, target double")
    out = places.join(taken, "row", "left").join(of, "src")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, block_words: int = BLOCK_WORDS, seed: int = 5) -> DataFrame:
    """The mix as whole documents: a document is taken as often as the block
    that holds its first word (0 to ``cap`` times), with all its columns.

    Rows alike in id, source and text share their takes evenly, the rest by a
    hash of the row's place, so ``docs`` should be a scan or a stored table.
    A document without words goes with the block at its place.
    """
    spark = docs.sparkSession
    places, plan = packed(docs, weights, cap, block_words, seed)
    times = block_times(spark, plan, seed)
    last = spark.createDataFrame([(k, int(max(n - 1, 0))) for k, n in enumerate(plan.blocks)], "src int, last long")
    first = places.join(last, "src").withColumn("block", F.least(F.floor(F.col("start") / block_words), F.col("last")))
    alike = first.join(times, ["src", "block"], "left").groupBy("doc_id", "source", "same").agg(
        F.sum(F.coalesce("times", F.lit(0))).alias("times"), F.count("*").alias("rows"))
    text = text_of(docs)
    keyed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record"), docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"), F.xxhash64(text).alias("same"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 20)).alias("luck")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.same") == F.col("a.same"))
    even = F.floor(F.col("a.times") / F.col("a.rows"))
    extra = F.when(F.col("luck") < (F.col("a.times") - even * F.col("a.rows")) / F.col("a.rows") * (1 << 20), 1).otherwise(0)
    return keyed.join(alike.alias("a"), on).select("record", (even + extra).alias("take")).where("take > 0").select(
        "record", F.explode(F.sequence(F.lit(1), F.col("take").cast("int")))).select("record.*")
