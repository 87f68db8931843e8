"""Near-duplicate classes by the Jaccard similarity of word shingles.

Exact for the threshold, by PartEnum signatures:

1. *Profiles.*  One pass makes each document's set of shingle hashes; it keeps
   a fingerprint, the size and the hashes of an eighth of the feature domain.
   Documents with equal sets are one *node* from here on.
2. *Sieve.*  A linked set shares three quarters of its features with one other
   set.  A node is left out if too few of its features in that eighth occur in
   any other node (too few: beyond a binomial bound that a linked set passes
   with probability 1e-9 at most).  Small sets always stay.
3. *Signatures.*  Sizes are cut into bands so that linked sets lie in one band
   or two neighbours; a *tag* is a band with the next one.  Linked sets of a tag
   differ in at most k features.  The feature domain is cut into n1 groups of
   n2 parts; in n1 - k // (k2 + 1) groups they differ in k2 parts at most and
   agree on some n2 - k2 of them.  Every subset of n2 - k2 parts gives one
   signature: the hash of the set's features there.
   An empty agreement says nothing, so n1 has groups to spare: a set with at
   most that many groups with an empty subset is *safe* and its empty
   signatures are not emitted, since each of its links shows in a non-empty
   one.  Other sets emit again over another partition; on the last, empty
   subsets too.
   A set of e signatures differs from a partner of its own size range in so
   few features that they share at least t of them.  So signatures are put in
   one order, the widest-shared last, and every set drops its last t - 1 (all,
   if it has fewer than t that anyone shares): two linked sets still meet.
   A passage that many documents share thus makes no pairs of them.
4. *Links.*  Sets that share a signature are compared in full: first, in a few
   rounds, each with one centre outside its component (the signature group's
   node with the widest signatures, which of a group of near copies is their
   origin).  What is still in different components is compared in blocks: nodes
   of one centre are cut into blocks of bounded size, every two blocks that
   meet in a signature go to one task, which multiplies their incidence
   matrices and returns only links that join components.  So neither a group
   of near copies nor one of just too different texts is expanded into pairs.
5. *Components* of the links, by star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import stored, text_of
from funnelkit.llm.components import components
from funnelkit.llm.words import chunks, mix, spans, words

SHINGLE = 5
#: one feature in so many is used by the sieve
SIEVE = 8
RISK = 1e-9
LEVELS = 4
CENTRE_ROUNDS = 2
#: nodes, and features, of a block
BLOCK_NODES = 128
BLOCK_FEATURES = 1 << 17

_STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


# ------------------------------------------------------------------- the sets

def shingle_sets(texts: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets): each text's distinct shingle hashes, ascending.

    Fewer words than ``length``: the whole sequence is one shingle; no word:
    the empty set.
    """
    w = words(texts)
    count = np.diff(w.first)
    made = np.where(count >= length, count - length + 1, np.minimum(count, 1))
    at = spans(w.first[:-1], made)
    row = np.repeat(np.arange(len(made)), made)
    size = np.minimum(count, length)[row]
    h = size.astype(np.uint64)
    for k in range(length):
        here = k < size
        h[here] += w.hash[at[here] + k] * _STEP[k % SHINGLE] + np.uint64(k)
    h = mix(h)
    bits = max(1, int(len(made)).bit_length())
    order = np.argsort((row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)), kind="stable")
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(made) + 1))


def fingerprints(features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, as signed numbers."""
    size = np.diff(offsets)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(features ^ np.uint64(0x5851F42D4C957F2D)))])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64)).view(np.int64)


# ------------------------------------------------------------------ the sieve

@lru_cache(maxsize=100_000)
def _most(n: int, share: float) -> int:
    """The least t with P(Binomial(n, share) > t) <= RISK."""
    if n == 0:
        return 0
    t, above = n, 0.0
    while t > 0:
        above += math.exp(math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(n - t + 1) + t * math.log(share) + (n - t) * math.log1p(-share))
        if above > RISK:
            break
        t -= 1
    return t


def _profile(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names, texts, sizes, prints, samples = [], [], [], [], []
        for batch in chunks(batches, "text"):
            features, offsets = shingle_sets(batch.column(1))
            names += batch.column(0).to_pylist()
            texts.append(np.asarray(batch.column(2)))
            sizes.append(np.diff(offsets))
            prints.append(fingerprints(features, offsets))
            kept = (features >> np.uint64(40)) % np.uint64(SIEVE) == 0
            upto = np.concatenate([[0], np.cumsum(kept)])
            samples.append((features[kept], np.diff(upto[offsets])))
        if not names:
            return
        size, name, same = np.concatenate(sizes), np.concatenate(prints), np.concatenate(texts)
        _, first = np.unique(name, return_index=True)
        own = np.zeros(len(name), dtype=bool)
        own[first] = True
        own &= size > 0
        counts = np.concatenate([c for _, c in samples])
        feature = np.concatenate([f for f, _ in samples])
        node = np.repeat(np.arange(len(name)), counts)
        feature, node = feature[own[node]], node[own[node]]
        # features that two nodes of this task have are settled here
        order = np.argsort(feature, kind="stable")
        f, start = np.unique(feature[order], return_index=True)
        times = np.diff(np.append(start, len(feature)))
        shared = np.zeros(len(feature), dtype=bool)
        shared[order] = np.repeat(times > 1, times)
        credit = np.bincount(node[shared], minlength=len(name))
        open_, of = feature[~shared].view(np.int64), node[~shared]
        ends = np.searchsorted(of, np.arange(len(name) + 1))
        need = np.zeros(len(name), dtype=np.int64)
        for k in np.flatnonzero(own):
            need[k] = max(0, counts[k] - _most(int(size[k] * (100 - percent) // 100), 1 / SIEVE))
        for a in range(0, len(name), 4096):
            b = min(a + 4096, len(name))
            lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(open_[ends[a] : ends[b]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[a:b], pa.int64()), pa.array(same[a:b]), pa.array(size[a:b]), pa.array(name[a:b]), pa.array(np.full(b - a, task)), pa.array(own[a:b]),
                 pa.array(need[a:b]), pa.array(credit[a:b]), lists], names=_PROFILE_NAMES)
        # a settled feature goes on with two of its nodes, for other tasks
        twice = times > 1
        for pick in (start[twice], (start + times - 1)[twice]):
            marks = name[node[order[pick]]]
            for a in range(0, len(marks), 1 << 16):
                part = slice(a, a + (1 << 16))
                k = len(marks[part])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(f[twice][part].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.full(k, -1)), pa.array(marks[part]), pa.array(np.full(k, -1)), pa.array(np.zeros(k, dtype=bool)),
                     pa.array(np.zeros(k, dtype=np.int64)), pa.array(np.zeros(k, dtype=np.int64)), lists], names=_PROFILE_NAMES)

    return run


_PROFILE_NAMES = ["doc_id", "same", "n", "node", "task", "own", "need", "credit", "open"]
_PROFILE = "doc_id long, same long, n long, node long, task long, own boolean, need long, credit long, open array<long>"


def _survivors(profiles: DataFrame) -> DataFrame:
    """(node, doc_id, same) of the nodes that may have a link: enough of their
    sampled features lie in another node too."""
    rows = profiles.where("own or task = -1").select(F.explode("open").alias("feature"), "node", "task")
    flat = rows.groupBy("feature").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("feature")
    owned = rows.where("task >= 0").join(flat, "feature", "left_semi").groupBy("node", "task").agg(F.count("*").alias("k"))
    nodes = profiles.where("own").select("node", "task", "need", "credit", "doc_id", "same")
    passed = nodes.join(owned, ["node", "task"], "left").where(F.col("credit") + F.coalesce("k", F.lit(0)) >= F.col("need"))
    return passed.groupBy("node").agg(F.min(F.struct("doc_id", "same")).alias("r")).select("node", "r.*")


def _texts_of(passed: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text): each node meets its own row's text, not all of its id."""
    row = F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.same") == F.col("t.same"))
    return passed.alias("p").join(texts.alias("t"), row).select("p.node", "t.text")


# ------------------------------------------------------------- the signatures

@lru_cache(maxsize=None)
def bands(percent: int) -> list[tuple[int, int]]:
    """Size bands (least, most): a linked set lies in the same or next one."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = lo * 100 // percent
        out.append((lo, hi))
        lo = hi + 1
    return out


@lru_cache(maxsize=None)
def scheme(tag: int, percent: int) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) of a tag: its linked sets differ in k features at most."""
    lo, hi = bands(percent)[tag]
    k = (hi + hi * 100 // percent) * (100 - percent) // (100 + percent)
    if k <= 3:
        return k, 1, {0: 1, 1: 3, 2: 4, 3: 5}[k], k
    k2, n2 = (1, 3) if k <= 12 else (0, 1)
    must = k // (k2 + 1) + 1
    n1 = must
    while True:  # groups to spare for those with an empty subset
        empty = math.comb(n2, k2) * math.exp(-0.85 * lo / (n1 * n2) * (n2 - k2))
        if n1 * (1 - min(1, empty)) - 2 * math.sqrt(n1 * empty) >= must or n1 > 4 * must:
            return k, n1, n2, k2
        n1 += max(1, n1 // 50)


def signatures(features: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, use) of every signature that the sets emit.

    ``use`` names the tag and partition, times 2**16, plus the least number of
    these signatures that the set shares with any linked partner (at least 1).
    """
    size = np.diff(offsets)
    edges = np.array([hi for _, hi in bands(percent)])
    band = np.searchsorted(edges, size)
    out_sig, out_set, out_use = [], [], []
    for tag in np.unique(np.concatenate([band, band - 1])):
        if tag < 0:
            continue
        k, n1, n2, k2 = scheme(int(tag), percent)
        if not k:
            continue  # linked sets of this tag are equal
        spare = n1 - k // (k2 + 1) - 1
        todo = np.flatnonzero(((band == tag) | (band == tag + 1)) & (size > 0))
        for level in range(LEVELS):
            if not len(todo):
                break
            last = level == LEVELS - 1
            own = spans(offsets[todo], size[todo])
            f, who = features[own], np.repeat(np.arange(len(todo)), size[todo])
            salt = mix(np.array([tag * 64 + level + 1], dtype=np.uint64))[0]
            g = mix(f ^ salt)
            part = ((g >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)
            cell = who * (n1 * n2) + part.astype(np.int64)
            count = np.bincount(cell, minlength=len(todo) * n1 * n2).reshape(len(todo), n1, n2)
            total = np.zeros(len(todo) * n1 * n2, dtype=np.uint64)
            np.add.at(total, cell, mix(g + np.uint64(0x2545F4914F6CDD1D)))
            total = total.reshape(len(todo), n1, n2)
            bad = np.zeros((len(todo), n1), dtype=bool)
            made = []
            for number, subset in enumerate(combinations(range(n2), n2 - k2)):
                filled = count[:, :, subset].sum(axis=2) > 0
                bad |= ~filled
                s = np.zeros((len(todo), n1), dtype=np.uint64)
                for j in subset:
                    s = mix(s + total[:, :, j] + np.uint64(j + 1))
                s = mix(s + salt + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64)) + np.arange(n1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
                made.append((s, filled))
            emitted = sum(filled.sum(axis=1) for _, filled in made)
            # the most features in which a partner of this tag can differ, and
            # the most signatures that they can spoil
            n = size[todo]
            partner = np.where(band[todo] == tag, n * 100 // percent, bands(percent)[tag][1])
            differ = (n + partner) * (100 - percent) // (100 + percent)
            spoiled = differ if not k2 else (n2 - k2) * np.minimum(differ, n1) + np.maximum(differ - n1, 0)
            shared = np.clip(emitted - spoiled, 1, 65535) if n1 > 1 and not last else np.ones(len(todo), dtype=np.int64)
            use = (tag * LEVELS + level) * 65536 + shared
            for s, filled in made:
                who, _ = np.nonzero(filled | last)
                out_sig.append(s[filled | last])
                out_set.append(todo[who])
                out_use.append(use[who])
            todo = todo[bad.sum(axis=1) > spare]
    if not out_sig:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set), np.concatenate(out_use)


# --------------------------------------------------------------- Spark's part

def _sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            features, offsets = shingle_sets(batch.column(1))
            name = fingerprints(features, offsets)
            rows = np.flatnonzero(name == np.asarray(batch.column(0)))  # equal ids, other texts
            data = [features[offsets[r] : offsets[r + 1]].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[rows]), pa.array(np.diff(offsets)[rows]), pa.array(data, pa.binary())], names=["node", "n", "features"])

    return run


def _batch_sets(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    held = batch.column(column).cast(pa.large_binary())
    at = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    features = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return np.frombuffer(features.tobytes(), dtype=np.uint64), (at - at[0]) // 8


def _signature_groups(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, node, degree) of the signatures by which nodes may meet."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                features, offsets = _batch_sets(batch, 1)
                sig, who, use = signatures(features, offsets, percent)
                node = np.asarray(batch.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(node[who]), pa.array(use.astype(np.int32))], names=["sig", "node", "use"])

    rows = sets.select("node", "features").mapInArrow(emit, "sig long, node long, use int")
    rows = rows.withColumn("m", F.count("*").over(Window.partitionBy("sig"))).where("m > 1")
    widest = Window.partitionBy("node", "use").orderBy(F.desc("m"), F.desc("sig"))
    rows = rows.withColumn("place", F.row_number().over(widest)).withColumn("degree", F.sum("m").over(Window.partitionBy("node", "use")))
    return rows.where("place >= use % 65536").select("sig", "node", "degree")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose sets pass the threshold.

    ``u``'s set meets the sets of its ``v`` in one task; a ``u`` with very
    many is dealt over several, with a copy of its set for each.
    """
    some = pairs.groupBy("u").agg(F.count("*").alias("k")).select("u", F.ceil(F.col("k") / 64).cast("int").alias("salts"))
    left = sets.join(some, F.col("node") == F.col("u")).select(
        "u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "features")
    right = pairs.join(some, "u").join(sets, F.col("node") == F.col("v")).select(
        "u", F.pmod(F.xxhash64("v"), F.col("salts").cast("long")).cast("int").alias("salt"), "v", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, whose = None, None
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            features, offsets = _batch_sets(batch, 3)
            found = []
            for r, (u, v) in enumerate(zip(us, vs, strict=True)):
                own = features[offsets[r] : offsets[r + 1]]
                if v is None:
                    mine, whose = own, u
                elif whose == u:
                    both = int(np.isin(own, mine, assume_unique=True, kind="sort").sum())
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])

    rows = left.unionByName(right).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return rows.mapInArrow(run, "u long, v long")


def _join_blocks(a: list, b: list, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of (node, component, features), or inside one
    (b is a): a spanning forest of those that join components."""
    fa, fb = np.concatenate([x[2] for x in a]), np.concatenate([x[2] for x in b])
    common = np.intersect1d(fa, fb)

    def incidence(rows: list, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(common)), dtype=np.float32)
        at = np.searchsorted(common, f)
        hit = common[np.minimum(at, len(common) - 1)] == f
        out[np.repeat(np.arange(len(rows)), [len(x[2]) for x in rows])[hit], at[hit]] = 1
        return out

    if not len(common):
        return []
    both = incidence(a, fa) @ incidence(b, fb).T
    size = np.add.outer(np.array([len(x[2]) for x in a]), np.array([len(x[2]) for x in b]))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(100 * both >= percent * (size - both)), strict=True):
        p, q = root(a[i][1]), root(b[j][1])
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((a[i][0], b[j][0]))
    return out


def _block_links(named: DataFrame, family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between nodes of different components that share a
    signature."""
    sized = family.join(sets.select("node", "n"), "node")
    whole = sized.groupBy("family").agg(F.count("*").alias("nodes"), F.sum("n").alias("features"))
    cuts = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("features") / BLOCK_FEATURES))
    block = stored(sized.join(whole, "family").select("node", F.xxhash64("family", F.pmod(F.xxhash64("node"), cuts)).alias("block")), "blocks")
    met = named.join(block, "node").groupBy("sig", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = met.groupBy("sig").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("sig")
    met = stored(met.join(open_, "sig"), "block-groups")
    x, y = met.alias("x"), met.alias("y")
    apart = (F.col("x.lo") != F.col("y.hi")) | (F.col("x.hi") != F.col("y.lo"))
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.block") <= F.col("y.block")) & apart).select(
        F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct()
    pairs = stored(pairs, "block-pairs")
    of = named.select("node", "component").distinct()
    members = stored(block.join(of, "node").join(sets.select("node", "features"), "node"), "block-members")
    left = pairs.join(members, F.col("a") == F.col("block")).select("a", "b", F.lit(0).alias("side"), "node", "component", "features")
    right = pairs.where("a <> b").join(members, F.col("b") == F.col("block")).select("a", "b", F.lit(1).alias("side"), "node", "component", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def links() -> pa.RecordBatch:
            found = _join_blocks(held[0], held[1] if key[0] != key[1] else held[0], percent) if held[0] else []
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            features, offsets = _batch_sets(batch, 5)
            for r, (a, b, side, node, component) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if (a, b) != key:
                    if key:
                        yield links()
                    key, held = (a, b), ([], [])
                held[side].append((node, component, features[offsets[r] : offsets[r + 1]]))
        if key:
            yield links()

    return left.unionByName(right).repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "u long, v long")


def _named(sized: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The signature groups with each node's component so far."""
    if comp is None:
        return sized.withColumn("component", F.col("node"))
    return sized.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, node (of the shingle set), component
    (of the nodes) and same (hash of the text) of every row of ``docs``.

    Two documents link if 100 * intersection >= percent * union of their
    shingle sets.  component_id is the least doc_id reachable by links.

    A null or empty text, or one without words, has the empty set and is
    linked with nothing: its component is its own id.  Equal sets always link,
    repeated rows too.  A null doc_id is no component's name unless all of a
    component's ids are null.  An empty table gives no rows; other columns are
    not read.
    """
    text = text_of(docs)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    profiles = stored(texts.mapInArrow(_profile(percent), _PROFILE), "profiles")
    passed = stored(_survivors(profiles), "survivors")
    # the texts of the nodes that are left, once each
    sets = stored(_texts_of(passed, texts).mapInArrow(_sets(percent), "node long, n long, features binary").dropDuplicates(["node"]), "sets")
    sized = stored(_signature_groups(sets, percent).join(sets.select("node", "n"), "node"), "signature-groups")
    links, tried, comp = None, None, None
    for turn in range(CENTRE_ROUNDS):
        named = _named(sized, comp)
        rank = F.col("degree") if not turn else F.xxhash64("node", F.lit(turn))
        centre = named.groupBy("sig").agg(F.max(F.struct(rank.alias("rank"), "node", "component", "n")).alias("c"))
        met = named.join(centre, "sig").where(
            (F.col("component") != F.col("c.component")) & (100 * F.least("n", F.col("c.n")) >= percent * F.greatest("n", F.col("c.n"))))
        met = met.groupBy("node", F.col("c.node").alias("u")).agg(F.count("*").alias("k"))
        if tried is not None:
            met = met.join(tried.select(F.col("v").alias("node"), "u"), ["node", "u"], "left_anti")
        pairs = stored(met.groupBy("node").agg(F.max(F.struct("k", "u")).alias("b")).select(F.col("b.u").alias("u"), F.col("node").alias("v")), "centre-pairs")
        if not turn:
            # the centre of the centre's centre: few families for one crowd
            family = sized.select("node").distinct().withColumn("family", F.col("node"))
            for _ in range(3):
                family = family.join(pairs.select(F.col("v").alias("family"), "u"), "family", "left").select(
                    "node", F.coalesce("u", "family").alias("family"))
        found = _verified(pairs, sets, percent)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = stored(found if links is None else links.unionByName(found), "centre-links")
        comp = stored(components(links), "centre-components")
    more = stored(_block_links(_named(sized, comp), family, sets, percent), "block-links")
    comp = components(links.unionByName(more))
    nodes = profiles.where("task >= 0").select("doc_id", "same", "n", "node").join(comp, "node", "left").select(
        "doc_id", "same", F.col("n").alias("n_shingles"), "node", F.coalesce("component", "node").alias("component"))
    nodes = stored(nodes, "nodes")
    name = nodes.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = nodes.join(name, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node", "component", "same")


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
