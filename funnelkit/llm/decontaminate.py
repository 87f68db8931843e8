"""Benchmark decontamination by latent semantic retrieval.

1. *Weights.*  Words are hashed to ``FEATURES`` columns; one pass over all
   documents counts the cells (``CELL`` words) that each column occurs in.
2. *Space.*  A second pass over all cells makes the sketch Y = A'(A R) of their
   TF-IDF rows A with a seeded random R; with R'Y it gives the leading right
   singular vectors of A (a randomised SVD by one power step, Nystrom's form).
   Tasks send sketches of fixed size, which are added up by column.
3. *Candidates.*  Every document is read in overlapping windows, whose lengths
   double up to that of the longest item (see ``windows_of``);
   a window and a benchmark item are a candidate if the cosine of their whitened
   latent vectors passes ``COSINE`` and the window has enough of the item's words.
4. *Checks.*  The longest common subsequence of the item and the text around
   the window decides: a copy keeps ``COPY`` of the item's words in order, or
   ``CORE`` of its content words (those of high weight); a paraphrase keeps
   ``PARAPHRASE`` of its content words if also ``ANSWER`` of those of its answer
   (its last sentence) are there.

The benchmark is a stated query set: it is read in blocks of ``ITEMS`` items,
each of them searched in all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import text_of
from funnelkit.llm.words import bare, byte_hash, chunks, spans, words

FEATURES, RANK, CELL = 1 << 14, 48, 16
#: words of the longest item searched with windows of two cells; longer ones
#: have windows of four, eight and so on cells, up to their own length
SHORT = 40
COSINE = 0.28
COPY, CORE, PARAPHRASE, ANSWER = 0.7, 0.55, 0.4, 0.8
#: content words weigh so much of the greatest weight at least
CONTENT = 0.6
ITEMS = 4096
#: words of a candidate window that are among the item's content words, as a
#: share of these
OVERLAP = 0.4


@dataclass
class Space:
    weight: np.ndarray   # of each column (inverse document frequency)
    basis: np.ndarray    # columns x rank: right singular vectors over values


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text): lower case, bare."""
    w = words(texts, hashes=False)
    return (byte_hash(w.data, *bare(w)) if len(w) else np.zeros(0, dtype=np.uint64)), w.first


def _cells(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell of each text, cell of every word)."""
    n = np.diff(first)
    upto = np.concatenate([[0], np.cumsum(-(-n // CELL))])
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return upto, np.repeat(upto[:-1], n) + place // CELL


def _vectors(total: np.ndarray) -> pa.RecordBatch:
    """A task's sums as rows: feature, then one column for each of its values."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(c) for c in total.T.copy()]], names=["feature", *[f"v{k}" for k in range(total.shape[1])]])


def _by_group(values: np.ndarray, at: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of values[at] (rows x rank) by group, a column at a time: each is
    one weighted count over a table that stays in the processor's cache."""
    out = np.empty((groups, values.shape[1]), dtype=np.float32)
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(group, values[:, k].take(at), groups)
    return out


def _by_cell(values: np.ndarray, at: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Sums of values[at] (rows x rank) by cell, all first words, then all
    second ones and so on: whole rows are added, one gather for each place."""
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(start, len(cell)))
    out = values.take(at[start], axis=0)
    for k in range(1, CELL):
        has = np.flatnonzero(size > k)
        out[has] += values.take(at[start[has] + k], axis=0)
    return out


def _added(texts: DataFrame, task, rows: int, width: int) -> np.ndarray:
    """The sum of all tasks' vectors (rows x width): an aggregate by feature,
    whose result has a fixed size."""
    names = [f"v{k}" for k in range(width)]
    parts = texts.mapInArrow(task, ", ".join(["feature int", *[f"{n} double" for n in names]]))
    found = parts.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((rows, width))
    out[found["feature"].to_numpy()] = found[names].to_numpy()
    return out


def fit_space(docs: DataFrame, seed: int = 9) -> Space:
    """Weights and latent space of all texts of ``docs``."""
    texts = docs.select(text_of(docs).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in chunks(batches, "text"):
            h, first = _words(batch.column(0))
            upto, cell = _cells(first)
            pair = np.sort(cell * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64))
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            total[:-1] += np.bincount(pair % FEATURES, minlength=FEATURES)
            total[-1] += upto[-1]
        yield _vectors(total[:, None].astype(float))

    counts = _added(texts, count, FEATURES + 1, 1)[:, 0]
    weight = np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32)
    test = np.random.default_rng(seed).standard_normal((FEATURES, RANK)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = np.random.default_rng(seed).standard_normal((FEATURES, RANK)).astype(np.float32) * weight[:, None]
        total = np.zeros((FEATURES, RANK))
        for batch in chunks(batches, "text"):
            h, first = _words(batch.column(0))
            if not len(h):
                continue
            upto, cell = _cells(first)
            column = (h % np.uint64(FEATURES)).astype(np.int64)
            squared = np.maximum(np.bincount(cell, weight[column] ** 2, upto[-1]), 1e-6)
            met = np.asfortranarray(_by_cell(weighted, column, cell) / squared[:, None])
            total += _by_group(met, cell, column, FEATURES)
        yield _vectors(total * weight[:, None])

    y = _added(texts, sketch, FEATURES, RANK)
    # A'A is about Y (R'Y)^-1 Y'; its eigenvectors come from Y L^-T
    core = test.T.astype(float) @ y
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > max(value.max(), 0) * 1e-10 if len(value) else value > 0
    if not good.any():
        return Space(weight, np.zeros((FEATURES, 1), dtype=np.float32))
    left, s, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    keep = s > s[0] * 1e-6
    # whitened: a vector's latent coordinates over the singular values of A
    return Space(weight, (left[:, keep] / s[keep] * s[0]).astype(np.float32))


@dataclass
class Items:
    name: list[int]
    words: list[np.ndarray]
    answer: list[np.ndarray]
    vector: np.ndarray


def _items(rows: list, space: Space) -> Items:
    texts = [r["text"] or "" for r in rows]
    h, first = _words(pa.array(texts, pa.string()))
    own = [h[a:b] for a, b in zip(first, first[1:], strict=False)]
    last = [([s for s in re.split(r"(?<=[.!?])\s+|\n", t) if s.strip()] or [""])[-1] for t in texts]
    g, at = _words(pa.array(last, pa.string()))
    mapped = space.weight[:, None] * space.basis
    vector = np.stack([mapped[(x % np.uint64(FEATURES)).astype(np.int64)].sum(axis=0) for x in own]) if own else np.zeros((0, space.basis.shape[1]))
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
    return Items([r["item_id"] for r in rows], own, [g[a:b] for a, b in zip(at, at[1:], strict=False)], vector.astype(np.float32))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = places.get(x)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def windows_of(length: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Items by the cells of the windows they are searched with: two cells for
    items up to ``SHORT`` words; for longer ones four and, doubling, all up to
    the first that holds four fifths of the item, but for those windows that
    cannot hold as many of its content words as are wanted."""
    found, cells, floor = {2: np.flatnonzero((length > 0) & (length <= SHORT))}, 4, SHORT
    while (length > floor).any():
        found[cells] = np.flatnonzero((length > floor) & (wanted <= cells * CELL))
        floor, cells = cells * SHORT // 2, 2 * cells
    return found


_FOUND = "doc_id long, item_id long, kind string, lcs long, item_words long, cosine double, word_start long"


def _search(space: Space, items: Items):
    """The task: hits of all items in the texts of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = (space.weight[:, None] * space.basis).astype(np.float32)
        length = np.array([len(x) for x in items.words])
        content = space.weight >= CONTENT * space.weight.max()
        heavy = lambda x: x[content[(x % np.uint64(FEATURES)).astype(np.int64)]]

        # each item's content words as a mask over the columns
        of_item = np.zeros((len(length), FEATURES), dtype=bool)
        wanted = np.zeros(len(length))
        for k, x in enumerate(items.words):
            x = heavy(x) if len(heavy(x)) >= 3 else x
            of_item[k, (x % np.uint64(FEATURES)).astype(np.int64)] = True
            wanted[k] = OVERLAP * len(np.unique(x))

        def verdict(whole: np.ndarray, answer: np.ndarray, text: np.ndarray, lcs: int) -> str | None:
            if lcs >= COPY * len(whole):
                return "copy"
            a, b, t = heavy(whole), heavy(answer), heavy(text)
            core = common_subsequence(a, t)
            if len(a) >= 5 and core >= CORE * len(a):
                return "copy"
            return "paraphrase" if len(b) and core >= max(3, PARAPHRASE * len(a)) and common_subsequence(b, t) >= ANSWER * len(b) else None

        for batch in chunks(batches, "text"):
            h, first = _words(batch.column(1))
            if not len(h) or not len(length):
                continue
            upto, cell = _cells(first)
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            column = (h % np.uint64(FEATURES)).astype(np.int64)
            latent = _by_cell(mapped, column, cell)
            row = np.repeat(np.arange(len(first) - 1), np.diff(upto))
            hits: dict[tuple[int, int], tuple] = {}
            read: dict[tuple[int, int], tuple] = {}  # the words last compared
            total = np.concatenate([np.zeros((1, latent.shape[1])), np.cumsum(latent, axis=0, dtype=np.float64)])
            for cells, mine in windows_of(length, wanted).items():
                if not len(mine):
                    continue
                # windows start at every cell and end with their text
                end = np.minimum(np.arange(len(row)) + cells, upto[row + 1])
                vector = (total[end] - total[np.arange(len(row))]).astype(np.float32)
                vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
                for a in range(0, len(vector), 8192):
                    cos = items.vector[mine] @ vector[a : a + 8192].T
                    which, at = np.nonzero(cos >= COSINE)
                    edge = np.searchsorted(which, np.arange(len(mine) + 1))
                    for k in np.flatnonzero(np.diff(edge)):
                        item = mine[k]
                        mark = at[edge[k] : edge[k + 1]]
                        lo, hi = start[a + mark], np.minimum(start[a + mark] + cells * CELL, first[row[a + mark] + 1])
                        if (hi - lo).sum() < len(column):
                            held = np.add.reduceat(of_item[item][column[spans(lo, hi - lo)]], np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), dtype=np.int32)
                        else:
                            upto_word = np.concatenate([[0], np.cumsum(of_item[item][column], dtype=np.int32)])
                            held = upto_word[hi] - upto_word[lo]
                        enough = held >= wanted[item]
                        for m, c in zip(mark[enough].tolist(), cos[k, mark[enough]].tolist(), strict=True):
                            r = row[a + m]
                            key = (int(r), int(item))
                            span = len(items.words[item])
                            lo_ = max(int(first[r]), int(start[a + m]) - span)
                            hi_ = min(int(first[r + 1]), int(start[a + m]) + cells * CELL + span)
                            # words inside those compared before add nothing
                            if key in read and read[key][0] <= lo_ and hi_ <= read[key][1]:
                                continue
                            read[key] = (lo_, hi_)
                            text = h[lo_:hi_]
                            lcs = common_subsequence(items.words[item], text)
                            if key in hits and hits[key][0] >= lcs:
                                continue
                            kind = verdict(items.words[item], items.answer[item], text, lcs)
                            if not kind:
                                continue
                            hits[key] = (lcs, kind, span, c, int(start[a + m] - first[r]))
            names = batch.column(0).to_pylist()
            out = [(names[r], items.name[i], v[1], v[0], v[2], v[3], v[4]) for (r, i), v in sorted(hits.items())]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "item_id", "kind", "lcs", "item_words", "cosine", "word_start"), x, strict=True)) for x in out],
                schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("cosine", pa.float64()), ("word_start", pa.int64())]))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs`` and item that it holds.

    Null and empty texts hold nothing, nor do items without words match
    anything.  Repeated rows, and repeated items, give their hits each for
    itself; of several places in one text the one with the longest common
    subsequence is told (the first of equals).  Empty tables give no rows;
    other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    space = fit_space(docs)
    texts = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    found, block = spark.createDataFrame([], _FOUND), []

    def hits(rows: list) -> DataFrame:
        return texts.mapInArrow(_search(space, _items(rows, space)), _FOUND)

    parts = []
    for r in items.toLocalIterator():
        block.append(r.asDict())
        if len(block) == ITEMS:
            parts.append(hits(block))
            block = []
    if block:
        parts.append(hits(block))
    for p in parts:
        found = p if p is parts[0] else found.unionByName(p)
    return found


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item (a row is told
    by its place, so ``docs`` should be a scan or a stored table)."""
    place = F.monotonically_increasing_id()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record"), place.alias("place"))
    keyed = docs.select(docs["text"], place.alias("place"))
    bad = contaminated(keyed, benchmark, "place").select(F.col("doc_id").alias("place")).distinct()
    return rows.join(bad, "place", "left_anti").select("record.*")
