"""Quality classifier: boosted trees over document statistics.

Statistics come from the text's bytes in numpy.  The trees are fitted on the
driver on a bounded, documented sample of labelled rows (``FIT_ROWS``, the
least by a hash of their id, never those held out) and score every document,
flattened into arrays that a task walks for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import held_out, text_of
from funnelkit.llm.trees import Flat, fit
from funnelkit.llm.words import chunks, words

#: labelled rows used to fit, at most
FIT_ROWS = 12_000
THRESHOLD = 0.7

_KIND = np.zeros(256, dtype=np.int64)  # 0 lower or beyond ASCII, 1 upper, 2 digit, 3 symbol, 4 sentence mark, 5 other mark, 6 space
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#*$%&|<>@~^=+_{}[]\\"]] = 3
_KIND[[ord(c) for c in ".,;:!?"]] = 4
_KIND[[ord(c) for c in "\"'()-/`"]] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 6

FEATURES = ("log words", "mean word bytes", "long words", "upper", "digits", "symbols", "sentence marks", "other marks",
            "distinct words", "distinct pairs", "repeated triples", "repeated lines", "words per line", "top word")


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and the count of the commonest one."""
    bits = max(1, int(rows).bit_length())
    key = np.sort((row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    if not len(key):
        return np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    owner = (key[at] >> np.uint64(64 - bits)).astype(np.int64)
    top = np.zeros(rows, dtype=np.int64)
    np.maximum.at(top, owner, np.diff(np.append(at, len(key))))
    return np.bincount(owner, minlength=rows), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text (null: empty)."""
    rows = len(texts)
    w = words(texts, lower=False)
    n = np.diff(w.first)
    n1 = np.maximum(n, 1)
    size = w.end - w.start
    per = lambda values: np.bincount(w.row, values, rows)
    of = np.repeat(np.arange(rows), np.diff(w.text))
    kinds = np.bincount(of * 7 + _KIND[w.data], minlength=rows * 7).reshape(rows, 7)
    shown = np.maximum(np.diff(w.text) - kinds[:, 6], 1)
    distinct, top = _distinct(w.row, w.hash, rows)
    together = lambda k: w.row[k:] == w.row[: len(w) - k] if len(w) > k else np.zeros(0, dtype=bool)
    two, three = together(1), together(2)
    pair = (w.hash[:-1] * np.uint64(3) + (w.hash[1:] >> np.uint64(1)))[two] if len(w) > 1 else w.hash[:0]
    pairs, _ = _distinct(w.row[:-1][two] if len(w) > 1 else w.row[:0], pair, rows)
    triple = (w.hash[:-2] * np.uint64(5) + w.hash[1:-1] * np.uint64(3) + (w.hash[2:] >> np.uint64(1)))[three] if len(w) > 2 else w.hash[:0]
    triples, _ = _distinct(w.row[:-2][three] if len(w) > 2 else w.row[:0], triple, rows)
    # a line's hash is the sum of its bytes' squares by place: words' hashes do
    breaks = np.cumsum(w.data == 10)
    line = breaks[w.start] if len(w) else breaks[:0]
    new = np.append(True, (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])) if len(w) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    line_hash = np.add.reduceat(w.hash * (2 * np.arange(len(w), dtype=np.uint64) - 2 * np.repeat(first, np.diff(np.append(first, len(w)))).astype(np.uint64) + np.uint64(1)), first) if len(first) else w.hash[:0]
    lines = np.bincount(w.row[first], minlength=rows)
    own_lines, _ = _distinct(w.row[first], line_hash, rows)
    share = lambda a, b: a / np.maximum(b, 1)
    return np.stack([
        np.log1p(n), share(per(size), n), share(per(size > 14), n), share(kinds[:, 1], shown), share(kinds[:, 2], shown), share(kinds[:, 3], shown),
        share(kinds[:, 4], n1), share(kinds[:, 5], shown), share(distinct, n), share(pairs, n1 - 1), 1 - share(triples, np.maximum(n - 2, 0)) * (n > 2) - (n <= 2),
        share(lines - own_lines, lines), share(n, lines), share(top, n)], axis=1)


def _with_statistics(rows: DataFrame) -> DataFrame:
    """(doc_id, y, x) of rows with doc_id, y and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled rows that are not held
    out, the least by a hash of their id.  Null ids and labels are left out."""
    chosen = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
    chosen = chosen.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Flat:
    """Boosted trees from the labelled sample."""
    rows = _with_statistics(labelled_sample(docs, labels, label, most)).orderBy("doc_id").limit(2 * most).toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: Flat, column: str = "score") -> DataFrame:
    """All columns of ``docs`` nested in ``record``, and the score of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], names=["record", column])

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"record {rows.schema['record'].dataType.simpleString()}, {column} double")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every text (see the query's contract).

    Null and empty texts are scored by the statistics of no words.  Repeated
    rows get equal scores.  Labels with a null id or value are not learnt
    from; without usable labels all scores are the base rate.  An empty
    documents table gives no rows.
    """
    model = fit_quality(docs, labels)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return scored(docs, fit_quality(docs, labels)).where(F.col("score") >= THRESHOLD).select("record.*")
