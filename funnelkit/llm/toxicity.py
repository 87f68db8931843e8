"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is the embedding of its hash joined with the mean embedding of its
character n-grams (5 bytes each, and its beginnings), so that an unseen form of
a known stem still says something.  Only words and n-grams found in ``LEAST``
training texts or more have embeddings; all others are zero.
Two recurrent passes read a window of ``WINDOW`` words, attention pools their
states, and a linear layer scores the window.  A text's score is that of its
worst window; windows overlap by half and cover the whole text.

The network is trained in numpy on the driver, on a bounded sample of labelled
texts (``FIT_ROWS``), each of them whole.  A label is on a text, not on a window: the windows of a toxic text
that now score highest teach as toxic, those of a clean text that score
highest, and some at random, teach as clean; this is repeated as it learns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import held_out, text_of
from funnelkit.llm.quality_model import labelled_sample
from funnelkit.llm.words import bare, byte_hash, chunks, spans, words

WINDOW, STRIDE = 32, 16
FIT_ROWS = 4_000
#: words of the training texts that are read at once
FIT_BLOCK = 1 << 16
THRESHOLD = 0.3
WORD_ROWS, GRAM_ROWS, GRAM = 1 << 18, 1 << 18, 5
#: lengths of the beginnings
HEADS = (3, 4, 6, 7, 9)
LEAST = 4
EMBED, HIDDEN = 8, 8
ROUNDS, BATCH = 4, 256
DROP, DECAY = 0.2, 1e-3
#: windows that a task runs through the network at once
BLOCK = 2048

# ------------------------------------------------------------------- inputs

@dataclass
class Inputs:
    first: np.ndarray   # first word of each text, one more than texts
    word: np.ndarray    # distinct word of each word
    row: np.ndarray     # embedding row of each distinct word
    gram: np.ndarray    # embedding rows of their 4-grams, one after the other
    count: np.ndarray   # how many each has
    name: np.ndarray | None = None  # hash of each distinct word


def inputs(texts: pa.Array) -> Inputs:
    """The words of all texts, lower-cased and without outer punctuation."""
    w = words(texts, hashes=False)
    if not len(w):
        none = np.zeros(0, dtype=np.int64)
        return Inputs(w.first, none, none, none, none, none.astype(np.uint64))
    start, end = bare(w)
    h, at, which = np.unique(byte_hash(w.data, start, end), return_index=True, return_inverse=True)
    a, b = start[at], end[at]
    count = np.maximum(b - a - GRAM + 1, 1)
    lo = spans(a, count + len(HEADS))
    k = lo - np.repeat(a, count + len(HEADS))
    inner = k < np.repeat(count, count + len(HEADS))
    # places after the n-grams' stand for beginnings, which get another name
    head = np.array([0, *HEADS])[np.where(inner, 0, k - np.repeat(count, count + len(HEADS)) + 1)]
    lo = np.where(inner, lo, np.repeat(a, count + len(HEADS)))
    last = np.repeat(b, count + len(HEADS))
    gram = byte_hash(w.data, lo, np.minimum(lo + np.where(inner, GRAM, head), last)) + np.where(inner, 0, head + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = count + len(HEADS)
    return Inputs(w.first, which, (h % np.uint64(WORD_ROWS)).astype(np.int64), (gram % np.uint64(GRAM_ROWS)).astype(np.int64), count, h)


def blocks(first: np.ndarray, most: int = FIT_BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many words (or one text) each."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, "right")) - 1)
        yield a, b
        a = b


def inputs_by_blocks(texts: list[str]) -> Inputs:
    """``inputs`` of whole texts, read a few at a time to save memory."""
    parts = []
    for a, b in blocks(np.concatenate([[0], np.cumsum([len(t) // 6 + 1 for t in texts])])):
        parts.append(inputs(pa.array(texts[a:b], pa.string())))
    name, at, which = np.unique(np.concatenate([x.name for x in parts]), return_index=True, return_inverse=True)
    edge = np.cumsum([0, *[len(x.name) for x in parts]])
    word = np.concatenate([which[k + x.word] for k, x in zip(edge, parts, strict=False)])
    size = np.concatenate([np.diff(x.first) for x in parts])
    count = np.concatenate([x.count for x in parts])
    start = np.cumsum(count) - count
    gram = np.concatenate([x.gram for x in parts])[spans(start[at], count[at])]
    return Inputs(np.concatenate([[0], np.cumsum(size)]), word, np.concatenate([x.row for x in parts])[at], gram, count[at], name)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window; a text without words has one
    window without words."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    start = spans(np.zeros(len(n), dtype=np.int64), count) * STRIDE
    return text, first[:-1][text] + start, np.clip(n[text] - start, 0, WINDOW)


# ------------------------------------------------------------------ the network

_TABLES = ("words", "grams", "word_at", "gram_at")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = 2 * EMBED, HIDDEN
    g = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    z = lambda *s: np.zeros(s, dtype=np.float32)
    # the two directions' input, recurrent and bias weights: update, reset, new
    # row 0 of the embeddings stands for all that have none
    return {"words": z(1, EMBED), "grams": z(1, EMBED), "word_at": np.zeros(WORD_ROWS, dtype=np.int32), "gram_at": np.zeros(GRAM_ROWS, dtype=np.int32),
            "W": g(2, d, 3 * h), "U": g(2, h, 3 * h), "b": z(2, 3 * h),
            "A": g(2 * h, h), "a": z(h), "v": g(h), "w": g(2 * h), "o": z(1)}


def distinct_vectors(p: dict, x: Inputs) -> np.ndarray:
    """Distinct words' vectors: word and mean 4-gram embeddings."""
    if not len(x.row):
        return np.zeros((0, 2 * EMBED), dtype=np.float32)
    at = np.cumsum(x.count) - x.count
    grams = np.add.reduceat(p["grams"][p["gram_at"][x.gram]], at, axis=0) / x.count[:, None]
    return np.concatenate([p["words"][p["word_at"][x.row]], grams], axis=1).astype(np.float32)


def forward(p: dict, projected: np.ndarray, index: np.ndarray, size: np.ndarray, keep: bool = False):
    """Scores (logits) of windows.  ``projected``: distinct words through W and
    b for both directions (words x 2 x 3h); ``index``: windows x WINDOW."""
    n, h = len(index), HIDDEN
    states = np.zeros((2, WINDOW, n, h), dtype=np.float32)
    kept = []
    longest = int(size.max()) if n else 0
    for way in (0, 1):
        now = np.zeros((n, h), dtype=np.float32)
        for k in range(longest):
            t = k if way == 0 else longest - 1 - k
            live = (t < size)[:, None]
            x = projected[index[:, t], way]
            u = now @ p["U"][way]
            gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            out = np.where(live, new + z * (now - new), now)
            if keep:
                kept.append((way, t, live, now, u, z, r, new))
            states[way, t] = now = out
    mask = np.arange(longest)[:, None] < size[None, :]
    both = np.concatenate([states[0, :longest], states[1, :longest]], axis=2)  # time x n x 2h
    hidden = np.tanh(both @ p["A"] + p["a"])
    logit = np.where(mask, hidden @ p["v"], -1e9)
    weight = np.exp(logit - logit.max(axis=0)) * mask if longest else logit
    weight = weight / np.maximum(weight.sum(axis=0), 1e-9) if longest else weight
    pooled = (weight[:, :, None] * both).sum(axis=0) if longest else np.zeros((n, 2 * h), dtype=np.float32)
    score = pooled @ p["w"] + p["o"][0]
    return (score, (kept, both, hidden, weight, pooled, longest)) if keep else score


def gradients(p: dict, vectors: np.ndarray, index: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean log loss, and that of the distinct words' vectors."""
    h, n = HIDDEN, len(y)
    projected = np.einsum("nd,wdk->nwk", vectors, p["W"]) + p["b"]
    score, (kept, both, hidden, weight, pooled, longest) = forward(p, projected.astype(np.float32), index, size, keep=True)
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in _TABLES}
    d_score = ((_sigmoid(score) - y) / n).astype(np.float32)
    g["w"], g["o"] = pooled.T @ d_score, np.array([d_score.sum()], dtype=np.float32)
    d_pooled = d_score[:, None] * p["w"]
    d_weight = (both * d_pooled).sum(axis=2)
    d_logit = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_hidden = d_logit[:, :, None] * p["v"] * (1 - hidden**2)
    g["v"] = np.einsum("tn,tnk->k", d_logit, hidden)
    g["A"], g["a"] = np.einsum("tnd,tnk->dk", both, d_hidden), d_hidden.sum(axis=(0, 1))
    d_both = weight[:, :, None] * d_pooled + d_hidden @ p["A"].T
    d_projected = np.zeros_like(projected, dtype=np.float32)
    carry = [np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32)]
    for way, t, live, before, u, z, r, new in reversed(kept):
        d_out = carry[way] + d_both[t, :, way * h : (way + 1) * h]
        d_live = np.where(live, d_out, 0)
        d_new = d_live * (1 - z) * (1 - new**2)
        d_z = d_live * (before - new) * z * (1 - z)
        d_r = d_new * u[:, 2 * h :] * r * (1 - r)
        d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
        np.add.at(d_projected, (index[:, t], way), np.concatenate([d_z, d_r, d_new], axis=1))
        g["U"][way] += before.T @ d_u
        carry[way] = np.where(live, d_live * z, d_out) + d_u @ p["U"][way].T
    g["W"] = np.einsum("nd,nwk->wdk", vectors, d_projected).astype(np.float32)
    g["b"] = d_projected.sum(axis=0)
    return g, np.einsum("nwk,wdk->nd", d_projected, p["W"]).astype(np.float32)


def project(p: dict, x: Inputs) -> np.ndarray:
    return (np.einsum("nd,wdk->nwk", distinct_vectors(p, x), p["W"], optimize=True) + p["b"]).astype(np.float32)


def worst(p: dict, x: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The worst window's score of each text; and (text, index, size) of all."""
    text, start, size = windows(x.first)
    projected = project(p, x)
    if not len(projected):
        projected = np.zeros((1, 2, 3 * HIDDEN), dtype=np.float32)
    score = np.zeros(len(text), dtype=np.float32)
    word = x.word if len(x.word) else np.zeros(1, dtype=np.int64)
    for a in range(0, len(text), BLOCK):
        s = slice(a, a + BLOCK)
        index = word[np.minimum(start[s, None] + np.arange(WINDOW), len(word) - 1)]
        score[s] = forward(p, projected, index, size[s])
    top = np.full(len(x.first) - 1, -np.inf)
    np.maximum.at(top, text, score)
    return top, score, text, start


# ------------------------------------------------------------------- training

def _odds(x: Inputs, y: np.ndarray, rows: int, grams: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log odds of a text with this row (a word's, or an n-gram's) to be
    toxic, and the texts it is in; counted over a few texts at a time."""
    has, bad = np.zeros(rows), np.zeros(rows)
    at = np.cumsum(x.count) - x.count
    for a, b in blocks(x.first):
        doc = np.repeat(np.arange(a, b), np.diff(x.first[a : b + 1]))
        pair = np.unique((doc - a) * len(x.row) + x.word[x.first[a] : x.first[b]])
        doc, word = pair // max(len(x.row), 1), pair % max(len(x.row), 1)
        row = x.gram[spans(at[word], x.count[word])] if grams else x.row[word]
        doc = np.repeat(doc, x.count[word]) if grams else doc
        pair = np.unique(doc * rows + row)
        has += np.bincount(pair % rows, minlength=rows)
        bad += np.bincount(pair % rows, y[a + pair // rows], rows)
    lift = np.log((bad + 0.2) / (y.sum() + 0.4)) - np.log((has - bad + 0.2) / ((1 - y).sum() + 0.4))
    return np.where(has >= LEAST, np.clip(lift, -1, 5) * has / (has + 6), 0), has


def _table(rng: np.random.Generator, odds: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings, place of each row in them); row 0 stays zero."""
    own = np.flatnonzero(has >= LEAST)
    at = np.zeros(len(has), dtype=np.int32)
    at[own] = 1 + np.arange(len(own))
    table = np.zeros((1 + len(own), EMBED), dtype=np.float32)
    table[1:] = rng.standard_normal((len(own), EMBED)) * 0.02
    table[1:, 0] += odds[own]
    return table, at


def train(texts: list[str], y: np.ndarray, seed: int = 10) -> dict[str, np.ndarray]:
    """Weights, and the scale of a text's score ("cal").  Without texts of
    both classes the network is left as it starts and scores the base rate."""
    rng = np.random.default_rng(seed)
    p = start_weights(rng)
    share = (y.sum() + 0.5) / (len(y) + 1)
    p["cal"] = np.array([0.0, np.log(share / (1 - share))])
    if not len(y) or y.min() == y.max():
        return p
    x = inputs_by_blocks(texts)
    at = np.cumsum(x.count) - x.count
    odds, has = _odds(x, y, WORD_ROWS, False)
    gram_odds, gram_has = _odds(x, y, GRAM_ROWS, True)
    p["words"], p["word_at"] = _table(rng, odds, has)
    p["grams"], p["gram_at"] = _table(rng, gram_odds, gram_has)
    net = {k: v for k, v in p.items() if k != "cal"}
    learnt = [k for k in net if k not in ("word_at", "gram_at")]
    moment = {k: (np.zeros_like(net[k]), np.zeros_like(net[k])) for k in learnt}
    text, start, size = windows(x.first)
    word_score = odds[x.row] + np.add.reduceat(gram_odds[x.gram], at) / x.count
    total = np.concatenate([[0], np.cumsum(np.maximum(word_score[x.word], 0))])
    score = total[np.minimum(start + size, len(x.word))] - total[start]
    step = 0
    for turn in range(ROUNDS):
        if turn:
            score = worst(net, x)[1]
        # the two highest windows of each text, and as many clean ones at random
        order = np.lexsort((-score, text))
        rank = spans(np.zeros(len(y), dtype=np.int64), np.bincount(text, minlength=len(y)))
        high = order[rank < 2]
        first_only = order[rank < 1]
        chosen = np.concatenate([first_only[y[text[first_only]] == 1], high[y[text[high]] == 0], rng.choice(np.flatnonzero(y[text] == 0), min(len(y), int((y[text] == 0).sum())), replace=False)])
        bad = chosen[y[text[chosen]] == 1]
        chosen = rng.permutation(np.concatenate([chosen, np.repeat(bad, 3)]))
        for a in range(0, len(chosen), BATCH):
            c = chosen[a : a + BATCH]
            index = x.word[np.minimum(start[c, None] + np.arange(WINDOW), len(x.word) - 1)]
            used, index = np.unique(index, return_inverse=True)
            index = index.reshape(len(c), WINDOW)
            own = Inputs(x.first, used, x.row[used], x.gram[spans(at[used], x.count[used])], x.count[used])
            vectors = distinct_vectors(net, own)
            shown = np.ones_like(vectors)  # whole word or n-gram halves are dropped
            shown[:, :EMBED] = (rng.random((len(used), 1)) >= DROP) / (1 - DROP)
            shown[:, EMBED:] = (rng.random((len(used), 1)) >= DROP) / (1 - DROP)
            g, d_vec = gradients(net, vectors * shown, index, size[c], y[text[c]].astype(np.float32))
            d_vec = d_vec * shown
            g["words"], g["grams"] = DECAY / len(chosen) * net["words"], DECAY / len(chosen) * net["grams"]
            np.add.at(g["words"], net["word_at"][own.row], d_vec[:, :EMBED])
            np.add.at(g["grams"], net["gram_at"][own.gram], np.repeat(d_vec[:, EMBED:] / own.count[:, None], own.count, axis=0))
            g["words"][0] = g["grams"][0] = 0
            step += 1
            for k in learnt:  # Adam
                m, v = moment[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                net[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    top = worst(net, x)[0]
    scale, shift = 1.0, 0.0
    for _ in range(200):  # a text's score: the worst window's logit, rescaled
        q = _sigmoid(scale * top + shift)
        h = np.maximum(q * (1 - q), 1e-4)
        grad = np.array([((q - y) * top).sum() + 1e-2 * (scale - 1), (q - y).sum()])
        hess = np.array([[(h * top * top).sum() + 1e-2, (h * top).sum()], [(h * top).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        scale, shift = scale - 0.5 * move[0], shift - 0.5 * move[1]
    return net | {"cal": np.array([scale, shift])}


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> dict[str, np.ndarray]:
    rows = labelled_sample(docs, labels, label, most).select("doc_id", "y", "text").orderBy("doc_id", "text").limit(2 * most).toPandas()
    return train(rows["text"].tolist(), rows["y"].to_numpy(dtype=float))


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text (see the query's contract).

    Null and empty texts, and texts without words, are scored by the network's
    answer to a window without words.  Repeated rows get equal scores; labels
    with a null id or value are not learnt from; without labels of both kinds
    all scores are the base rate.  An empty documents table gives no rows.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(fit_toxicity(docs, labels))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = weights.value
        scale, shift = p["cal"]
        for batch in chunks(batches, "text"):
            top = worst(p, inputs(batch.column(1)))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(scale * top + shift).astype(float))], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
