"""Vectorised word tables over Arrow string columns.

A word is a maximal run of characters other than space and U+0009..U+000D.
The UTF-8 buffer of the column is used as it is: no Python string is made for
a word.  A word's 64-bit hash is a polynomial over its bytes modulo 2**64,
taken as a difference of one running sum and mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# bytes of text handled at once; a longer single text is one chunk of its own
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply twice)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    p = _POWERS.get(base)
    if p is None:
        p = np.ones(1, dtype=np.uint64)
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    _POWERS[base] = p if len(p) <= 4 * CHUNK_BYTES else p[: 2 * CHUNK_BYTES].copy()
    return p[:n]


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges start[i] .. end[i] - 1."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    total = np.cumsum(_BYTE[data] * _powers(_MULT, len(data)))
    h = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
    return mix(h * _powers(_INV, len(data))[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    data: np.ndarray    # the bytes, lower-cased if asked for
    text: np.ndarray    # offsets of the texts in data, one more than texts
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # one past its last byte
    row: np.ndarray     # the text it is in
    first: np.ndarray   # index of each text's first word, one more than texts
    hash: np.ndarray    # 64-bit hash of its bytes

    def __len__(self) -> int:
        return len(self.start)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array, nulls as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = True, hashes: bool = True) -> Words:
    data, text = buffers(texts)
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(text))  # texts with any byte
    begins[text[filled]] = inside[text[filled]]
    stops[text[filled + 1] - 1] = inside[text[filled + 1] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(start, text)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    h = byte_hash(data, start, end) if hashes else np.zeros(0, dtype=np.uint64)
    return Words(data, text, start, end, row, first, h)


_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _outer(data: np.ndarray, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """Each word's first byte from ``at`` on (in steps of 1 or -1) that isn't
    punctuation; not past ``stop``, where the last byte of the word is."""
    at = at.copy()
    left = np.flatnonzero(_PUNCT[data[at]] & (at != stop))
    for _ in range(8):
        at[left] += step
        left = left[_PUNCT[data[at[left]]] & (at[left] != stop[left])]
        if not len(left):
            return at
    # long runs of punctuation: the nearest other byte of every place
    place = np.arange(len(data))
    if step < 0:
        at[left] = np.maximum(np.maximum.accumulate(np.where(_PUNCT[data], -1, place))[at[left]], stop[left])
    else:
        at[left] = np.minimum(np.minimum.accumulate(np.where(_PUNCT[data], len(data), place)[::-1])[::-1][at[left]], stop[left])
    return at


def bare(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bounds without outer ASCII punctuation; a word of nothing
    else stays as it is."""
    if not len(w):
        return w.start, w.end
    last = _outer(w.data, w.end - 1, w.start, -1)
    only = _PUNCT[w.data[last]]  # nothing but punctuation
    start = np.where(only, w.start, _outer(w.data, w.start, last, 1))
    return start, np.where(only, w.end, last + 1)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ranges starts[i] .. starts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``size`` bytes of text, whole rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = max(at + 1, to)
            yield batch.slice(at, to - at)
            at = to
