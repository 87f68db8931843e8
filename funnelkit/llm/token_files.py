"""Token ids in word-aligned Simple-8b files.

The file format
---------------
A token file set is a Parquet folder, so that Spark's commit protocol covers
it on any store: a lost executor's half-written files never become visible.
Each row is a *segment* of whole documents in ascending order:

    part, seg      place in the global order (range partition, then segment)
    doc_ids        ids of its documents
    doc_lengths    token ids of each, end id included
    n_ids          their sum
    payload        the ids, Simple-8b

A payload is a sequence of little-endian 64-bit words: the number of ids, the
number of blocks, the first word of every block, then the packed blocks of
``BLOCK`` ids (the last may be shorter).  A packed word has a 4-bit selector
in its top bits and so many values of so many bits below, the first value
lowest.  Selector 15 is the escape: the next word is one raw 64-bit value.
Blocks are independent: any one decodes without those before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import scratch, text_of
from funnelkit.llm.words import Words, byte_hash, chunks, spans, words

#: ids in a word and bits of each, by selector; 15 is the escape
COUNT = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15
BLOCK = 512
#: ids after which a segment is closed
SEGMENT_IDS = 1 << 17
#: distinct text pieces a worker remembers
CACHE_PIECES = 2_000_000
#: new pieces that go to the library in one text
JOINED = 64

_SEGMENTS = "part int, seg int, doc_ids array<long>, doc_lengths array<long>, n_ids long, payload binary"


# ---------------------------------------------------------------- the codec

def encode(ids: np.ndarray) -> bytes:
    """Pack unsigned 64-bit ids; any value is allowed, none ids too."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(2, dtype="<u8").tobytes()
    # the widest selector that fits at every place: all of its values must be
    # narrow enough and lie in the same block (a float's exponent is never
    # below a value's bit length)
    width = np.frexp(ids.astype(np.float64))[1]
    left = np.minimum(BLOCK, n - np.arange(0, n, BLOCK))[np.arange(n) // BLOCK] - np.arange(n) % BLOCK
    choice = np.full(n, ESCAPE)
    for s in range(ESCAPE - 1, -1, -1):
        narrow, c = np.flatnonzero(width <= BITS[s]), COUNT[s]
        if len(narrow) < c:
            continue
        place = narrow[: len(narrow) - c + 1]
        place = place[(narrow[c - 1 :] - place == c - 1) & (left[place] >= c)]
        choice[place] = s
    # walk all blocks at once, a word of each at a time
    at, owner, taken = np.arange(blocks) * BLOCK, np.arange(blocks), []
    stop = np.minimum(at + BLOCK, n)
    while len(at):
        taken.append((owner, at))
        at = at + COUNT[choice[at]]
        more = at < stop[owner]
        at, owner = at[more], owner[more]
    owner = np.concatenate([o for o, _ in taken])
    at = np.concatenate([a for _, a in taken])
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    sel = choice[at]
    size = 1 + (sel == ESCAPE)
    word_at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint64)
    for s in np.unique(sel):
        mine = sel == s
        if s == ESCAPE:
            out[word_at[mine]] = np.uint64(ESCAPE) << np.uint64(60)
            out[word_at[mine] + 1] = ids[at[mine]]
            continue
        packed = np.full(int(mine.sum()), np.uint64(s) << np.uint64(60), dtype=np.uint64)
        for k in range(COUNT[s] if BITS[s] else 0):
            packed |= ids[at[mine] + k] << np.uint64(k * BITS[s])
        out[word_at[mine]] = packed
    block_at = word_at[np.searchsorted(owner, np.arange(blocks))]
    head = np.concatenate([[n, blocks], block_at]).astype("<u8")
    return head.tobytes() + out.astype("<u8").tobytes()


def decode(payload: bytes, blocks: slice | None = None) -> np.ndarray:
    """The ids of a payload, or of a range of its blocks."""
    head = np.frombuffer(payload, dtype="<u8", count=2)
    n, count = int(head[0]), int(head[1])
    block_at = np.frombuffer(payload, dtype="<u8", offset=16, count=count).astype(np.int64)
    data = np.frombuffer(payload, dtype="<u8", offset=16 + 8 * count)
    if blocks is not None:
        lo, hi, _ = blocks.indices(count)
        if lo >= hi:
            return np.zeros(0, dtype=np.uint64)
        data = data[block_at[lo] : block_at[hi] if hi < count else len(data)]
        n = min(n, hi * BLOCK) - lo * BLOCK
    if not n:
        return np.zeros(0, dtype=np.uint64)
    sel = (data >> np.uint64(60)).astype(np.int64)
    raw = np.flatnonzero(sel == ESCAPE)
    if len(raw):  # a raw value may look like an escape itself
        keep, word = np.ones(len(data), dtype=bool), -1
        for w in raw:
            if w != word:
                word = w + 1
                keep[word] = False
        at = np.flatnonzero(keep)
    else:
        at = np.arange(len(data))
    sel = sel[at]
    to = np.cumsum(COUNT[sel])
    first = to - COUNT[sel]
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(sel):
        mine = sel == s
        if s == ESCAPE:
            out[first[mine]] = data[at[mine] + 1]
            continue
        if not BITS[s]:
            continue
        mask = (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
        w = data[at[mine]]
        for k in range(COUNT[s]):
            out[first[mine] + k] = (w >> np.uint64(k * BITS[s])) & mask
    return out


# ------------------------------------------------------------ the tokenizer

class PieceEncoder:
    """Ids of whole texts by the tokenizers library, through remembered pieces.

    The vocabulary's pre-tokenizer cuts a text into pieces that are encoded
    on their own.  A border from a non-space to a single white space is always
    such a cut, and so is one from a letter or digit to a word's closing ASCII
    punctuation.  Words are found and hashed in numpy over the text's buffer;
    only a piece not met before becomes a string and goes to the library.
    Texts with other white space (runs of it, at an end, or beyond ASCII) or
    an added token's string go through the library whole.  The memory is
    emptied at ``CACHE_PIECES``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.bytes_of = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, k in self.lib.get_vocab(with_added_tokens=True).items():
            self.bytes_of[k] = len(token)  # a byte-level token has a character for each byte
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)    # ascending
        self.number = np.zeros(0, dtype=np.int64)   # of each key's piece
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.at = np.zeros(1 << 16, dtype=np.int64)

    def _remember(self, keys: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces, keep their ids and return their numbers.  Pieces that start with white
        space are joined, as every joint is a cut; the ids are dealt back by
        their bytes, and a joint text whose ids don't end where its pieces do
        is encoded piece by piece."""
        size = np.array([len(p) for p in pieces])
        open_ = np.array([p[0] not in _BLANKS for p in pieces])
        order = np.argsort(~open_, kind="stable")  # pieces without white space first, each a text of its own
        alone = int(open_.sum())
        start = np.concatenate([np.arange(alone), np.arange(alone, len(pieces), JOINED)]).astype(np.int64)
        stop = np.append(start[1:], len(pieces))
        ordered = [pieces[k] for k in order.tolist()]
        flat, count = [], np.empty(len(pieces), dtype=np.int64)
        joint = [b"".join(ordered[a:b]).decode() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        for lo, hi, found in zip(start.tolist(), stop.tolist(), self.lib.encode_batch_fast(joint, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype=np.uint32)
            ends, upto = np.cumsum(size[order[lo:hi]]), np.cumsum(self.bytes_of[ids])
            to = np.searchsorted(upto, ends)
            if not len(ids) or upto[-1] != ends[-1] or (upto[to] != ends).any():
                each = [self._whole(p.decode()) for p in ordered[lo:hi]]
                ids, to = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            flat.append(ids)
            count[lo:hi] = np.diff(to + 1, prepend=0)
        ids = np.concatenate(flat)
        n, first = len(self.keys), int(self.at[len(self.keys)])
        ends = first + np.cumsum(count)
        while n + len(count) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.at[n + 1 : n + 1 + len(count)] = ends
        self.flat[first : ends[-1]] = ids
        number = np.empty(len(count), dtype=np.int64)
        number[order] = np.arange(n, n + len(count))
        to = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, to, keys)
        self.number = np.insert(self.number, to, number)
        return number

    def _odd(self, w: Words) -> np.ndarray:
        """Texts that are not cut here: white space at an end or in a run, or
        beyond ASCII, or an added token's string."""
        d = np.concatenate([w.data, np.zeros(2, dtype=np.uint8)])
        one, two, three = d[:-2], d[1:-1], d[2:]
        space = _BLANK[one]
        found = space & _BLANK[two]
        found |= (one >= 28) & (one <= 31)
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            at = np.flatnonzero(one == lead)
            b, c = two[at], three[at]
            if lead == 0xC2:
                hit = (b == 0x85) | (b == 0xA0)
            elif lead == 0xE1:
                hit = (b == 0x9A) & (c == 0x80)
            elif lead == 0xE2:
                hit = ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))
            else:
                hit = (b == 0x80) & (c == 0x80)
            found[at[hit]] = True
        filled = np.flatnonzero(np.diff(w.text))
        odd = np.zeros(len(w.text) - 1, dtype=bool)
        odd[filled] = space[w.text[filled]] | space[w.text[filled + 1] - 1]
        odd[np.searchsorted(w.text, np.flatnonzero(found), "right") - 1] = True
        for token in self.added:
            if token in (all_ := w.data.tobytes()):
                odd |= [token in all_[a:b] for a, b in zip(w.text, w.text[1:], strict=False)]
        return odd

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        if len(self.keys) > CACHE_PIECES:
            self.forget()
        w = words(texts, lower=False, hashes=False)
        whole = self._odd(w)
        data, start, end = w.data, w.start, w.end
        if not len(w):
            return [self._whole(t) if odd else np.zeros(0, dtype=np.uint32) for t, odd in zip(texts.to_pylist(), whole, strict=True)]
        # the core of a word ends after its last byte that isn't punctuation,
        # if that is a letter or digit for sure
        place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        core = np.maximum.accumulate(np.where(_PUNCT[data], -1, place))[end - 1] + 1
        last = data[np.maximum(core - 1, 0)]
        sure = _ALNUM[last] | ((data[np.maximum(core - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        core = np.where((core > start) & sure, core, end)
        tail = np.flatnonzero(core < end)
        spaced = start > w.text[w.row]  # one white space before it goes with it
        shift = np.zeros(len(start) + 1, dtype=np.int64)
        shift[tail + 1] = 1
        to = np.arange(len(start)) + np.cumsum(shift)[:-1]
        lo, hi = np.empty(len(start) + len(tail), dtype=np.int64), np.empty(len(start) + len(tail), dtype=np.int64)
        lo[to], hi[to] = start - spaced, core
        lo[to[tail] + 1], hi[to[tail] + 1] = core[tail], end[tail]
        if whole.any():  # texts that the library gets whole need no pieces
            cut = ~whole[np.searchsorted(w.text, lo, "right") - 1]
            lo, hi = lo[cut], hi[cut]
        if not len(lo):
            return [self._whole(t) if odd else np.zeros(0, dtype=np.uint32) for t, odd in zip(texts.to_pylist(), whole, strict=True)]
        keys, at, which = np.unique(byte_hash(data, lo, hi), return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[near] != keys) if len(self.keys) else np.arange(len(keys))
        got = self.number[near] if len(self.keys) else np.zeros(len(keys), dtype=np.int64)
        if len(new):
            flat = data.tobytes()
            got[new] = self._remember(keys[new], [flat[a:b] for a, b in zip(lo[at[new]].tolist(), hi[at[new]].tolist(), strict=True)])
        got = got[which]
        first = self.at[got]
        size = self.at[got + 1] - first
        ids = self.flat[spans(first, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(lo, w.text)]
        return [self._whole(texts[k].as_py()) if odd else ids[ends[k] : ends[k + 1]] for k, odd in enumerate(whole.tolist())]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_BLANKS = b"\t\n\x0b\x0c\r "
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(_BLANKS)] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


# ---------------------------------------------------------------- the files

def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 0, parts: int | None = None) -> str:
    """Encode ``text`` of every row and write the token file set at ``path``.

    Rows go in ascending doc_id order (nulls first; equal ids by the hash of
    their text), one range partition to a task.  A null text is empty and
    yields the end id alone; repeated rows are repeated documents; an empty
    table gives a file set without segments.  Other columns are not read.
    A task holds one segment and one batch of rows; a single text is encoded
    whole, however long.
    """
    spark = docs.sparkSession
    n = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seg = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            sizes = [len(x) for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([sum(sizes)], pa.int64()),
                 pa.array([encode(np.concatenate(ids))], pa.binary())],
                names=["part", "seg", "doc_ids", "doc_lengths", "n_ids", "payload"])

        end = np.array([end_id], dtype=np.uint32)
        for batch in chunks(batches, "text"):
            for name, own in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1)), strict=True):
                ids.append(np.concatenate([own, end]))
                names.append(name)
                held += len(own) + 1
                if held >= SEGMENT_IDS:
                    yield close()
                    ids, names, held, seg = [], [], 0, seg + 1
        if ids:
            yield close()

    (rows.repartitionByRange(n, "doc_id", F.xxhash64("text"))
         .sortWithinPartitions("doc_id", F.xxhash64("text"))
         .mapInArrow(run, _SEGMENTS).write.parquet(path))
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """The segments of a file set (see the module's text)."""
    return spark.read.schema(_SEGMENTS).parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seg, seg_start): ids before each segment, from the sizes alone.

    A running sum inside each part, plus the sum of all parts before it: the
    one unpartitioned window sees one row per written part.
    """
    size = segments.select("part", "seg", "n_ids")
    by_part = size.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return size.select("part", "seg", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part")).join(
        by_part, "part").select("part", "seg", (F.col("part_start") + F.col("in_part")).alias("seg_start"))


def document_digests(spark, path: str) -> DataFrame:
    """Decode a file set and return (doc_id, start, n_tokens, ids_crc32)."""
    segments = read_tokens(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode(r["payload"]).astype("<u4")
                size = np.array(r["doc_lengths"], dtype=np.int64)
                to = np.cumsum(size)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(to, size, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(size), r["part"]), pa.int32()), pa.array(np.full(len(size), r["seg"]), pa.int32()),
                     pa.array(r["doc_ids"], pa.int64()), pa.array(to - size, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(crc, pa.int64())], names=["part", "seg", "doc_id", "offset", "n_tokens", "ids_crc32"])

    found = segments.select("part", "seg", "doc_ids", "doc_lengths", "payload").mapInArrow(
        run, "part int, seg int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(segment_starts(segments), ["part", "seg"]).select(
        "doc_id", (F.col("seg_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op1(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    return document_digests(spark, write_tokens(docs, tokenizer, scratch(spark, "tokens")))
