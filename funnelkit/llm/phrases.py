"""Phrases of two and three words, counted in HAT-tries and scored by their
weakest cut.

A first pass counts the words.  A phrase cannot occur more often than its
rarest word, so words below the least count end a piece like its last one does;
they are told by a Bloom filter of the others, of a fixed size: one it lets
through by mistake costs time only.

In the second pass a task gives its words numbers and counts, for every place
of a piece, the number triple of the place and the two words after it (0 past
the piece's end) in a HAT-trie for each language: hash containers under a shallow trie over word
numbers.  A container holds the triples of a range of first words, or of one
first word and a range of second ones.  When it passes ``BURST`` entries it
bursts: into two ranges, or into the next level of the trie.  When the tries
pass ``HELD`` entries, the largest containers, whole subtrees, are spilled as
sorted runs until half are left.  A task merges its runs while they are small
and writes them out at ``RUN_ENTRIES``: in one row to each prefix partition,
the sums of the subtrees (the pairs) beside their leaves (the triples).  The
``SHARED`` most frequent words have one number in all tasks; of other words a
row carries the 64-bit hashes.

The runs are merged per prefix partition.  Everything in a run is already
added up, so a triple meets at most one entry a run however often it occurs;
and a first pair's triples are dealt over an eighth of the partitions, so no
pair's subtree, however bushy, lands in one task.

Equal words are told by 64-bit hashes; whether any two words of the corpus
share one is looked up in the whole vocabulary, and if so all is counted again
with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import stored, text_of
from funnelkit.llm.words import _LOWER, buffers, byte_hash, chunks, mix

LEAST, SHARE, BEST = 10, 50, 2000
#: entries at which a container bursts, at which a task's tries are spilled,
#: and at which its merged runs are written out
BURST, HELD, RUN_ENTRIES = 1 << 14, 1 << 19, 1 << 21
#: words that a task numbers before it starts anew
NUMBERED = 1 << 20
#: the most frequent words, which have the same numbers (1 to SHARED) everywhere
SHARED = (1 << 20) - 1
#: bits of the filter of frequent words, and places each word has in it
FILTER_BITS, FILTER_PLACES = 1 << 26, 2
#: bytes of text that a prefix partition stands for
PARTITION_BYTES = 8 << 20
#: entries of a run's row, and entries collected before they are merged
ROW_ENTRIES, MERGE_ENTRIES = 1 << 17, 1 << 20

_ID = 21  # bits of a word number in a packed triple
_MASK = np.uint64((1 << _ID) - 1)
_U = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 32]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True


# ------------------------------------------------------------------ the words

def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text, linked) of the words, lower-cased; a word is
    linked if the next one follows it in the same piece."""
    data, text = buffers(texts)
    data = _LOWER[data]
    broken = _BREAK[data]
    inside = ~(broken | _SPACE[data])
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(text))  # texts with any byte
    begins[text[filled]] = inside[text[filled]]
    stops[text[filled + 1] - 1] = inside[text[filled + 1] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, text)))
    linked = np.zeros(len(start), dtype=bool)
    if len(start):
        piece = np.cumsum(broken)[start]
        linked[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return data, start, end, row, linked


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    hashes = byte_hash(data, start, end)
    return mix(hashes ^ _U(seed)) if seed else hashes


def lang_salt(lang: str) -> np.uint64:
    name = lang.encode() + b"|"
    return byte_hash(np.frombuffer(name, dtype=np.uint8), np.array([0]), np.array([len(name)]))[0]


class Numbers:
    """A task's word numbers by the words' global hashes: from 1, or after
    those of the ``shared`` words (hashes by number, 0 for none, 1 and on)."""

    def __init__(self, shared: np.ndarray | None = None) -> None:
        self.hash = np.zeros(1, dtype=_U) if shared is None else shared  # by number
        order = np.argsort(self.hash[1:])
        self.keys = self.hash[1:][order]                # ascending hashes
        self.number = order.astype(_U) + _U(1)          # of each key

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, given to new words as they come; and for each
        new word a place in ``hashes`` where it is."""
        keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        to = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = to < len(self.keys)
        known[inside] = self.keys[to[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            given = np.arange(len(self.hash), len(self.hash) + len(new), dtype=_U)
            self.keys = np.insert(self.keys, to[new], keys[new])
            self.number = np.insert(self.number, to[new], given)
            self.hash = np.concatenate([self.hash, keys[new]])
        return self.number[np.searchsorted(self.keys, keys)][which], at[new]


def by_lang(batch: pa.RecordBatch, row: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a batch and which of its words are in it."""
    langs = pc.dictionary_encode(pc.fill_null(batch.column(0), "und"))
    code = np.asarray(langs.indices)[row]
    for c in np.unique(code).tolist():
        yield langs.dictionary[c].as_py(), code == c


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(docs["`lang`"].cast("string").alias("lang"), text_of(docs).alias("text"))


def count_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, id, word, f) of every word, added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, words, counts = Numbers(), [b""], {}

        def write() -> Iterator[pa.RecordBatch]:
            told = pa.array(words, pa.binary()).cast(pa.string())
            for lang, n in counts.items():
                for lo in range(0, len(n), 1 << 16):
                    at = np.flatnonzero(n[lo : lo + (1 << 16)]) + lo
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(numbers.hash[at].view(np.int64)), told.take(pa.array(at)),
                                                          pa.array(n[at], pa.int64())], names=["lang", "id", "word", "count"])
            counts.clear()

        for batch in chunks(batches, "text"):
            data, start, end, row, _ = pieces(batch.column(1))
            if not len(start):
                continue
            if len(words) > NUMBERED:
                yield from write()
                numbers, words = Numbers(), [b""]
            ids, new = numbers.of(word_hashes(data, start, end, seed))
            words += [data[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            for lang, mine in by_lang(batch, row):
                seen = np.bincount(ids[mine].astype(np.int64), minlength=len(words))
                if lang in counts:
                    seen[: len(counts[lang])] += counts[lang]
                counts[lang] = seen
            if sum(map(len, counts.values())) > 8 * NUMBERED:  # many languages
                yield from write()
        yield from write()

    return _columns(docs).mapInArrow(run, "lang string, id long, word string, count long").groupBy("lang", "id", "word").agg(F.sum("count").alias("f"))


# ------------------------------------------------------------------ the filter

def _places(hashes: np.ndarray, salt: np.uint64) -> Iterator[np.ndarray]:
    h = mix(hashes ^ salt)
    for k in range(FILTER_PLACES):
        yield (h >> _U(32 * k)) % _U(FILTER_BITS)


def word_filter(words: DataFrame, least: int = LEAST) -> np.ndarray:
    """Bits of the words that occur ``least`` times: whatever their number,
    the driver gets at most ``FILTER_BITS`` / 64 of the filter's 64-bit parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(1)).view(_U)
            for lang, mine in by_lang(batch, np.arange(batch.num_rows)):
                at = np.concatenate(list(_places(ids[mine], lang_salt(lang))))
                yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["at", "bits"])

    parts = words.where(F.col("f") >= least).select("lang", "id").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS >> 6, dtype=_U)
    found = parts.toArrow()
    out[np.asarray(found.column(0))] = np.asarray(found.column(1)).view(_U)
    return out


def frequent(bits: np.ndarray, hashes: np.ndarray, lang: str) -> np.ndarray:
    """Whether each word may be one that occurs often enough in its language."""
    ok = np.ones(len(hashes), dtype=bool)
    for at in _places(hashes, lang_salt(lang)):
        ok &= (bits[at >> _U(6)] >> (at & _U(63))) & _U(1) > 0
    return ok


def shared_words(words: DataFrame, least: int = LEAST, most: int = SHARED) -> np.ndarray:
    """Hashes of the ``most`` most frequent words of all languages, most
    frequent first, after a 0: the driver gets no more than those."""
    often = words.where(F.col("f") >= least).groupBy("id").agg(F.sum("f").alias("f")).orderBy(F.desc("f"), "id").limit(most)
    return np.concatenate([np.zeros(1, dtype=_U), np.asarray(often.select("id").toArrow().column(0)).view(_U)])


# ------------------------------------------------------------------- the trie

class HatTrie:
    """Counts of packed number triples in burstable hash containers.

    The shallow trie is held as its leaves' least keys, in order: a leaf is the
    hash container of the triples from its least key up to the next one's, and
    it begins at a first word (level 0) or at a pair of words (level 1).
    """

    def __init__(self) -> None:
        self.least = np.zeros(1, dtype=_U)
        self.leaf: list[dict[int, int]] = [{}]
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct keys in ascending order."""
        owner = np.searchsorted(self.least, keys, "right") - 1
        cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(keys)]])
        full = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            k = int(owner[a])
            held = self.leaf[k]
            before, get = len(held), held.get
            for key, n in zip(keys[a:b].tolist(), counts[a:b].tolist(), strict=True):
                held[key] = get(key, 0) + n
            self.size += len(held) - before
            if len(held) > BURST:
                full.append(k)
        for k in reversed(full):
            self._burst(k)

    def _burst(self, k: int) -> None:
        """Cut a leaf at first words or, if it has only one, at second words,
        until no part is too large; a single pair's leaf can't be cut."""
        todo, done = [np.sort(np.fromiter(self.leaf[k], dtype=_U, count=len(self.leaf[k])))], []
        while todo:
            keys = todo.pop()
            at = self._cut(keys) if len(keys) > BURST else 0
            if at:
                todo += [keys[at:], keys[:at]]
            else:
                done.append(keys)
        if len(done) == 1:
            return
        old = self.leaf[k]
        shift = [_U(2 * _ID) if (p[0] >> _U(2 * _ID)) != (q[-1] >> _U(2 * _ID)) else _U(_ID) for q, p in zip(done, done[1:], strict=False)]
        self.least = np.concatenate([self.least[: k + 1], np.array([(p[0] >> s) << s for p, s in zip(done[1:], shift, strict=True)], dtype=_U), self.least[k + 1 :]])
        self.leaf[k : k + 1] = [{x: old[x] for x in p.tolist()} for p in done]

    @staticmethod
    def _cut(keys: np.ndarray) -> int:
        """The border between words that is nearest to the middle, or 0."""
        for shift in (_U(2 * _ID), _U(_ID)):
            part = keys >> shift
            borders = np.flatnonzero(part[1:] != part[:-1]) + 1
            if len(borders):
                return int(borders[np.argmin(np.abs(borders - len(keys) // 2))])
        return 0

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out the largest leaves until at most ``keep`` entries are left:
        (keys, counts), in ascending order."""
        order = sorted(range(len(self.leaf)), key=lambda k: -len(self.leaf[k]))
        out = []
        for k in order:
            if self.size <= keep:
                break
            out.append(k)
            self.size -= len(self.leaf[k])
        taken = [self.leaf[k] for k in out]
        n = sum(map(len, taken))
        keys = np.fromiter((x for held in taken for x in held), dtype=_U, count=n)
        counts = np.fromiter((x for held in taken for x in held.values()), dtype=np.int64, count=n)
        for k in out:
            self.leaf[k] = {}
        return add_up(keys, counts)


# ------------------------------------------------------------------- the runs

def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts; sorted stretches
    are merged."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _sections(*parts: np.ndarray) -> bytes:
    """Non-negative numbers, each array in the fewest bytes a number, packed
    and compressed."""
    raw = b""
    for a in parts:
        top = int(a.max()) if len(a) else 0
        size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s))
        # byte by byte over all numbers: the upper bytes are mostly alike
        body = a.astype(f"<u{size}").view(np.uint8).reshape(len(a), size).T.tobytes()
        raw += bytes([size]) + len(body).to_bytes(8, "little") + body
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _opened(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    while at < len(raw):
        size, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        out.append(np.frombuffer(raw, dtype=np.uint8, offset=at + 9, count=n).reshape(size, n // size).T.copy().view(f"<u{size}").ravel())
        at += 9 + n
    return out


def run_rows(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray, shared: int, lang: str, partitions: int) -> Iterator[dict]:
    """Rows of a run: its triples, and the sums of its pairs as triples whose
    third word is 0.  All but the partition numbers is made a row at a time.
    Numbers up to ``shared`` stay; the others become places in the row's hashes."""
    pair = keys >> _U(_ID)
    if not ((pair & _MASK) > 0).any():
        return
    head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    sums = np.add.reduceat(counts, head)
    two, whole = (pair[head] & _MASK) > 0, (keys & _MASK) > 0
    keys, counts = np.concatenate([pair[head][two] << _U(_ID), keys[whole]]), np.concatenate([sums[two], counts[whole]])
    del pair, head, sums, two, whole
    spread, salt = _U(-(-partitions // 8)), lang_salt(lang)
    split = lambda k: (k >> _U(2 * _ID), (k >> _U(_ID)) & _MASK, k & _MASK)
    part = np.empty(len(keys), dtype=np.uint32)
    for lo in range(0, len(keys), ROW_ENTRIES):
        w1, w2, w3 = split(keys[lo : lo + ROW_ENTRIES])
        third = np.where(w3 > 0, mix(hashes[w3]) % spread, _U(0))
        part[lo : lo + ROW_ENTRIES] = (mix(mix(hashes[w1] ^ salt) ^ hashes[w2]) + third) % _U(partitions)
    order = np.argsort(part, kind="stable")
    border = np.flatnonzero(np.diff(part[order], prepend=part[order[0]] + 1, append=part[order[-1]] + 1))
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        for lo in range(a, b, ROW_ENTRIES):
            at = order[lo : min(b, lo + ROW_ENTRIES)]
            w = np.concatenate(split(keys[at]))
            own = np.flatnonzero(w > shared)
            words, place = np.unique(hashes[w[own]], return_inverse=True)
            w[own] = _U(shared + 1) + place.astype(_U)
            w1, w2, w3 = np.split(w, 3)
            sort = np.lexsort((w3, w2, w1))
            yield {"part": int(part[at[0]]), "lang": lang, "words": words.astype("<u8").tobytes(),
                   "entries": _sections(np.diff(w1[sort], prepend=_U(0)), w2[sort], w3[sort], counts[at[sort]])}


def row_entries(words: bytes, entries: bytes) -> tuple[np.ndarray, ...]:
    """(hashes, w1, w2, w3, n) of a run's row."""
    w1, w2, w3, n = _opened(entries)
    return np.frombuffer(words, dtype="<u8"), np.cumsum(w1, dtype=np.uint32), w2.astype(np.uint32), w3.astype(np.uint32), n.astype(np.int64)


_RUNS = "part int, lang string, words binary, entries binary"


def count_phrases(docs: DataFrame, bits: np.ndarray, common: np.ndarray, partitions: int, seed: int = 0) -> DataFrame:
    """Sorted runs of the phrases whose words pass the filter ``bits``;
    ``common``: see ``shared_words``."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("entries", pa.binary())])
    shared, first = docs.sparkSession.sparkContext.broadcast((bits, common)), len(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, common = shared.value
        numbers, tries, runs = Numbers(common), {}, {}

        def spill(keep: int) -> None:
            """Take the largest subtrees out of the tries, as runs."""
            for lang in sorted(tries, key=lambda x: -tries[x].size):
                over = sum(t.size for t in tries.values()) - keep
                if over > 0:
                    runs.setdefault(lang, []).append(tries[lang].spill(max(0, tries[lang].size - over)))

        def write(most: int) -> Iterator[pa.RecordBatch]:
            """Merge the runs; write them out if more entries than ``most`` are left."""
            for lang, held in runs.items():
                if len(held) > 1:
                    runs[lang] = [add_up(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
            if sum(len(k) for held in runs.values() for k, _ in held) > most:
                for lang, held in runs.items():
                    for row in run_rows(*held[0], numbers.hash, first - 1, lang, partitions):
                        yield pa.RecordBatch.from_pylist([row], schema)
                runs.clear()

        for batch in chunks(batches, "text"):
            data, start, end, row, linked = pieces(batch.column(1))
            if len(numbers.hash) - first > NUMBERED // 2:
                spill(0)
                yield from write(0)
                numbers, tries = Numbers(common), {}
            hashes = word_hashes(data, start, end, seed)
            for lang, mine in by_lang(batch, row):
                place = np.flatnonzero(mine)
                kept = frequent(bits, hashes[place], lang)
                if not kept.any():
                    continue
                # a place is followed by the next word of its language's texts, and that only if it is linked
                ids = np.zeros(len(place), dtype=_U)
                ids[kept] = numbers.of(hashes[place[kept]])[0]
                follows = linked[place] & kept
                second = np.where(follows, np.append(ids[1:], _U(0)), _U(0))
                third = np.where(second > 0, np.append(second[1:], _U(0)), _U(0))
                two = second > 0  # single words are counted already
                keys = (ids[two] << _U(2 * _ID)) | (second[two] << _U(_ID)) | third[two]
                if len(keys):
                    tries.setdefault(lang, HatTrie()).add(*np.unique(keys, return_counts=True))
            if sum(t.size for t in tries.values()) > HELD:
                spill(HELD // 2)
                if sum(len(k) for held in runs.values() for k, _ in held) > RUN_ENTRIES:
                    yield from write(RUN_ENTRIES // 2)
        spill(0)
        yield from write(0)

    return _columns(docs).mapInArrow(run, _RUNS)


class Merge:
    """Sorted runs of one prefix partition and language, added up; words with
    numbers above ``shared`` are told by their hashes."""

    def __init__(self, shared: int) -> None:
        self.shared, self.held, self.size = shared, [], 0

    def add(self, words: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> None:
        self.held.append((words, w1, w2, w3, n))
        self.size += len(n)

    def merge(self) -> None:
        """All runs as one, in order, equal triples once."""
        words, top = np.unique(np.concatenate([r[0] for r in self.held])), np.uint32(self.shared + 1)
        w1, w2, w3 = [], [], []
        for r in self.held:
            place = np.searchsorted(words, r[0]).astype(np.uint32) + top
            for out, w in zip((w1, w2, w3), r[1:4], strict=True):
                own = np.flatnonzero(w >= top)
                if len(own):
                    w = w.copy()
                    w[own] = place[w[own] - top]
                out.append(w)
        n = np.concatenate([r[4] for r in self.held])
        self.held = []
        w1, w2, w3 = np.concatenate(w1), np.concatenate(w2), np.concatenate(w3)
        bits = max(1, (self.shared + 1 + len(words)).bit_length())
        if 3 * bits <= 64:  # runs are in order, so this merges them
            key, n = add_up((w1.astype(_U) << _U(2 * bits)) | (w2.astype(_U) << _U(bits)) | w3, n)
            mask = _U((1 << bits) - 1)
            w1, w2, w3 = (((key >> _U(s)) & mask).astype(np.uint32) for s in (2 * bits, bits, 0))
        else:
            order = np.lexsort((w3, w2, w1))
            w1, w2, w3 = w1[order], w2[order], w3[order]
            first = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (w3[1:] != w3[:-1])]))
            w1, w2, w3, n = w1[first], w2[first], w3[first], np.add.reduceat(n[order], first)
        self.held, self.size = [(words, w1, w2, w3, n)], len(n)

    def often(self, least: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the three words, n) of the triples and pairs that occur
        ``least`` times; hash 0 for no third word."""
        self.merge()
        words, w1, w2, w3, n = self.held[0]
        at, hashes = np.flatnonzero(n >= least), np.concatenate([common, words])
        return hashes[w1[at]], hashes[w2[at]], hashes[w3[at]], n[at]


def merge_runs(runs: DataFrame, common: np.ndarray, partitions: int, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, w3, a) of all phrases that occur ``least`` times; w3 is 0 for pairs."""
    shared, top = runs.sparkSession.sparkContext.broadcast(common), len(common) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, ceiling = None, Merge(top), MERGE_ENTRIES

        def close() -> Iterator[pa.RecordBatch]:
            g1, g2, g3, n = held.often(least, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([name[1]] * len(n), pa.string()), *[pa.array(g.view(np.int64)) for g in (g1, g2, g3)], pa.array(n)],
                                             names=["lang", "w1", "w2", "w3", "a"])

        for batch in batches:
            for k in range(batch.num_rows):
                part, lang, words, entries = (c[k].as_py() for c in batch.columns)
                if (part, lang) != name:
                    if held.size:
                        yield from close()
                    name, held, ceiling = (part, lang), Merge(top), MERGE_ENTRIES
                held.add(*row_entries(words, entries))
                if held.size > ceiling:
                    held.merge()
                    ceiling = max(MERGE_ENTRIES, 2 * held.size)
        if held.size:
            yield from close()

    return runs.repartition(max(8, partitions // 4), "part").sortWithinPartitions("part", "lang").mapInArrow(run, "lang string, w1 long, w2 long, w3 long, a long")


# ----------------------------------------------------------------- the phrases

def _score(a, left, right):
    """floor(1000000 * a * a / (left * right)) in 38-digit decimals."""
    a, left, right = (f"cast({x} AS decimal(18, 0))" for x in (a, left, right))
    return F.expr(f"cast({a} * {a} AS decimal(32, 0)) * 1000000BD div ({left} * {right})")


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, id, word, f) of every word and (lang, w1, w2,
    w3, a) of the phrases that occur often enough, both stored."""
    size = docs.select(F.sum(F.octet_length(text_of(docs))).alias("bytes")).first()["bytes"] or 0
    partitions = max(8, -(-size // PARTITION_BYTES))
    seed = 0
    while True:
        words = stored(count_words(docs, seed), "phrase-words")
        if words.groupBy("lang", "id").count().where("count > 1").isEmpty():
            common = shared_words(words)
            runs = count_phrases(docs, word_filter(words), common, partitions, seed)
            return words, stored(merge_runs(runs, common, partitions), "phrases")
        seed = seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1


def op13(docs: DataFrame, best: int = BEST) -> DataFrame:
    """Each language's best phrases by their weakest cut.

    A null lang counts with the language ``und``; null, empty and wordless texts
    have no phrases; repeated rows count as often as they are there.  Long texts
    are counted whole.  Ranks have no ties (score, count, phrase).  An empty
    table gives no rows; other columns are not read.
    """
    words, phrases = counted(docs)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= LEAST).select("lang", "id", "word", "f")
    first = often.select("lang", F.col("id").alias("w1"), F.col("word").alias("word1"), F.col("f").alias("l"))
    last = often.select("lang", F.col("id").alias("w2"), F.col("word").alias("word2"), F.col("f").alias("r"))
    pairs = phrases.where("w3 = 0").select("lang", "w1", "w2", "a").join(first, ["lang", "w1"]).join(last, ["lang", "w2"])
    pairs = stored(pairs, "phrase-pairs")  # read three times
    # a triple's words and parts come with its two pairs
    front = pairs.select("lang", "w1", "w2", F.col("word1"), F.col("word2"), F.col("l").alias("l1"), F.col("a").alias("l2"))
    back = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    triples = phrases.where("w3 <> 0").join(front, ["lang", "w1", "w2"]).join(back, ["lang", "w2", "w3"])
    one, two = _score("a", "l1", "r1"), _score("a", "l2", "r2")
    triples = triples.withColumn("s1", one).withColumn("s2", two)
    three = triples.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
                           F.when(F.col("s1") <= F.col("s2"), F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    # pairs that a candidate of three words holds half of
    inside = phrases.where("w3 <> 0").select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    most = inside.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("most"))
    free = pairs.join(most, ["lang", "w1", "w2"], "left").where(f"most IS NULL OR 100 * most < {SHARE} * a")
    both = free.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    every = both.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # the best of each part of a language first, so that no task ranks all of one
    some = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
