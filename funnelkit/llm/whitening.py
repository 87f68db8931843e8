"""Embedding whitening from exact cross-products of bit planes.

Every usable vector is taken to integers, x = floor(256 * c).  The fit list
(each distinct integer vector once) is cut into blocks of rows; in a block each
dimension is shifted to start at zero and its bits are laid out as planes, one
bit a row, packed into 64-bit words.  The product of two dimensions is then a
sum over pairs of planes of 2**(p + q) times the population count of the
planes' AND, which is exact.  Blocks add up through Spark as limbs of 30 bits,
so no sum can overflow; the driver receives one number for each pair of
dimensions, centres them as Python integers, M = n * sum(x x') - S S', and only
then takes floats: V = M / n**2, whose eigenvectors are the components.

Vectors of different lengths lie in different spaces: each length has a fit
list, sums and components of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import stored

#: components returned for each row
COMPONENTS = 4
#: rows of the fit list that are packed together, a multiple of 64
BLOCK_ROWS = 4096
#: 64-bit words held while planes are combined
AND_WORDS = 1 << 19
#: eigenvalues not above this share of the largest count as zero
FLAT = 1e-12

_LIMB, _LIMBS = 30, 7
_LONG = 2.0**63
_SCATTER = "dim int, i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS))
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


# ---------------------------------------------------- vectors and their keys

def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, values) of the vectors without null and non-finite entries;
    values are flat, in row order, as doubles."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = column.flatten()  # entries of valid lists alone
    bad = np.asarray(pc.fill_null(pc.is_null(flat), True)) | ~np.isfinite(np.asarray(pc.fill_null(flat, np.nan)))
    row = np.repeat(np.arange(len(column)), lengths)
    good = np.asarray(column.is_valid()).copy()
    good[row[bad]] = False
    values = np.asarray(pc.fill_null(flat, 0.0))[good[row]]
    keep = np.flatnonzero(good)
    return keep, lengths[keep], values


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * c) as long; beyond a long's range its nearest end."""
    scaled = np.floor(values * 256.0)
    inside = np.abs(scaled) < _LONG
    out = np.where(inside, scaled, 0.0).astype(np.int64)
    out[scaled >= _LONG] = np.iinfo(np.int64).max
    out[scaled <= -_LONG] = np.iinfo(np.int64).min
    return out


def by_length(lengths: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for each length among the vectors."""
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        take = (ends[at] - d)[:, None] + np.arange(d)
        yield int(d), at, values[take]


def vector_keys(lengths: np.ndarray, x: np.ndarray) -> list[bytes]:
    """One byte for the narrowest width of all entries, then the entries: equal
    for equal vectors of a length, whatever stands around them."""
    out: list[bytes] = [b""] * len(lengths)
    for d, at, rows in by_length(lengths, x):
        if not d:
            for k in at:
                out[k] = b"\0"
            continue
        low, high = rows.min(axis=1), rows.max(axis=1)
        width = np.select([(low >= -(1 << b)) & (high < 1 << b) for b in (7, 15, 31)], [0, 1, 2], 3)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            flat = rows[mine].astype(_WIDTHS[w]).tobytes()
            size, head = d << int(w), bytes([w])
            for n, k in enumerate(at[mine]):
                out[k] = head + flat[n * size : (n + 1) * size]
    return out


def from_keys(keys: list[bytes], d: int) -> np.ndarray:
    out = np.zeros((len(keys), d), dtype=np.int64)
    width = np.array([k[0] for k in keys], dtype=np.int64)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        out[mine] = np.frombuffer(b"".join(keys[k][1:] for k in mine), dtype=_WIDTHS[w]).reshape(len(mine), d)
    return out


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, x): each distinct integer vector once, as its key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, values = usable(batch.column(0))
            x = integers(values)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(vector_keys(lengths, x), pa.binary())], names=["dim", "x"])

    # vectors without entries have no component and no place in a space
    return vectors.select(vectors[f"`{column}`"]).mapInArrow(run, "dim int, x binary").where("dim > 0").distinct()


# ------------------------------------------------------- bit-sliced products

def planes(y: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative columns: [plane, dimension, word]."""
    n, d = y.shape
    bits = max(1, int(y.max()).bit_length())
    out = np.zeros((bits, d, -(-n // 64) * 8), dtype=np.uint8)
    for p in range(bits):
        packed = np.packbits(((y >> np.uint64(p)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        out[p, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact sum of y[i] * y[j] over the rows, for non-negative 64-bit columns,
    as Python integers where 64 bits could be passed."""
    n, d = y.shape
    sliced = planes(y)
    bits, _, words = sliced.shape
    wide = 2 * bits + n.bit_length() > 62
    total = np.zeros((d, d), dtype=object if wide else np.int64)
    step = max(1, AND_WORDS // max(1, d * words))
    for p in range(bits):
        for q in range(p, bits):
            count = np.empty((d, d), dtype=np.int64)
            for i in range(0, d, step):
                count[i : i + step] = np.bitwise_count(sliced[p, i : i + step, None, :] & sliced[q][None, :, :]).sum(axis=2, dtype=np.int64)
            both = count if p == q else count + count.T
            total += (both.astype(object) << (p + q)) if wide else both << (p + q)
    return total


def block_sums(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, sum of x x') of a block, the sums as Python integers."""
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, so right for any range
    n, shift = len(x), low.astype(object)
    sums = y.astype(object).sum(axis=0) if int(y.max()) > 1 << 40 else y.sum(axis=0, dtype=np.uint64).astype(object)
    cross = cross_products(y).astype(object)
    cross = cross + np.multiply.outer(shift, sums) + np.multiply.outer(sums, shift) + n * np.multiply.outer(shift, shift)
    return n, sums + n * shift, cross


def _limbs(value: int) -> list[int]:
    """Base 2**30 digits, the last one signed."""
    out = [(value >> (_LIMB * k)) & ((1 << _LIMB) - 1) for k in range(_LIMBS - 1)]
    return [*out, value >> (_LIMB * (_LIMBS - 1))]


def scatter(fit: DataFrame) -> DataFrame:
    """Sums over the fit list, added up over all tasks, in limbs: for a dim,
    (i, j) with i <= j a cross-product, (-1, j) a sum, (-1, -1) the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        total: dict[int, list] = {}

        def add(d: int) -> None:
            sums = block_sums(from_keys(held.pop(d), d))
            total[d] = [a + b for a, b in zip(total[d], sums, strict=True)] if d in total else list(sums)

        for batch in batches:
            for d, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = held.setdefault(d, [])
                rows.append(key)
                if len(rows) == BLOCK_ROWS:
                    add(d)
        for d in list(held):
            add(d)
        for d, (n, sums, cross) in total.items():
            upper = np.triu_indices(d)
            i = np.concatenate([[-1], np.full(d, -1), upper[0]])
            j = np.concatenate([[-1], np.arange(d), upper[1]])
            digits = np.array([_limbs(int(v)) for v in [n, *sums, *cross[upper]]], dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              *[pa.array(c, pa.int64()) for c in digits]],
                                             names=["dim", "i", "j", *[f"l{k}" for k in range(_LIMBS)]])

    return fit.mapInArrow(run, _SCATTER).groupBy("dim", "i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)])


# ------------------------------------------------------------ the components

@dataclass
class Space:
    """What whitening needs of one length of vectors."""

    n: int
    sums: list[int]         # S
    axes: np.ndarray        # unit eigenvectors, one a column, at most COMPONENTS
    values: np.ndarray      # their eigenvalues
    explained: np.ndarray   # eigenvalue over trace, nan without variance
    identity_error: float = float("nan")

    @property
    def live(self) -> np.ndarray:
        """Components that have variance."""
        return ~np.isnan(self.explained) & (self.values > 0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        if self.n * (top + 1) < 1 << 61 and max(map(abs, self.sums)) < 1 << 61:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whiten(self, dev: np.ndarray) -> np.ndarray:
        """(x - S/n) on the axes over the root of the eigenvalue; nan where that is zero."""
        centred = (dev / self.n).astype(np.float64)
        root = np.where(self.live, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return centred @ self.axes / root


def space(n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int) -> Space:
    d = len(sums)
    v, square, trace = np.empty((d, d)), n * n, 0
    for (i, j), c in cross.items():
        m = n * c - sums[i] * sums[j]  # centred before any rounding
        v[i, j] = v[j, i] = m / square
        trace += m if i == j else 0
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order]
    whole = trace / square
    values = np.where(values > FLAT * max(values[0], 0), values, 0.0)
    return Space(n, sums, axes, values, values / whole if whole else np.full(len(order), np.nan))


def _value(row) -> int:
    return sum(int(row[f"l{k}"]) << (_LIMB * k) for k in range(_LIMBS))


def fit_spaces(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The space of every length in a stored fit list.  The driver holds one
    number for each pair of dimensions, whatever the number of rows."""
    sums: dict[int, dict] = {}
    for r in scatter(fit).collect():
        sums.setdefault(r.dim, {})[(r.i, r.j)] = _value(r)
    spaces = {}
    for d, found in sums.items():
        n = found.pop((-1, -1))
        first = [found.pop((-1, j)) for j in range(d)]
        spaces[d] = space(n, first, found, components)
    for d, error in identity_errors(fit, spaces).items():
        spaces[d].identity_error = error
    return spaces


def identity_errors(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Largest entry of the whitened fit list's covariance minus the identity,
    over the components with variance; a pass over the fit list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            dims, keys = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for d in np.unique(dims).tolist():
                s = spaces[d]
                w = s.whiten(s.deviations(from_keys([keys[k] for k in np.flatnonzero(dims == d)], d)))[:, s.live]
                one = w.sum(axis=0), w.T @ w
                total[d] = tuple(a + b for a, b in zip(total[d], one, strict=True)) if d in total else one
        for d, (first, second) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([first.tolist()], pa.list_(pa.float64())),
                                              pa.array([second.ravel().tolist()], pa.list_(pa.float64()))], names=["dim", "first", "second"])

    parts = fit.mapInArrow(run, "dim int, first array<double>, second array<double>")
    # one number for each pair of components, added up by Spark
    each = parts.select("dim", F.posexplode(F.concat("first", "second")).alias("at", "v")).groupBy("dim", "at").agg(F.sum("v").alias("v"))
    found: dict[int, dict[int, float]] = {}
    for r in each.collect():
        found.setdefault(r.dim, {})[r["at"]] = r.v
    out = {}
    for d, v in found.items():
        s = spaces[d]
        k = int(s.live.sum())
        flat = np.array([v[i] for i in range(k + k * k)])
        mean = flat[:k] / s.n
        out[d] = float(np.abs(flat[k:].reshape(k, k) / s.n - np.outer(mean, mean) - np.eye(k)).max())
    return out


_ROWS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
         "dim int, deviation_text string")


def whiten(vectors: DataFrame, spaces: dict[int, Space], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each usable vector and component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lengths, values = usable(batch.column(1))
            ids = batch.column(0).take(pa.array(keep))
            for d, at, x in by_length(lengths, integers(values)):
                if not d:
                    continue
                s = spaces[d]
                dev, k = s.deviations(x), s.axes.shape[1]
                top = int(np.abs(dev).max())
                square = (dev * dev).sum(axis=1) if d * top * top < 1 << 62 else (dev.astype(object) ** 2).sum(axis=1)
                fits = [abs(int(v)) < 1 << 63 for v in square] if square.dtype == object else [True] * len(square)
                exact = pa.array([int(v) if ok else None for v, ok in zip(square, fits, strict=True)], pa.int64())
                text = pa.array([None if ok else str(v) for v, ok in zip(square, fits, strict=True)], pa.string())
                row, comp = np.repeat(np.arange(len(at)), k), np.tile(np.arange(k), len(at))
                white = s.whiten(dev).ravel()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at[row])), pa.array(comp + 1, pa.int32()), pa.array(np.full(len(row), s.n), pa.int64()), exact.take(pa.array(row)),
                     pa.array(white, mask=np.isnan(white)), pa.array(s.explained[comp], mask=np.isnan(s.explained[comp])),
                     pa.array(np.full(len(row), s.identity_error), mask=np.full(len(row), np.isnan(s.identity_error))),
                     pa.array(np.full(len(row), d), pa.int32()), text.take(pa.array(row))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "dim", "deviation_text"])

    return vectors.select(vectors[f"`{key}`"].cast("long").alias("vec_id"), vectors[f"`{column}`"]).mapInArrow(run, _ROWS)


def op11(embeddings: DataFrame) -> DataFrame:
    """Whitened coordinates of every usable row on the first components.

    Left out: vectors that are null, empty, or hold null or non-finite entries.
    Repeated rows and ids are all returned (their vector counts once in the
    fit); a null id stays null.  Entries beyond a long's range become its
    nearest end.  ``deviation`` is null where it passes a long, and
    ``deviation_text`` then holds it.  A component without variance (one
    distinct vector, a constant dimension) has explained 0, or null if nothing
    varies, and whitened null; equal eigenvalues may take any axes of their
    plane.  An empty table gives no rows; other columns are not read.
    """
    fit = stored(fit_list(embeddings), "whitening-fit")
    return whiten(embeddings, fit_spaces(fit))
