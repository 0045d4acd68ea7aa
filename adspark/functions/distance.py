"""Distances: column expressions for joined pairs, array kernels for blocks of rows."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, functions as F

METRICS = ("euclidean", "manhattan", "jaccard")


def bit_and_count(a, b) -> Column:
    """Number of bits set in both packed arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, v: s + v
    )


def bit_or_count(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, v: s + v
    )


def jaccard_distance(a, b) -> Column:
    """1 - |a and b| / |a or b| of packed bit sets; two empty sets have distance 0."""
    union = bit_or_count(a, b)
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - bit_and_count(a, b) / union)


def dense_distance(a, b, metric: str, width: int | None = None) -> Column:
    """Euclidean or Manhattan distance; a known width unrolls into generated code.

    With a width, arrays of any other size are an error.
    """

    def term(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d if metric == "euclidean" else F.abs(d)

    if width:
        a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
        fits = F.assert_true(F.coalesce((F.size(a) == width) & (F.size(b) == width), F.lit(True)), F.lit(f"vectors do not have {width} values"))
        total = F.when(fits.isNull(), term(a[0], b[0]))
        for i in range(1, width):
            total = total + term(a[i], b[i])
    else:
        total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(total) if metric == "euclidean" else total


def as_matrix(column, metric: str) -> np.ndarray:
    """Stack a pandas column of arrays to a 2-d matrix of words or doubles."""
    dtype = np.uint64 if metric == "jaccard" else np.float64
    if len(column) == 0:
        return np.zeros((0, 1), dtype)
    if metric == "jaccard":
        return np.stack([np.asarray(v, dtype=np.int64) for v in column]).view(np.uint64)
    return np.stack([np.asarray(v, dtype=dtype) for v in column])


def bit_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in both and in either of all rows of two blocks of packed words."""
    both = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        both += np.bitwise_count(a[:, j, None] & np.ascontiguousarray(b[:, j])[None, :])
    size_a = np.bitwise_count(a).sum(axis=1, dtype=np.int32)
    size_b = np.bitwise_count(b).sum(axis=1, dtype=np.int32)
    return both, size_a[:, None] + size_b[None, :] - both


def block_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of two bounded blocks.

    Accumulates one dimension at a time: a pair gets the same bits whatever block it falls in
    and whichever side it is on, so equality with a threshold taken from a distance holds.
    """
    if metric == "jaccard":
        both, union = bit_counts(a, b)
        return np.where(union == 0, 0.0, 1.0 - both / np.maximum(union, 1))
    out = np.empty((len(a), len(b)))
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    step = max(1, 16384 // max(1, len(b)))  # tiles that stay in the cache
    work = np.empty((step, len(b)))
    for start in range(0, len(a), step):
        tile = out[start : start + step]
        d = work[: len(tile)]
        tile[:] = 0.0
        for j in range(len(left)):
            np.subtract(left[j, start : start + step, None], right[j][None, :], out=d)
            if metric == "euclidean":
                np.multiply(d, d, out=d)
            else:
                np.abs(d, out=d)
            tile += d
        if metric == "euclidean":
            np.sqrt(tile, out=tile)
    return out


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to the same rows of ``b``, with the bits of ``block_distances``."""
    total, left, right = np.zeros(len(a)), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for j in range(len(left)):
        d = left[j] - right[j]
        total += d * d
    return np.sqrt(total)


class Pairs:
    """Distances between the rows of two bounded blocks, of which few are wanted.

    Euclidean distances are first estimated by one product of matrices; estimates within their
    rounding error of a limit count as hits, and hits are worked out anew, bit for bit as in
    ``block_distances``. Other metrics, and blocks with infinite values, are worked out as a whole.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: str):
        self.a, self.b, self.metric = a, b, metric
        self.rough = metric == "euclidean"
        if self.rough:
            with np.errstate(over="ignore", invalid="ignore"):
                size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
            self.rough = bool(np.isfinite(size_a.sum() + size_b.sum()))
        # several times the bound of the rounding errors of both ways to the square of a distance
        self.error = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (size_a + size_b.max(initial=0.0)) if self.rough else np.zeros(len(a))
        self.sizes = (size_a, size_b) if self.rough else None

    @cached_property
    def values(self) -> np.ndarray:
        """Estimated squares, or the distances themselves."""
        if not self.rough:
            return block_distances(self.a, self.b, self.metric)
        out = self.a @ self.b.T
        out *= -2.0
        out += self.sizes[0][:, None]
        out += self.sizes[1][None, :]
        return out

    def _chosen(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(hits)
        if not self.rough:
            return i, j, self.values[i, j]
        if 16 * len(i) > hits.size:  # many are cheaper as a whole
            return i, j, block_distances(self.a, self.b, self.metric)[i, j]
        return i, j, exact_distances(self.a[i], self.b[j])

    def within(self, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and distances of the pairs not beyond ``limit``, an array that fits all pairs."""
        if not self.rough:
            return self._chosen(self.values <= limit)
        reach = np.where(limit < 0, -np.inf, limit * np.abs(limit) * (1 + 1e-12))
        i, j, d = self._chosen(self.values <= reach + self.error[:, None])
        kept = d <= np.broadcast_to(limit, self.values.shape)[i, j]
        return i[kept], j[kept], d[kept]

    def nearest(self, k: int, left_out: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and distances of pairs that hold the ``k`` nearest columns of every row, and ties."""
        self.values[left_out] = np.inf
        keep = min(k, self.values.shape[1])
        kth = np.partition(self.values, keep - 1, axis=1)[:, keep - 1] + 2 * self.error
        return self._chosen((self.values <= kth[:, None]) & (self.values < np.inf))

    def binned(self, bins: int, upper: float) -> tuple[np.ndarray, np.ndarray]:
        """Number of the bin of [0, ``upper``] of every pair, the last one open, and the bins' lower edges; undefined distances come last."""

        def at(d):
            return np.minimum(np.nan_to_num(np.floor(d / upper * bins), nan=float(bins), posinf=float(bins - 1)), np.where(np.isnan(d), bins, bins - 1))

        edges = np.append(np.arange(bins) * (upper / bins), np.nan)
        if not self.rough:
            return at(self.values).astype(np.int64), edges
        error = self.error[:, None]
        low = np.minimum(np.floor(np.sqrt(np.maximum(self.values - error, 0.0)) / upper * bins), bins - 1).astype(np.int64)
        high = np.minimum(np.floor(np.sqrt(np.maximum(self.values + error, 0.0)) / upper * bins), bins - 1).astype(np.int64)
        i, j = np.nonzero(low != high)
        low[i, j] = at(exact_distances(self.a[i], self.b[j])).astype(np.int64)
        return low, edges

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the distance of every pair of bit sets, and the distances by number."""
        both, union = bit_counts(self.a, self.b)
        width = self.a.shape[1] * 64 + 1
        key = union.astype(np.int64) * width + both
        if width * width <= max(1 << 16, key.size):
            found = np.flatnonzero(np.bincount(key.ravel(), minlength=width * width))
            place = np.zeros(width * width, np.int64)
        else:
            found, key = np.unique(key, return_inverse=True)
            key, place = key.reshape(both.shape), np.zeros(len(found), np.int64)
        all_, some = found // width, found % width
        values, where = np.unique(np.where(all_ == 0, 0.0, 1.0 - some / np.maximum(all_, 1)), return_inverse=True)
        place[found if len(place) == width * width else slice(None)] = where
        return place[key], values
