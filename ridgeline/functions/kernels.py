"""NumPy batch kernels: pairwise distances, running top-k, table lookups, bit packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .vector import LARGEST_FIRST

#: Elements of a temporary block (queries x rows x components where needed).
BLOCK = 1 << 22


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a (n, d) double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = np.asarray(column.flatten(), dtype=np.float64)
    if n and len(values) % n:
        raise ValueError("vectors of different lengths")
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    """A (n, d) matrix as an Arrow list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(x.reshape(-1)))


def pairwise(x: np.ndarray, y: np.ndarray, metric: str = "l2", p: float | None = None) -> np.ndarray:
    """Distances of all rows of x to all rows of y."""
    if metric == "l2":
        return _squared(x, y)
    if metric == "ip":
        return x @ y.T
    if metric == "cosine":
        return unit(x) @ unit(y).T
    out = np.empty((len(x), len(y)))
    step = max(1, BLOCK // max(1, len(y) * x.shape[1]))
    for a in range(0, len(x), step):
        u, v = x[a : a + step, None, :], y[None, :, :]
        out[a : a + step] = _elementwise(u, v, metric, p)
    return out


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by norms and one product, around the rows' mean; what is small
    against the norms, where the terms cancel, is computed again by differences."""
    fine = np.isfinite(y).all(1)
    if fine.any():
        middle = y[fine].mean(0)
        if np.isfinite(middle).all() and (np.abs(middle) > 1.0).any():
            x, y = x - middle, y - middle
    norms = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    out = np.maximum(norms - 2.0 * (x @ y.T), 0.0) + 0.0
    p, q = np.nonzero(out < 1e-6 * norms)
    step = max(1, BLOCK // max(1, x.shape[1]))
    for a in range(0, len(p), step):
        i, j = p[a : a + step], q[a : a + step]
        out[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return out


def _elementwise(u, v, metric: str, p: float | None) -> np.ndarray:
    if metric == "l1":
        return np.abs(u - v).sum(-1)
    if metric == "linf":
        return np.abs(u - v).max(-1)
    if metric == "lp":
        return (np.abs(u - v) ** p).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "canberra":
            return np.nan_to_num(np.abs(u - v) / (np.abs(u) + np.abs(v)), nan=0.0).sum(-1)
        if metric == "braycurtis":
            return np.nan_to_num(np.abs(u - v).sum(-1) / np.abs(u + v).sum(-1), nan=0.0)
        if metric == "jensenshannon":
            m = (u + v) / 2
            return (np.where(u > 0, u * np.log(u / m), 0.0) + np.where(v > 0, v * np.log(v / m), 0.0)).sum(-1) / 2
    raise ValueError(f"unknown metric {metric!r}")


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=x.astype(np.float64, copy=True), where=n > 0)


class TopK:
    """The k best (distance, id) of each query seen so far; ties by id; no NaN distances."""

    def __init__(self, k: int, largest: bool):
        self.k, self.sign = k, -1.0 if largest else 1.0
        self.q = np.zeros(0, np.int64)
        self.d = np.zeros(0)
        self.i = np.zeros(0, np.int64)

    def add(self, distances: np.ndarray, ids: np.ndarray, q: np.ndarray | None = None) -> None:
        """distances: (queries, rows) against ids of rows; q: numbers of the queries."""
        if not distances.size:
            return
        d = distances * self.sign
        rows, cols = best_of_rows(d, self.k)
        self.add_pairs((q if q is not None else np.arange(len(d)))[rows], d[rows, cols] * self.sign, ids[cols])

    def add_pairs(self, q: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> None:
        q, d, i = np.concatenate((self.q, q)), np.concatenate((self.d, distances * self.sign)), np.concatenate((self.i, ids))
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.q, self.d, self.i = q[keep], d[keep], i[keep]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.q, self.d * self.sign + 0.0, self.i


def best_of_rows(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k smallest values of each row, with all ties of the last, without NaN."""
    nan = np.isnan(d)
    if d.shape[1] > k:
        known = np.where(nan, np.inf, d) if nan.any() else d
        kth = np.partition(known, k - 1, axis=1)[:, k - 1]
        return np.nonzero((known <= kth[:, None]) & ~nan)
    return np.nonzero(~nan)


def lookup_sum(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows) sums of tables[q, m, codes[row, m]]."""
    out = np.zeros((len(tables), len(codes)))
    for m in range(codes.shape[1]):
        out += tables[:, m, :][:, codes[:, m]]
    return out


def quantize_tables(tables: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookup tables (queries, M, ksub) as unsigned integers of ``bits`` bits, with a scale
    and an offset by query: a sum of M entries is off by at most M / 2 steps of the scale."""
    low = tables.min(2, keepdims=True)
    scale = np.maximum((tables - low).max((1, 2)), 1e-300) / ((1 << bits) - 1)
    steps = np.rint((tables - low) / scale[:, None, None]).astype(np.uint8 if bits <= 8 else np.uint16)
    return steps, scale, low.sum((1, 2))


def pack_codes(codes: np.ndarray, bits: int) -> np.ndarray:
    """(n, m) codes of ``bits`` bits each as (n, bytes), lowest bit first."""
    n, m = codes.shape
    planes = ((codes[:, :, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes.reshape(n, m * bits), axis=1, bitorder="little")


def unpack_codes(packed: np.ndarray, m: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(packed, axis=1, bitorder="little")[:, : m * bits].reshape(len(packed), m, bits)
    return (planes.astype(np.int64) << np.arange(bits)).sum(2)
