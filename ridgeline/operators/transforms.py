"""Linear and other vector transforms with train, apply and reverse.

Matrices are small (d x d), estimated from one aggregate pass or a bounded sample, and
applied by one matrix product per batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.kernels import lists, matrix, unit
from .codecs import ProductQuantizer, map_vectors, sample_matrix


class Transform:
    def apply_matrix(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def reverse_matrix(self, y: np.ndarray) -> np.ndarray:
        raise NotImplementedError(f"{type(self).__name__} has no reverse")

    def apply(self, df: DataFrame) -> DataFrame:
        return map_vectors(df, self.apply_matrix, "vec")

    def reverse(self, df: DataFrame) -> DataFrame:
        return map_vectors(df, self.reverse_matrix, "vec")


@dataclass
class Linear(Transform):
    """A x + b; reversed by the transpose if A is orthonormal, else by least squares."""

    a: np.ndarray
    b: np.ndarray | None = None

    def apply_matrix(self, x):
        y = x @ self.a.T
        return y if self.b is None else y + self.b

    @property
    def orthonormal(self) -> bool:
        small = self.a @ self.a.T if self.a.shape[0] <= self.a.shape[1] else self.a.T @ self.a
        return bool(np.allclose(small, np.eye(len(small)), atol=4e-5))

    def reverse_matrix(self, y):
        y = y if self.b is None else y - self.b
        return y @ self.a if self.orthonormal else y @ np.linalg.pinv(self.a).T

    def column(self, v: Column) -> Column:
        """As a built-in expression: one inner product per output."""
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in self.a])
        y = F.transform(rows, lambda r: V.ip(r, v))
        return y if self.b is None else V.add(y, F.array(*[F.lit(float(x)) for x in self.b]))


def random_rotation(d_in: int, d_out: int, seed: int = 12345) -> Linear:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(d_in, d_out),) * 2))
    return Linear((q * np.sign(np.diag(r)))[:d_out, :d_in])


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) in one pass over all rows; tasks emit one partial each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"))
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([lists(np.concatenate(([n], s, ss.ravel()))[None, :])], ["m"])

    parts = df.select("vec").mapInArrow(run, "m array<double>")
    sums = parts.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s")).collect()  # d * d + d + 1 rows
    m = np.array([r.s for r in sorted(sums, key=lambda r: r.pos)])
    d = int((np.sqrt(4 * len(m) - 3) - 1) // 2)
    n, mean = int(m[0]), m[1 : d + 1] / m[0]
    return n, mean, m[d + 1 :].reshape(d, d) / m[0] - np.outer(mean, mean)


def pca(df: DataFrame, d_out: int, eigen_power: float = 0.0, epsilon: float = 0.0, rotate: bool = False, balanced_bins: int = 0, seed: int = 12345) -> Linear:
    """A (x - mean) onto the d_out main axes; eigen_power -0.5 whitens; ``balanced_bins``
    deals axes to bins of nearly equal variance; ``rotate`` adds a random rotation."""
    _, mean, cov = moments(df)
    values, vectors = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    values, axes = values[:d_out], axes[:d_out]
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    if eigen_power:
        axes = axes * ((values + epsilon) ** eigen_power)[:, None]
    if balanced_bins:
        size, bins = d_out // balanced_bins, [[] for _ in range(balanced_bins)]
        for i in range(d_out):
            open_bins = [b for b in range(balanced_bins) if len(bins[b]) < size] or list(range(balanced_bins))
            bins[min(open_bins, key=lambda b: values[bins[b]].sum() if bins[b] else 0.0)].append(i)
        axes = axes[[i for b in bins for i in b]]
    if rotate:
        axes = random_rotation(d_out, d_out, seed).a @ axes
    return Linear(axes, -axes @ mean)


def itq_rotation(x: np.ndarray, niter: int = 50, seed: int = 123) -> np.ndarray:
    """Rotation that brings the rows close to their signs."""
    r = random_rotation(x.shape[1], x.shape[1], seed).a
    for _ in range(niter):
        u, _, vt = np.linalg.svd(np.where(x @ r.T >= 0, 1.0, -1.0).T @ x)
        r = u @ vt
    return r


@dataclass
class Chain(Transform):
    steps: list[Transform]

    def apply_matrix(self, x):
        for s in self.steps:
            x = s.apply_matrix(x)
        return x

    def reverse_matrix(self, y):
        for s in reversed(self.steps):
            y = s.reverse_matrix(y)
        return y


def itq(df: DataFrame, d_out: int, do_pca: bool = True, niter: int = 50) -> Chain:
    """Centre, L2-normalise, optionally PCA, rotate."""
    steps: list[Transform] = [centring(df), Normalise()]
    if do_pca:
        normal = Chain(list(steps)).apply(df)
        steps.append(pca(normal, d_out))
    steps.append(Linear(itq_rotation(Chain(list(steps)).apply_matrix(sample_matrix(df)), niter)))
    return Chain(steps)


def opq(df: DataFrame, m: int, d_out: int | None = None, bits: int = 8, niter: int = 10, seed: int = 12345) -> Linear:
    """Rotation fitted in turns with a product quantizer (Procrustes)."""
    x = sample_matrix(df)
    d = d_out or x.shape[1]
    r = random_rotation(x.shape[1], d, seed).a
    for _ in range(niter):
        y = x @ r.T
        pq = ProductQuantizer.fit(y, m, min(bits, max(1, int(np.log2(max(len(x), 2))) - 1)), 5, seed)
        u, _, vt = np.linalg.svd(pq.decode_matrix(pq.encode_matrix(y)).T @ x, full_matrices=False)
        r = u @ vt
    return Linear(r)


@dataclass
class Remap(Transform):
    """Components by position; -1 gives 0.  ``pad``, ``spread`` and subsets are maps."""

    dims: list[int]
    d_in: int

    @classmethod
    def pad(cls, d_in: int, d_out: int) -> Remap:
        return cls([i if i < d_in else -1 for i in range(d_out)], d_in)

    @classmethod
    def spread(cls, d_in: int, d_out: int) -> Remap:
        out = [-1] * d_out
        for i in range(d_in):
            out[i * d_out // d_in] = i
        return cls(out, d_in)

    def apply_matrix(self, x):
        wide = np.concatenate((x, np.zeros((len(x), 1))), axis=1)
        return wide[:, [i if i >= 0 else x.shape[1] for i in self.dims]]

    def reverse_matrix(self, y):
        out = np.zeros((len(y), self.d_in))
        for at, i in enumerate(self.dims):
            if i >= 0:
                out[:, i] = y[:, at]
        return out

    def column(self, v: Column) -> Column:
        return V.select_dims(v, self.dims)


@dataclass
class Normalise(Transform):
    """To unit L2 norm; zero vectors stay; the reverse is the identity."""

    norm: float = 2.0

    def __post_init__(self):
        if self.norm != 2.0:
            raise ValueError("only the L2 norm")

    def apply_matrix(self, x):
        return unit(x)

    def reverse_matrix(self, y):
        return y


def centring(df: DataFrame) -> Linear:
    """x - mean of all rows."""
    rows = df.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()  # d rows
    mean = np.array([r.m for r in sorted(rows, key=lambda r: r.dim)])
    return Linear(np.eye(len(mean)), -mean)
