"""Lossy vector codes: scalar, product, residual, local-search, lattice, sign bits.

A codec is trained on a bounded, hash-chosen sample (``TRAIN_ROWS``), is small, and codes
every row.  Scalar codes are built-in expressions; the others are batch kernels.  Codes
are ``array<int>`` columns; ``pack`` makes bytes of them.  Searching codes: distances of
float queries to decoded rows by lookup tables, in broadcast or per inverted list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import vector as V
from ..functions.kernels import BLOCK, TopK, lists, lookup_sum, matrix, pack_codes, pairwise, quantize_tables
from .cluster import hash_sample
from .knn import _PAIRS, _chunks, _compare, _pairs, rank_pairs

TRAIN_ROWS = 65_536


def sample_matrix(df: DataFrame, rows: int = TRAIN_ROWS, seed: int = 5) -> np.ndarray:
    return matrix(hash_sample(df.select("id", "vec"), rows, seed).select("vec").toArrow().column("vec"))


#: Distances that are held at once in training and coding: few, so that they stay in cache.
NEAR_BLOCK = 1 << 15


def nearest_rows(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c nearest to each row of x, in blocks of bounded size."""
    out = np.empty(len(x), np.int64)
    for s in _chunks(x, max(1, NEAR_BLOCK // len(c))):
        out[s] = pairwise(x[s], c).argmin(1)
    return out


def lloyd(x: np.ndarray, k: int, niter: int = 25, seed: int = 1234) -> np.ndarray:
    """k-means of a sample in memory; fewer different rows than k repeat centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[np.arange(k) % len(x)]].astype(float)
    for _ in range(niter):
        at = nearest_rows(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        some = n > 0
        c[some] = sums[some] / n[some, None]
        for e in np.flatnonzero(~some)[: max(0, len(x) - k)]:
            b = int(n.argmax())
            c[e], n[e], n[b] = c[b] * (1 + 1e-3), n[b] // 2, n[b] - n[b] // 2
    return c


def map_vectors(df: DataFrame, f, out: str, kind: str = "double", source: str = "vec") -> DataFrame:
    """``df`` with column ``out`` = f(matrix of ``source``), row by row."""
    names = [c for c in df.columns if c != out]
    kinds = {"double": DoubleType(), "int": IntegerType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = f(matrix(b.column(source)))
                y = lists(y.astype(np.int32 if kind == "int" else np.float64))
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [y], [*names, out])

    return df.mapInArrow(run, StructType([*(df.schema[n] for n in names), StructField(out, ArrayType(kinds[kind]))]))


class Codec:
    """encode: adds ``code``; decode: adds ``vec`` from ``code``."""

    code_bits = 0

    @property
    def code_size(self) -> int:
        return (self.code_bits + 7) // 8

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encode(self, df: DataFrame) -> DataFrame:
        return map_vectors(df, self.encode_matrix, "code", "int")

    def decode(self, df: DataFrame) -> DataFrame:
        return map_vectors(df, lambda c: self.decode_matrix(c.astype(np.int64)), "vec", source="code")

    def search(self, queries: DataFrame, codes: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        """Exact distances of the queries to the decoded rows, top k."""

        def work(qids, x, rows):
            top = TopK(k, metric in V.LARGEST_FIRST)
            for ids, c in rows:
                for s in _chunks(c, max(1, BLOCK // max(1, len(x)))):
                    top.add(self.distances(x, c[s].astype(np.int64), metric), ids[s])
            q, d, i = top.result()
            yield _pairs(qids[q], d, i)

        return rank_pairs(_compare(queries, codes.select("id", F.col("code").cast("array<double>").alias("vec")), work), k, metric)

    def distances(self, x: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        return pairwise(x, self.decode_matrix(codes), metric)

    def list_scorer(self, metric: str, centroids: np.ndarray | None = None):
        """For ``ivf.search``: codes of residuals if ``centroids`` are given."""

        def scorer(x, table, number):
            codes = matrix(table.column("code")).astype(np.int64)
            if centroids is None:
                return self.distances(x, codes, metric)
            if metric == "ip":
                return x @ centroids[number][:, None] + self.distances(x, codes, metric)
            return self.distances(x - centroids[number][None, :], codes, metric)

        return scorer


#: Rows from which quantiles are taken at most.
QUANTILE_ROWS = 200_000


@dataclass
class Identity(Codec):
    """The bits of single-precision components."""

    d: int

    @property
    def code_size(self) -> int:
        return 4 * self.d

    def encode_matrix(self, x):
        return np.ascontiguousarray(x, np.float32).view(np.int32).astype(np.int64)

    def decode_matrix(self, codes):
        return np.ascontiguousarray(codes.astype(np.int32)).view(np.float32).astype(np.float64)


# --- scalar ---------------------------------------------------------------------------

_LEVELS = {"8bit": 255, "6bit": 63, "4bit": 15, "8bit_uniform": 255, "4bit_uniform": 15}
_WIDTH = {"8bit": 8, "6bit": 6, "4bit": 4, "8bit_uniform": 8, "4bit_uniform": 4, "fp16": 16, "8bit_direct": 8}


@dataclass
class ScalarQuantizer(Codec):
    """code = trunc(levels * clamp((x - vmin) / vdiff)), decoded at the middle of its cell;
    a dimension without spread has code 0.  fp16 rounds to half floats; 8bit_direct takes
    components as they are, 0 to 255."""

    kind: str
    vmin: np.ndarray
    vdiff: np.ndarray

    @classmethod
    def train(cls, df: DataFrame, kind: str = "8bit", rule: str = "minmax", arg: float = 0.0) -> ScalarQuantizer:
        """rule: minmax (arg: margin), meanstd (arg: standard deviations), quantiles (arg:
        share cut at each end), optim (least squares)."""
        if kind in ("fp16", "8bit_direct"):
            d = df.select(F.max(F.size("vec"))).first()[0]
            return cls(kind, np.zeros(d), np.ones(d))
        items = df.select(F.posexplode("vec").alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
        group = items.groupBy(F.lit(0).alias("dim") if kind.endswith("uniform") else "dim")
        if rule == "optim":
            x = sample_matrix(df)
            cols = [x.ravel()] if kind.endswith("uniform") else list(x.T)
            lo, hi = np.array([_least_squares_range(c, _LEVELS[kind]) for c in cols]).T
        else:
            if rule == "minmax":
                stats = group.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
            elif rule == "meanstd":
                stats = group.agg((F.avg("x") - arg * F.stddev_pop("x")).alias("lo"), (F.avg("x") + arg * F.stddev_pop("x")).alias("hi"))
            elif rule == "quantiles":
                group = hash_sample(df, QUANTILE_ROWS).select(F.posexplode("vec").alias("dim", "x"))
                group = group.groupBy("dim") if not kind.endswith("uniform") else group.groupBy(F.lit(0).alias("dim"))
                stats = group.agg(F.percentile("x", arg).alias("lo"), F.percentile("x", 1 - arg).alias("hi"))
            else:
                raise ValueError(f"unknown rule {rule!r}")
            rows = sorted(stats.collect(), key=lambda r: r.dim)  # one row per dimension
            lo, hi = np.array([r.lo for r in rows]), np.array([r.hi for r in rows])
            if rule == "minmax":
                lo, hi = lo - (hi - lo) * arg, hi + (hi - lo) * arg
        if kind.endswith("uniform"):
            d = df.select(F.max(F.size("vec"))).first()[0]
            lo, hi = np.repeat(lo, d), np.repeat(hi, d)
        return cls(kind, lo, hi - lo)

    @property
    def code_bits(self) -> int:
        return _WIDTH[self.kind] * len(self.vmin)

    def encode_matrix(self, x):
        if self.kind == "fp16":
            return x.astype(np.float16).view(np.uint16).astype(np.int64)
        if self.kind == "8bit_direct":
            return np.clip(x, 0, 255).astype(np.int64)
        share = np.divide(x - self.vmin, self.vdiff, out=np.zeros_like(x), where=self.vdiff != 0)
        return (np.clip(share, 0, 1) * _LEVELS[self.kind]).astype(np.int64)

    def decode_matrix(self, codes):
        if self.kind == "fp16":
            return codes.astype(np.uint16).view(np.float16).astype(float)
        if self.kind == "8bit_direct":
            return codes.astype(float)
        return (codes + 0.5) / _LEVELS[self.kind] * self.vdiff + self.vmin

    def _ranges(self) -> Column:
        return F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(self.vmin, self.vdiff, strict=True)])

    def encode_column(self, v: Column) -> Column:
        """The code as a built-in expression."""
        top = F.lit(float(_LEVELS[self.kind]))
        cell = lambda x, r: F.when(r["b"] == 0, 0).otherwise((F.least(F.greatest((x - r["a"]) / r["b"], F.lit(0.0)), F.lit(1.0)) * top).cast("int"))
        return F.zip_with(V.doubles(v), self._ranges(), cell)

    def decode_column(self, code: Column) -> Column:
        top = F.lit(float(_LEVELS[self.kind]))
        return F.zip_with(code, self._ranges(), lambda c, r: (c + F.lit(0.5)) / top * r["b"] + r["a"])


def _least_squares_range(x: np.ndarray, levels: int, rounds: int = 100) -> tuple[float, float]:
    """Range that minimises the squared error of the decoded values, by alternating codes
    and a linear fit."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(rounds):
        if hi <= lo:
            break
        code = np.floor(np.clip((x - lo) / (hi - lo), 0, 1) * levels) + 0.5
        var = code.var()
        if not var:
            break
        slope = ((code - code.mean()) * (x - x.mean())).mean() / var
        new = x.mean() - slope * code.mean(), x.mean() + slope * (levels - code.mean())
        if np.allclose(new, (lo, hi)):
            break
        lo, hi = new
    return lo, hi


# --- product --------------------------------------------------------------------------


@dataclass
class ProductQuantizer(Codec):
    """books: (M, ksub, dsub)."""

    books: np.ndarray

    @classmethod
    def train(cls, df: DataFrame, m: int, bits: int = 8, niter: int = 25, seed: int = 1234) -> ProductQuantizer:
        return cls.fit(sample_matrix(df), m, bits, niter, seed)

    @classmethod
    def fit(cls, x: np.ndarray, m: int, bits: int = 8, niter: int = 25, seed: int = 1234) -> ProductQuantizer:
        if x.shape[1] % m:
            raise ValueError(f"{m} sub-vectors do not divide {x.shape[1]} dimensions")
        return cls(np.array([lloyd(part, 1 << bits, niter, seed + i) for i, part in enumerate(np.split(x, m, axis=1))]))

    @property
    def m(self) -> int:
        return len(self.books)

    @property
    def bits(self) -> int:
        return int(self.books.shape[1] - 1).bit_length()

    @property
    def code_bits(self) -> int:
        return self.m * self.bits

    def tables(self, x: np.ndarray, metric: str = "l2") -> np.ndarray:
        """(queries, M, ksub) distances of sub-vectors to sub-centroids."""
        return np.stack([pairwise(part, book, metric) for part, book in zip(np.split(x, self.m, axis=1), self.books, strict=True)], axis=1)

    def encode_matrix(self, x):
        return np.stack([nearest_rows(part, book) for part, book in zip(np.split(x, self.m, axis=1), self.books, strict=True)], axis=1)

    def decode_matrix(self, codes):
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def distances(self, x, codes, metric):
        return lookup_sum(self.tables(x, metric), codes)

    def symmetric_tables(self) -> np.ndarray:
        """(M, ksub, ksub) distances of sub-centroids."""
        return np.array([pairwise(b, b) for b in self.books])

    def symmetric_distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.symmetric_tables()
        return sum(t[m][a[:, m]][:, b[:, m]] for m in range(self.m))

    def search(self, queries, codes, k, metric="l2", kind: str = "pq", ht: int | None = None):
        """kind: pq; sdc (queries coded too); hamming (bits of codes); generalized
        (differing codes); polysemous (pq where Hamming to the query's code < ht)."""
        if kind == "pq":
            return super().search(queries, codes, k, metric)

        def work(qids, x, rows):
            top = TopK(k, False)
            mine = self.encode_matrix(x)
            for all_ids, all_codes, s in ((i, c, s) for i, c in rows for s in _chunks(c, max(1, BLOCK // max(1, mine.size)))):
                ids, c = all_ids[s], all_codes[s].astype(np.int64)
                if kind == "sdc":
                    d = self.symmetric_distances(mine, c)
                elif kind == "generalized":
                    d = (mine[:, None, :] != c[None, :, :]).sum(2).astype(float)
                else:
                    bits = np.bitwise_count(mine[:, None, :] ^ c[None, :, :]).sum(2).astype(float)
                    d = bits if kind == "hamming" else np.where(bits < ht, self.distances(x, c, metric), np.inf)
                top.add(d, ids)
            q, d, i = top.result()
            ok = np.isfinite(d)
            yield _pairs(qids[q[ok]], d[ok], i[ok])

        return rank_pairs(_compare(queries, codes.select("id", F.col("code").cast("array<double>").alias("vec")), work), k, "l2")

    def list_scorer(self, metric, centroids=None, ht: int | None = None):
        """As for any codec; with ``ht``, rows whose code differs from the query's in ht or
        more bits are left out before they are scored."""
        plain = super().list_scorer(metric, centroids)
        if ht is None:
            return plain

        def scorer(x, table, number):
            codes = matrix(table.column("code")).astype(np.int64)
            mine = self.encode_matrix(x if centroids is None else x - centroids[number][None, :])
            bits = np.bitwise_count(mine[:, None, :] ^ codes[None, :, :]).sum(2)
            worst = -np.inf if metric in V.LARGEST_FIRST else np.inf
            return np.where(bits < ht, plain(x, table, number), worst)

        return scorer

    def polysemous(self, rounds: int = 20_000, seed: int = 3) -> ProductQuantizer:
        """Codebooks reordered by simulated annealing so that Hamming distances of codes
        follow distances of centroids."""
        rng, out = np.random.default_rng(seed), []
        ksub = self.books.shape[1]
        ham = np.bitwise_count(np.arange(ksub)[:, None] ^ np.arange(ksub)[None, :]).astype(float)
        for book in self.books:
            d = np.sqrt(pairwise(book, book))
            target = d / max(d.mean(), 1e-12) * ham.mean()
            perm = np.arange(ksub)  # place of each centroid
            row = lambda i, perm=perm, target=target: ((ham[perm[i]][perm] - target[i]) ** 2).sum()
            heat = row(0) / 10
            for _ in range(rounds):
                i, j = rng.integers(ksub, size=2)
                before = row(i) + row(j)
                perm[[i, j]] = perm[[j, i]]
                change = row(i) + row(j) - before
                if change > 0 and rng.random() >= np.exp(-change / max(heat, 1e-9)):
                    perm[[i, j]] = perm[[j, i]]
                heat *= 0.9995
            new = np.empty_like(book)
            new[perm] = book
            out.append(new)
        return ProductQuantizer(np.array(out))


def hamming_histogram(codes: DataFrame) -> DataFrame:
    """(bit, ones, n): how often each bit of each code is set."""
    bits = F.explode(F.transform("code", lambda c: F.bit_count(c)))
    return codes.select(bits.alias("ones")).groupBy("ones").agg(F.count(F.lit(1)).alias("n"))


# --- additive -------------------------------------------------------------------------


@dataclass
class FastScan(ProductQuantizer):
    """Product codes scored by tables of eight bits."""

    def distances(self, x, codes, metric):
        steps, scale, low = quantize_tables(self.tables(x, metric))
        return lookup_sum(steps.astype(np.int64), codes) * scale[:, None] + low[:, None]


@dataclass
class CoarseCodec(Codec):
    """Two-level codes without lists: the number of the nearest centroid, then the code of
    what it leaves.  ``pack`` gives bytes: the list number, lowest byte first, in as few
    bytes as the lists need, then the inner code, one byte or two per number."""

    centroids: np.ndarray
    inner: Codec

    def encode_matrix(self, x):
        at = pairwise(x, self.centroids).argmin(1)
        return np.concatenate((at[:, None], self.inner.encode_matrix(x - self.centroids[at])), 1)

    def decode_matrix(self, codes):
        return self.centroids[codes[:, 0]] + self.inner.decode_matrix(codes[:, 1:])

    @property
    def prefix(self) -> int:
        """Bytes of the list number."""
        return max(1, (int(len(self.centroids) - 1).bit_length() + 7) // 8)

    def pack(self, codes: np.ndarray, width: int = 1) -> list[bytes]:
        head = codes[:, :1].astype("<u8").view(np.uint8)[:, : self.prefix]
        rest = np.ascontiguousarray(codes[:, 1:].astype(f"<u{width}")).view(np.uint8).reshape(len(codes), -1)
        return [row.tobytes() for row in np.concatenate((head, rest), 1)]

    def unpack(self, packed: list[bytes], width: int = 1) -> np.ndarray:
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        head = (raw[:, : self.prefix].astype(np.int64) << (8 * np.arange(self.prefix))).sum(1)
        return np.concatenate((head[:, None], np.ascontiguousarray(raw[:, self.prefix :]).view(f"<u{width}").astype(np.int64)), 1)


@dataclass
class ResidualQuantizer(Codec):
    """Sum of one centroid per stage; encoding keeps the ``beam`` best prefixes."""

    books: list[np.ndarray]
    beam: int = 5

    @classmethod
    def train(cls, df: DataFrame, m: int, bits: int = 8, beam: int = 5, niter: int = 25, seed: int = 1234) -> ResidualQuantizer:
        return cls.fit(sample_matrix(df), m, bits, beam, niter, seed)

    @classmethod
    def fit(cls, x, m, bits=8, beam=5, niter=25, seed=1234) -> ResidualQuantizer:
        books: list[np.ndarray] = []
        rest = x
        for i in range(m):
            books.append(lloyd(rest, 1 << bits, niter, seed + i))
            rq = cls(books, beam)
            rest = x - rq.decode_matrix(rq.encode_matrix(x))
        return cls(books, beam)

    @property
    def code_bits(self) -> int:
        return sum(int(len(b) - 1).bit_length() for b in self.books)

    def encode_matrix(self, x):
        n = len(x)
        codes, rest = np.zeros((n, 1, 0), np.int64), x[:, None, :]
        for book in self.books:
            beams, k = rest.shape[1], len(book)
            d = pairwise(rest.reshape(-1, x.shape[1]), book).reshape(n, beams * k)
            keep = min(self.beam, beams * k)
            best = np.argsort(d, axis=1, kind="stable")[:, :keep]
            src, c = best // k, best % k
            rest = np.take_along_axis(rest, src[:, :, None], 1) - book[c]
            codes = np.concatenate((np.take_along_axis(codes, src[:, :, None], 1), c[:, :, None]), axis=2)
        return codes[:, 0, :]

    def decode_matrix(self, codes):
        return sum(book[codes[:, i]] for i, book in enumerate(self.books))

    def distances(self, x, codes, metric, norms: np.ndarray | None = None):
        """By lookup of inner products; L2 needs the norms of the decoded rows, recomputed
        unless stored ones are given."""
        ipd = sum((x @ book.T)[:, codes[:, i]] for i, book in enumerate(self.books))
        if metric == "ip":
            return ipd
        n = (self.decode_matrix(codes) ** 2).sum(1) if norms is None else norms
        return np.maximum((x * x).sum(1)[:, None] + n[None, :] - 2 * ipd, 0.0)

    def norm_codes(self, norms: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms as codes of a 1-d k-means: (codes, centroids)."""
        from .cluster import kmeans_1d

        c, _ = kmeans_1d(norms, None, 1 << bits)
        return np.abs(norms[:, None] - c[None, :]).argmin(1), c


@dataclass
class LocalSearchQuantizer(ResidualQuantizer):
    """Codebooks by least squares; codes by rounds of conditional modes from perturbed
    starts, keeping the better."""

    rounds: int = 4
    perturb: int = 2
    seed: int = 9

    @classmethod
    def fit(cls, x, m, bits=8, beam=5, niter=10, seed=1234, train_rounds=8) -> LocalSearchQuantizer:
        lsq = cls(ResidualQuantizer.fit(x, m, bits, 1, niter, seed).books, 1)
        k = 1 << bits
        for _ in range(train_rounds):
            codes = lsq.encode_matrix(x)
            flat = codes + np.arange(m)[None, :] * k
            gram, right = np.zeros((m * k, m * k)), np.zeros((m * k, x.shape[1]))
            for i in range(m):
                np.add.at(right, flat[:, i], x)
                for j in range(m):
                    np.add.at(gram, (flat[:, i], flat[:, j]), 1.0)
            solved = np.linalg.solve(gram + 1e-3 * np.eye(m * k), right)
            lsq = cls(list(solved.reshape(m, k, -1)), 1)
        return lsq

    def encode_matrix(self, x):
        rng = np.random.default_rng(self.seed)
        best = ResidualQuantizer(self.books, max(self.beam, 1)).encode_matrix(x)
        error = ((x - self.decode_matrix(best)) ** 2).sum(1)
        codes = best.copy()
        for r in range(self.rounds):
            if r:
                codes = best.copy()
                for _ in range(self.perturb):
                    col = rng.integers(len(self.books), size=len(x))
                    codes[np.arange(len(x)), col] = rng.integers(len(self.books[0]), size=len(x))
            for i, book in enumerate(self.books):
                rest = x - self.decode_matrix(codes) + book[codes[:, i]]
                codes[:, i] = pairwise(rest, book).argmin(1)
            new = ((x - self.decode_matrix(codes)) ** 2).sum(1)
            better = new < error
            best[better], error[better] = codes[better], new[better]
        return best


@dataclass
class LatticeCodec(Codec):
    """Each sub-vector is a norm (scalar code) and the nearest vertex among the integer
    points of squared length r2; the vertex is stored as its components."""

    m: int
    r2: int
    norm_bits: int
    lo: float
    hi: float
    d: int

    @classmethod
    def train(cls, df: DataFrame, m: int, r2: int, norm_bits: int) -> LatticeCodec:
        x = sample_matrix(df)
        n = np.sqrt((x.reshape(len(x), m, -1) ** 2).sum(2))
        return cls(m, r2, norm_bits, float(n.min()), float(n.max()), x.shape[1])

    def _vertex(self, x: np.ndarray) -> np.ndarray:
        """The integer point of squared length r2 with the largest inner product: over all
        sorted decompositions, large components meet large components."""
        order = np.argsort(-np.abs(x), axis=1, kind="stable")
        top = np.take_along_axis(np.abs(x), order, 1)
        forms = np.array(list(_decompositions(self.r2, x.shape[1], self.r2)), float)
        best = forms[(top @ forms.T).argmax(1)]
        out = np.zeros_like(x)
        np.put_along_axis(out, order, best, 1)
        return np.where(x < 0, -out, out)

    def encode_matrix(self, x):
        parts = x.reshape(len(x) * self.m, -1)
        n = np.sqrt((parts**2).sum(1))
        top = (1 << self.norm_bits) - 1
        code = np.clip((n - self.lo) / max(self.hi - self.lo, 1e-12) * (top + 1), 0, top).astype(np.int64)
        return np.concatenate((code[:, None], self._vertex(parts).astype(np.int64)), axis=1).reshape(len(x), -1)

    def decode_matrix(self, codes):
        parts = codes.reshape(len(codes) * self.m, -1)
        n = (parts[:, 0] + 0.5) / (1 << self.norm_bits) * (self.hi - self.lo) + self.lo
        return (parts[:, 1:] / np.sqrt(self.r2) * n[:, None]).reshape(len(codes), -1)


def _decompositions(rest: int, n: int, most: int):
    """Non-increasing n-tuples of non-negative integers with the given sum of squares."""
    if n == 0:
        if rest == 0:
            yield ()
        return
    for a in range(min(int(rest**0.5), most), -1, -1):
        if a * a * n < rest:
            break
        for tail in _decompositions(rest - a * a, n - 1, a):
            yield (a, *tail)


# --- sign bits ------------------------------------------------------------------------


def median_thresholds(df: DataFrame) -> list[float]:
    """Per-dimension medians, exact up to QUANTILE_ROWS rows and of as many beyond."""
    rows = hash_sample(df, QUANTILE_ROWS).select(F.posexplode("vec").alias("dim", "x"))
    rows = rows.groupBy("dim").agg(F.percentile("x", 0.5).alias("t")).collect()  # d rows
    return [r.t for r in sorted(rows, key=lambda r: r.dim)]


def lsh_bits(v: Column, thresholds: list[float] | None = None) -> Column:
    """Bits x >= threshold (0 by default)."""
    if thresholds is None:
        return V.sign_bits(v)
    return F.zip_with(V.doubles(v), F.array(*[F.lit(float(t)) for t in thresholds]), lambda x, t: F.when(x >= t, 1).otherwise(0))


def spectral_bits(v: Column, centre: Column, period: float) -> Column:
    """floor((x - c) * 2 / period) & 1 by component."""
    return F.zip_with(V.doubles(v), V.doubles(centre), lambda x, c: F.pmod(F.floor((x - c) * F.lit(2.0 / period)), F.lit(2)).cast("int"))


# --- bytes and sizes ------------------------------------------------------------------


def pack(df: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``bytes``, the packed ``code``."""
    names = [c for c in df.columns if c != "bytes"]
    from pyspark.sql.types import BinaryType

    def run(batches):
        for b in batches:
            if b.num_rows:
                packed = pack_codes(matrix(b.column("code")).astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array([r.tobytes() for r in packed], pa.binary())], [*names, "bytes"])

    return df.mapInArrow(run, StructType([*(df.schema[n] for n in names), StructField("bytes", BinaryType())]))


def code_size(spec: str, d: int) -> int:
    """Bytes per vector of a code given as in a specification string."""
    if spec == "Flat":
        return 4 * d
    if m := re.fullmatch(r"SQ(4|6|8|fp16)", spec):
        return (d * {"4": 4, "6": 6, "8": 8, "fp16": 16}[m[1]] + 7) // 8
    if m := re.fullmatch(r"PQ(\d+)(?:x(\d+))?(?:fsr?|fs)?(?:_\d+)?(?:np)?", spec):
        return (int(m[1]) * int(m[2] or 8) + 7) // 8
    if m := re.fullmatch(r"PQ(\d+)\+(\d+)", spec):
        return int(m[1]) + int(m[2])
    if m := re.fullmatch(r"LSHr?t?", spec):
        return (d + 7) // 8
    if m := re.fullmatch(r"(?:RQ|LSQ)(\d+)x(\d+)(?:_N\w+)?", spec):
        return (int(m[1]) * int(m[2]) + 7) // 8
    raise ValueError(f"no code size for {spec!r}")


@dataclass
class SignCodec(Codec):
    """Locality-sensitive signs: an optional rotation to ``bits`` dimensions, bits x >=
    threshold (0, or the medians of the training rows); distances are Hamming."""

    matrix: np.ndarray | None
    thresholds: np.ndarray

    @classmethod
    def train(cls, df: DataFrame, bits: int | None = None, rotate: bool = False, medians: bool = False, seed: int = 5) -> SignCodec:
        from .transforms import random_rotation

        x = sample_matrix(df)
        d, bits = x.shape[1], bits or x.shape[1]
        m = random_rotation(d, bits, seed).a if rotate or bits != d else None
        y = x if m is None else x @ m.T
        return cls(m, np.median(y, axis=0) if medians else np.zeros(bits))

    @property
    def code_bits(self) -> int:
        return len(self.thresholds)

    def encode_matrix(self, x):
        y = x if self.matrix is None else x @ self.matrix.T
        return (y >= self.thresholds).astype(np.int64)

    def decode_matrix(self, codes):
        y = np.where(codes > 0, 1.0, -1.0) + self.thresholds
        return y if self.matrix is None else y @ self.matrix

    def distances(self, x, codes, metric):
        a, b = self.encode_matrix(x), codes
        return (a @ (1 - b).T + (1 - a) @ b.T).astype(float)


@dataclass
class SpectralCodec(Codec):
    """Bits floor((y - c) * 2 / period) & 1 of transformed vectors y, against thresholds c
    of the row's list: its centroid (c), a quarter period off it (h), its median (m), or 0
    for all lists (g).  Rows are encoded with their list_no; distances are Hamming."""

    transform: object
    period: float
    thresholds: np.ndarray  # (lists, bits)

    @classmethod
    def train(cls, df: DataFrame, transform, centroids: np.ndarray, period: float, kind: str = "c") -> SpectralCodec:
        y = transform.apply_matrix(centroids)
        if kind == "g":
            y = np.zeros_like(y)
        elif kind == "h":
            y = y - period / 4
        elif kind == "m":
            x = sample_matrix(df)
            at, rows = pairwise(x, centroids).argmin(1), transform.apply_matrix(x)
            y = np.array([np.median(rows[at == i], axis=0) if (at == i).any() else y[i] for i in range(len(y))])
        return cls(transform, period, y)

    @property
    def code_bits(self) -> int:
        return self.thresholds.shape[1]

    def bits(self, x: np.ndarray, lists_of: np.ndarray) -> np.ndarray:
        return np.floor((self.transform.apply_matrix(x) - self.thresholds[lists_of]) * (2.0 / self.period)).astype(np.int64) & 1

    def encode(self, df: DataFrame) -> DataFrame:
        tagged = df.withColumn("_row", F.concat(F.array(F.col("list_no").cast("double")), V.doubles(F.col("vec"))))
        return map_vectors(tagged, lambda m: self.bits(m[:, 1:], m[:, 0].astype(np.int64)), "code", "int", source="_row").drop("_row")

    def list_scorer(self, metric, centroids=None):
        def scorer(x, table, number):
            a = self.bits(x, np.full(len(x), number))
            b = matrix(table.column("code")).astype(np.int64)
            return (a @ (1 - b).T + (1 - a) @ b.T).astype(float)

        return scorer


@dataclass
class RefinedCodec(Codec):
    """A code and a second code of what the first leaves; decoded from both."""

    first: Codec
    second: Codec
    split: int

    @classmethod
    def train(cls, df: DataFrame, m: int, m2: int, bits: int = 8) -> RefinedCodec:
        x = sample_matrix(df)
        first = ProductQuantizer.fit(x, m, bits)
        return cls(first, ProductQuantizer.fit(x - first.decode_matrix(first.encode_matrix(x)), m2, bits), m)

    @property
    def code_bits(self) -> int:
        return self.first.code_bits + self.second.code_bits

    def encode_matrix(self, x):
        a = self.first.encode_matrix(x)
        return np.concatenate((a, self.second.encode_matrix(x - self.first.decode_matrix(a))), axis=1)

    def decode_matrix(self, codes):
        return self.first.decode_matrix(codes[:, : self.split]) + self.second.decode_matrix(codes[:, self.split :])
