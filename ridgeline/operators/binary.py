"""Binary vectors: ``code array<bigint>`` of 64-bit words, Hamming distance.

Exact joins stream the database past a broadcast query block (counted first; larger query
sides are dealt in blocks); hash indexes are equi-joins on buckets, verified after."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.kernels import BLOCK, TopK
from . import ivf
from .knn import _chunks, _compare, _pairs, knn, rank_pairs


def _words(x: np.ndarray) -> np.ndarray:
    """Words that went through doubles as 32-bit halves."""
    return x.astype(np.uint64)


def _halves(df: DataFrame, name: str) -> DataFrame:
    """(name, vec): each 64-bit word as two exact doubles."""
    low = lambda w: w.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    both = F.flatten(F.transform("code", lambda w: F.array(low(w), low(F.shiftrightunsigned(w, 32)))))
    return df.select(name, both.cast("array<double>").alias("vec"))


def hamming_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j][:, None] ^ b[:, j][None, :])
    return out


def hamming_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    def work(qids, x, rows):
        top, x = TopK(k, False), _words(x)
        for ids, y in rows:
            for s in _chunks(y, max(1, BLOCK // max(1, len(x)))):
                top.add(hamming_matrix(x, _words(y[s])), ids[s])
        q, d, i = top.result()
        yield _pairs(qids[q], d, i)

    out = rank_pairs(_compare(_halves(queries, "qid"), _halves(base, "id"), work), k, "l2")
    return out.withColumn("distance", F.col("distance").cast("int"))


def hamming_range(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """Pairs with distance < radius."""

    def work(qids, x, rows):
        x = _words(x)
        for ids, y in rows:
            for s in _chunks(y, max(1, BLOCK // max(1, len(x)))):
                d = hamming_matrix(x, _words(y[s]))
                q, i = np.nonzero(d < radius)
                yield _pairs(qids[q], d[q, i], ids[s][i])

    return _compare(_halves(queries, "qid"), _halves(base, "id"), work).withColumn("distance", F.col("distance").cast("int"))


def hamming_count(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """(n): pairs below the radius, without keeping them."""
    return hamming_range(queries, base, radius).agg(F.count(F.lit(1)).alias("n"))


def bucket(code: Column, at: int, b: int) -> Column:
    """Bits [at, at + b) of the code as a number; b at most 62."""
    mask = F.lit((1 << b) - 1).cast("long")
    first, shift = divmod(at, 64)
    low = F.shiftrightunsigned(F.get(code, F.lit(first)), shift)
    if shift + b > 64:
        low = low.bitwiseOR(F.shiftleft(F.get(code, F.lit(first + 1)), 64 - shift))
    return low.bitwiseAND(mask)


def flip_masks(b: int, nflip: int) -> list[int]:
    """All numbers of b bits with at most nflip bits set."""
    return [sum(1 << i for i in bits) for n in range(nflip + 1) for bits in combinations(range(b), n)]


def hash_candidates(queries: DataFrame, base: DataFrame, b: int, nflip: int = 0, nhash: int = 1) -> DataFrame:
    """(qid, id, distance) of pairs that share a bucket within nflip flips in at least one
    of nhash disjoint groups of b bits; each pair once."""
    masks = F.array(*[F.lit(m).cast("long") for m in flip_masks(b, nflip)])
    parts = []
    for h in range(nhash):
        own = bucket(F.col("code"), h * b, b)
        asked = queries.select("qid", F.col("code").alias("qc"), F.explode(masks).alias("mask"), own.alias("own"))
        asked = asked.select("qid", "qc", F.col("own").bitwiseXOR(F.col("mask")).alias("bucket"))
        stored = base.select("id", "code", bucket(F.col("code"), h * b, b).alias("bucket"))
        parts.append(asked.join(stored, "bucket").select("qid", "id", "qc", "code"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select("qid", "id", V.hamming(F.col("qc"), F.col("code")).alias("distance"))
    return out.distinct() if nhash > 1 else out


def hash_knn(queries, base, k: int, b: int, nflip: int = 0, nhash: int = 1) -> DataFrame:
    return rank_pairs(hash_candidates(queries, base, b, nflip, nhash), k, "l2")


def hash_range(queries, base, radius: int, b: int, nflip: int = 0, nhash: int = 1) -> DataFrame:
    return hash_candidates(queries, base, b, nflip, nhash).filter(F.col("distance") < radius)


def to_real(df: DataFrame, d: int) -> DataFrame:
    """``df`` with vec of -1/+1 from the code's first d bits."""
    bit = "shiftrightunsigned(code[cast(i div 64 as int)], cast(i % 64 as int)) & 1L"
    return df.withColumn("vec", F.expr(f"transform(sequence(0, {d - 1}), i -> 2D * ({bit}) - 1D)"))


def knn_by_real(queries: DataFrame, base: DataFrame, k: int, d: int) -> DataFrame:
    """Hamming neighbours through a float search: L2 / 4 of -1/+1 vectors."""
    out = knn(to_real(queries, d).select("qid", "vec"), to_real(base, d).select("id", "vec"), k)
    return out.withColumn("distance", F.round(F.col("distance") / 4).cast("int"))


def binary_ivf_search(queries: DataFrame, base: DataFrame, d: int, nlist: int, nprobe: int, k: int | None, radius: float | None = None, seed: int = 1234) -> DataFrame:
    """Inverted lists by k-means in -1/+1 space; distances in bits."""
    rows, asked = to_real(base, d).select("id", "vec"), to_real(queries, d).select("qid", "vec")
    centroids = ivf.train(rows, nlist, seed=seed)
    postings = ivf.add(rows, centroids)
    out = ivf.search(asked, postings, ivf.probe(asked, centroids, nprobe), k, radius=None if radius is None else 4.0 * radius)
    return out.withColumn("distance", F.round(F.col("distance") / 4).cast("int"))
