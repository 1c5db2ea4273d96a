"""k-means and its relatives.

The state is k centroids (small, bounded by k x d) on the driver; a round is one pass:
tasks assign their rows by matrix products and emit k partial sums each, which are added
up by a tree of partial aggregations.  Rows never move.  Sampling is by hash of the id,
so it is repeatable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import lists, matrix, pairwise, unit

EPS = 1 / 1024


@dataclass
class KMeans:
    centroids: np.ndarray
    objective: float
    stats: list[dict] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """(list_no, vec)"""
        return centroid_table(spark, self.centroids)


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "list_no int, vec array<double>")


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(list numbers, matrix) of a centroid table, by list number."""
    rows = centroids.select("list_no", "vec").orderBy("list_no").toArrow()
    return np.asarray(rows.column("list_no").combine_chunks()), matrix(rows.column("vec"))


def hash_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n rows, the same ones every time: those of the smallest hashes.  Few more
    than n pass a bound on the hash, so no task sorts or merges all rows."""
    share = min(1.0, (1.2 * n + 100) / max(df.count(), 1))
    if share < 1.0:
        df = df.filter(F.xxhash64(F.col("id"), F.lit(seed)) < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return df.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(n)


def nearest(centroids: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    d = pairwise(x, centroids, metric)
    at = d.argmax(1) if metric in ("ip", "cosine") else d.argmin(1)
    return at, d[np.arange(len(x)), at]


def assign_lists(df: DataFrame, centroids: np.ndarray, metric: str = "l2", numbers: np.ndarray | None = None) -> DataFrame:
    """``df`` with list_no and centroid_distance (nearest centroid, ties to the first)."""
    shared = df.sparkSession.sparkContext.broadcast((centroids, np.arange(len(centroids)) if numbers is None else numbers))
    names = [c for c in df.columns if c not in ("list_no", "centroid_distance")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, number = shared.value
        for b in batches:
            if b.num_rows:
                at, d = nearest(c, matrix(b.column("vec")), metric)
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(number[at].astype(np.int32)), pa.array(d)], [*names, "list_no", "centroid_distance"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*(df.schema[n] for n in names), StructField("list_no", IntegerType()), StructField("centroid_distance", DoubleType())])
    return df.mapInArrow(run, schema)


def _sums(df: DataFrame, centroids: np.ndarray, metric: str, weighted: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, weights, objective) of one assignment."""
    k, d = centroids.shape
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, weights, objective = np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec"))
            w = np.asarray(b.column("weight"), np.float64) if weighted else np.ones(len(x))
            at, dist = nearest(c, x, metric)
            np.add.at(sums, at, x * w[:, None])
            weights += np.bincount(at, w, k)
            objective += np.bincount(at, dist * w, k)
        some = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists(np.column_stack((weights[some], objective[some], sums[some])))], ["k", "sums"])

    parts = df.select("vec", *(["weight"] if weighted else [])).mapInArrow(run, "k int, sums array<double>")
    total = parts.select("k", F.posexplode("sums")).groupBy("k", "pos").agg(F.sum("col").alias("s")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("s"))
    sums, weights, objective = np.zeros((k, d)), np.zeros(k), 0.0
    for r in total.collect():  # k rows
        row = [x.s for x in r.s]
        weights[r.k], sums[r.k] = row[0], row[2:]
        objective += row[1]
    return sums, weights, objective


def split_empty(centroids: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> int:
    """Give each empty cluster half of a large one, chosen with probability growing with
    its size; the two centroids are moved apart by alternating small factors."""
    n = 0
    for e in np.flatnonzero(weights == 0):
        chance = np.maximum(weights - 1, 0)
        if not chance.sum():
            break
        b = int(rng.choice(len(weights), p=chance / chance.sum()))
        factor = np.where(np.arange(centroids.shape[1]) % 2 == 0, EPS, -EPS)
        centroids[e] = centroids[b] * (1 + factor)
        centroids[b] = centroids[b] * (1 - factor)
        weights[e] = weights[b] / 2
        weights[b] -= weights[e]
        n += 1
    return n


def kmeans(
    df: DataFrame,
    k: int,
    niter: int = 25,
    nredo: int = 1,
    metric: str = "l2",
    spherical: bool = False,
    integer: bool = False,
    weighted: bool = False,
    init: np.ndarray | None = None,
    frozen: bool = False,
    seed: int = 1234,
    max_points_per_centroid: int | None = 256,
) -> KMeans:
    """Lloyd's algorithm over (id, vec[, weight]).  ``init``: first centroids, the rest are
    sampled rows; ``frozen``: those never move.  Trains on at most
    ``max_points_per_centroid`` x k rows, chosen by hash (None: on all rows)."""
    spark = df.sparkSession
    if max_points_per_centroid and df.count() > max_points_per_centroid * k:
        df = hash_sample(df, max_points_per_centroid * k, seed)
    df = df.persist()
    tidy = lambda c: np.rint(c) if integer else unit(c) if spherical else c
    best: KMeans | None = None
    fixed = 0 if init is None else len(init)
    try:
        for redo in range(nredo):
            rows = hash_sample(df, k - fixed, seed + 1 + redo).select("vec").collect() if k > fixed else []
            parts = ([np.asarray(init, float)] if fixed else []) + ([np.array([r.vec for r in rows], float)] if rows else [])
            if sum(map(len, parts)) < k:
                raise ValueError(f"{k} centroids need as many rows")
            centroids, stats, rng = tidy(np.concatenate(parts)), [], np.random.default_rng(seed + redo)
            for it in range(niter):
                sums, weights, objective = _sums(df, centroids, metric, weighted)
                new = np.divide(sums, weights[:, None], out=np.zeros_like(sums), where=weights[:, None] > 0)
                if frozen and fixed:
                    new[:fixed] = centroids[:fixed]
                imbalance = len(weights) * float((weights**2).sum()) / float(weights.sum()) ** 2
                live = weights.copy()
                if frozen and fixed:
                    live[:fixed] = np.maximum(live[:fixed], 1)
                nsplit = split_empty(new, live, rng)
                if frozen and fixed:
                    new[:fixed] = centroids[:fixed]
                centroids = tidy(new)
                stats.append({"iteration": it, "objective": objective, "imbalance": imbalance, "nsplit": nsplit})
            objective = stats[-1]["objective"] if stats else 0.0
            better = best is None or (objective > best.objective if metric in ("ip", "cosine") else objective < best.objective)
            if better:
                best = KMeans(centroids, objective, stats)
    finally:
        df.unpersist()
    assert best is not None and spark is not None
    return best


def kmeans_by(df: DataFrame, k: int, assign, niter: int = 10, seed: int = 1234) -> np.ndarray:
    """Centroids by any assignment: ``assign(df, centroids)`` gives (list_no, vec) rows, by
    an index over the centroids for instance.  Empty clusters take half of a large one."""
    rows = hash_sample(df, k, seed + 1).select("vec").collect()  # k rows
    centroids, rng = np.array([r.vec for r in rows], float), np.random.default_rng(seed)
    for _ in range(niter):
        assigned = assign(df, centroids)
        new, weights = centroids.copy(), np.zeros(k)
        for r in centroid_means(assigned.select("list_no", "vec")).collect():  # k x d rows
            new[r.list_no, r.dim], weights[r.list_no] = r.mean, r.n
        split_empty(new, weights, rng)
        centroids = new
    return centroids


def kmeans_encoded(codec, codes: DataFrame, k: int, **settings) -> KMeans:
    """k-means over the decoded rows of (id, code), which are decoded batch by batch."""
    return kmeans(codec.decode(codes).select("id", "vec"), k, **settings)


def progressive_kmeans(df: DataFrame, k: int, steps: int = 4, niter: int = 10, seed: int = 1234) -> KMeans:
    """k-means on growing prefixes of the vectors, each started from the last."""
    d = df.select(F.max(F.size("vec"))).first()[0]
    best = None
    for s in range(1, steps + 1):
        width = max(1, round(d ** (s / steps)))
        part = df.withColumn("vec", F.slice("vec", 1, width))
        start = None
        if best is not None:  # the new dimensions start from the means of the old clusters
            labelled = assign_lists(df.withColumn("full", F.slice("vec", 1, width)).withColumn("vec", F.slice("vec", 1, best.centroids.shape[1])), best.centroids)
            start = update(labelled.drop("vec").withColumnRenamed("full", "vec"), k, width)
        best = kmeans(part, k, niter=niter, init=start, seed=seed)
    return best


def update(assigned: DataFrame, k: int, d: int) -> np.ndarray:
    """Means by list_no as a matrix (zero for empty lists)."""
    out = np.zeros((k, d))
    for r in centroid_means(assigned).collect():  # k x d rows
        out[r.list_no, r.dim] = r.mean
    return out


def centroid_means(assigned: DataFrame) -> DataFrame:
    """(list_no, dim, mean, n): the update step in SQL; dim from 0."""
    return assigned.select("list_no", F.posexplode("vec").alias("dim", "x")).groupBy("list_no", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


#: Different values that go to the driver at most; beyond, values are binned.
MOST_VALUES = 200_000


def weighted_values(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a column with their counts; of more than MOST_VALUES, the means
    and counts of as many equal bins, so that what the driver holds is bounded."""
    rows = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    if counted.count() > MOST_VALUES:
        lo, hi = rows.agg(F.min("x"), F.max("x")).first()
        place = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * F.lit(MOST_VALUES)), F.lit(MOST_VALUES - 1))
        counted = rows.groupBy(place.alias("b")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    got = counted.select("x", "n").toArrow()  # at most MOST_VALUES rows
    return np.asarray(got.column("x").combine_chunks()), np.asarray(got.column("n").combine_chunks())


def kmeans_1d(values: np.ndarray, weights: np.ndarray | None, k: int) -> tuple[np.ndarray, float]:
    """Optimal centroids of weighted scalars (dynamic programming over the sorted values,
    divide and conquer on the monotone split) and the sum of squares."""
    order = np.argsort(np.asarray(values, float), kind="stable")
    x = np.asarray(values, float)[order]
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)[order]
    n = len(x)
    s0, s1, s2 = (np.concatenate(([0.0], np.cumsum(v))) for v in (w, w * x, w * x * x))

    def cost(i, j):  # of x[i:j]
        return s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / np.maximum(s0[j] - s0[i], 1e-300)

    best = cost(np.zeros(n + 1, int), np.arange(n + 1))
    splits = []
    for _ in range(1, min(k, n)):
        new, split = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        todo = [(0, n, 0, n)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid, b) + 1)
            c = best[i] + cost(i, np.full(len(i), mid))
            at = int(i[c.argmin()])
            new[mid], split[mid] = c.min(), at
            todo += [(lo, mid - 1, a, at), (mid + 1, hi, at, b)]
        best = new
        splits.append(split)
    ends = [n]
    for split in reversed(splits):
        ends.append(int(split[ends[-1]]))
    ends = sorted({0, *ends})
    means = [float((w[a:b] * x[a:b]).sum() / w[a:b].sum()) for a, b in zip(ends, ends[1:], strict=False)]
    return np.array(means), float(max(best[n], 0.0))
