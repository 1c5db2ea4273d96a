"""Exact nearest-neighbour and radius joins.

Schemas: queries (qid, vec), database (id, vec, ...), neighbours (qid, rank, id,
distance), radius result (qid, id, distance).  Ties go by id; fewer than k rows give
fewer neighbours; rows without a vector take no part.

Two physical forms.  A query side of at most ``BROADCAST_BYTES`` (it is counted first) is
sent to all tasks, which stream the database once through matrix products and keep a
running top-k, so that a task emits k rows per query.  A larger query side is dealt into
blocks of queries against blocks of rows, each pair of blocks one task, with the same
top-k in the task; its cost is that of the comparison itself, and no task holds more than
two blocks.  Both end in a top-k by query over the tasks' results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.kernels import TopK, matrix, pairwise
from ..session import scratch
from .ordering import global_rank, running_total, slice_of

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 50_000

_PAIRS = "qid long, id long, distance double"


def vectors(df: DataFrame, id_col: str, vec_col: str, as_id: str = "id") -> DataFrame:
    """(id, vec) of the rows that have both.  Vectors with null or NaN components stay; a
    distance that is NaN never ranks."""
    out = df.select(F.col(id_col).cast("long").alias(as_id), F.col(vec_col).alias("vec"))
    return out.filter(F.col(as_id).isNotNull() & F.col("vec").isNotNull())


def _pairs(q: np.ndarray, d: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(i)], ["qid", "distance", "id"]).select(["qid", "id", "distance"])


def _chunks(x: np.ndarray, size: int) -> Iterator[slice]:
    for a in range(0, len(x), size):
        yield slice(a, a + size)


def rank_pairs(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """Top k per query of (qid, id, distance), ranked from 1."""
    w = W.partitionBy("qid").orderBy(V.best_first(metric, F.col("distance")), F.col("id"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def fits_broadcast(queries: DataFrame) -> bool:
    """Whether the query matrix is at most BROADCAST_BYTES; counted, not guessed."""
    n, d = queries.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    return n * (d or 0) * 8 <= BROADCAST_BYTES


def _query_matrix(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = queries.select("qid", "vec").toArrow()
    return np.asarray(table.column("qid").combine_chunks(), dtype=np.int64), matrix(table.column("vec"))


def _compare(queries: DataFrame, base: DataFrame, work, row_block: int = BLOCK_ROWS) -> DataFrame:
    """Pairs from ``work(qids, query matrix, iterator of (ids, row matrix))``."""
    spark = base.sparkSession
    if fits_broadcast(queries):
        shared = spark.sparkContext.broadcast(_query_matrix(queries))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, x = shared.value
            rows = ((np.asarray(b.column("id")), matrix(b.column("vec"))) for b in batches if b.num_rows)
            yield from work(qids, x, rows) if len(qids) else ()

        return base.select("id", "vec").mapInArrow(run, _PAIRS)
    nq, nb = (max(1, math.ceil(df.count() / row_block)) for df in (queries, base))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = base.select("id", "vec").withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(nb))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    left, right = (df.withColumn("qb", F.col("qb").cast("long")).withColumn("bb", F.col("bb").cast("long")) for df in (left, right))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([_pairs(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))])
        rows = [(np.asarray(b.column("id").combine_chunks()), matrix(b.column("vec")))]
        return pa.Table.from_batches(list(work(np.asarray(a.column("qid").combine_chunks()), matrix(a.column("vec")), iter(rows))))

    return left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(both, _PAIRS)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", p: float | None = None, exclude_self: bool = False) -> DataFrame:
    """The k best rows of ``base`` for each query."""
    largest = metric in V.LARGEST_FIRST

    def work(qids, x, rows):
        top = TopK(k, largest)
        for ids, y in rows:
            for s in _chunks(y, max(1, (1 << 22) // max(1, len(x)))):
                d = pairwise(x, y[s], metric, p)
                if exclude_self:
                    d = np.where(qids[:, None] == ids[s][None, :], -np.inf if largest else np.inf, d)
                top.add(d, ids[s])
        q, d, i = top.result()
        keep = np.isfinite(d) if exclude_self else slice(None)
        yield _pairs(qids[q[keep]], d[keep], i[keep])

    return rank_pairs(_compare(queries, base, work), k, metric)


def knn_expression(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", p: float | None = None) -> DataFrame:
    """``knn`` in built-in expressions only: the stated queries, counted to be few and
    broadcast, against all rows.  Many queries take the blocks of ``knn``."""
    if not fits_broadcast(queries):
        return knn(queries, base, k, metric, p)
    pairs = base.select("id", F.col("vec").alias("bv")).join(F.broadcast(queries.select("qid", "vec")))
    return rank_pairs(pairs.select("qid", "id", V.distance(metric, F.col("vec"), F.col("bv"), p).alias("distance")), k, metric)


def range_join(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", p: float | None = None) -> DataFrame:
    """Pairs strictly inside the radius: distance < radius, or > for similarities."""

    def work(qids, x, rows):
        for ids, y in rows:
            for s in _chunks(y, max(1, (1 << 22) // max(1, len(x)))):
                d = pairwise(x, y[s], metric, p)
                q, i = np.nonzero(d > radius if metric in V.LARGEST_FIRST else d < radius)
                yield _pairs(qids[q], d[q, i], ids[s][i])

    return _compare(queries, base, work)


def range_budget(pairs: DataFrame, max_results: int, min_results: int | None = None, metric: str = "l2") -> DataFrame:
    """If there are more than ``max_results`` pairs, only those strictly better than the
    (min_results + 1)-th best distance; min_results defaults to 0.8 of the maximum."""
    least = int(0.8 * max_results) if min_results is None else min_results
    pairs = _stored(pairs)
    if pairs.count() <= max_results:
        return pairs
    return filter_radius(pairs, nth_distance(pairs, least, metric), metric)


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "pairs")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nth_distance(pairs: DataFrame, place: int, metric: str = "l2") -> float:
    """The distance at a place, from 0, in the order from best to worst; slices are ordered
    apart, so no task holds all pairs before it."""
    order = -F.col("distance") if metric in V.LARGEST_FIRST else F.col("distance")
    ranked = global_rank(pairs.select(order.alias("o")), "o")
    value = ranked.filter(F.col("place") == place).first()[0]
    return -value if metric in V.LARGEST_FIRST else value


def range_by_topk(queries: DataFrame, base: DataFrame, radius: float, k: int, metric: str = "l2") -> DataFrame:
    """A radius join by a top-k search: queries whose k-th neighbour is still inside the
    radius may have more, and only those are joined by radius."""
    found = _stored(knn(queries, base, k, metric))
    worst = F.min("distance") if metric in V.LARGEST_FIRST else F.max("distance")
    inside = (lambda c: c > radius) if metric in V.LARGEST_FIRST else (lambda c: c < radius)
    full = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), worst.alias("worst")).filter((F.col("n") >= k) & inside(F.col("worst")))
    full = _stored(full.select("qid"))
    few = found.join(full, "qid", "left_anti").select("qid", "id", "distance").filter(inside(F.col("distance")))
    return few.unionByName(range_join(queries.join(full, "qid", "left_semi"), base, radius, metric))


def range_in_blocks(queries: DataFrame, base: DataFrame, radius: float, max_results: int, metric: str = "l2", first: int = 32) -> tuple[DataFrame, float]:
    """(pairs, radius) for blocks of queries, each block twice as large as the last.  As soon
    as the results pass ``max_results`` the radius shrinks to leave 0.8 of them, for what was
    found and for all later blocks, so that results never pile up."""
    numbered = _stored(global_rank(queries, "qid"))
    n, at, size, out = numbered.count(), 0, first, None
    while at < n:
        block = numbered.filter((F.col("place") >= at) & (F.col("place") < at + size)).select("qid", "vec")
        found = range_join(block, base, radius, metric)
        out = _stored(found if out is None else out.unionByName(found))
        if out.count() > max_results:
            radius = nth_distance(out, int(0.8 * max_results), metric)
            out = filter_radius(out, radius, metric)
        at, size = at + size, 2 * size
    return (out if out is not None else range_join(queries, base, radius, metric)), radius


def filter_radius(pairs: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """A radius result cut to a tighter radius."""
    return pairs.filter(F.col("distance") > radius if metric in V.LARGEST_FIRST else F.col("distance") < radius)


def range_counts(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, n, lims): results per query and running totals in the order of qid."""
    n = queries.select("qid").join(pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").fillna(0, ["n"])
    return running_total(n, "qid", F.col("n"), "lims")


def assign(queries: DataFrame, base: DataFrame, k: int = 1, metric: str = "l2") -> DataFrame:
    """Labels only."""
    return knn(queries, base, k, metric).select("qid", "rank", "id")


def knn_graph(base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """k nearest other rows of every row."""
    return knn(base.select(F.col("id").alias("qid"), "vec"), base, k, metric, exclude_self=True)


def pair_distances(pairs: DataFrame, left: DataFrame, right: DataFrame, metric: str = "l2", p: float | None = None) -> DataFrame:
    """Distances of listed (qid, id) pairs: two equi-joins."""
    rows = pairs.join(left.select("qid", F.col("vec").alias("qv")), "qid").join(right.select("id", F.col("vec").alias("bv")), "id")
    return rows.select("qid", "id", V.distance(metric, F.col("qv"), F.col("bv"), p).alias("distance"))


def knn_among(pairs: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Top k restricted to each query's listed ids."""
    return rank_pairs(pair_distances(pairs, queries, base, metric), k, metric)


def with_vectors(result: DataFrame, base: DataFrame) -> DataFrame:
    """Search results with the stored vectors."""
    return result.join(base.select("id", "vec"), "id")


def pad(result: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Missing ranks as id -1 with the worst distance."""
    worst = float("-inf") if metric in V.LARGEST_FIRST else float("inf")
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(result, ["qid", "rank"], "left").select(
        "qid", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("distance", F.lit(worst)).alias("distance")
    )


def merge_results(results: list[DataFrame], k: int, metric: str = "l2", offsets: list[int] | None = None) -> DataFrame:
    """k-way merge of search results; ``offsets`` are added to the ids of each."""
    parts = [r.select("qid", (F.col("id") + F.lit(o)).alias("id"), "distance") for r, o in zip(results, offsets or [0] * len(results), strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rank_pairs(out, k, metric)


def sharded_knn(queries: DataFrame, base: DataFrame, shards: int, k: int, metric: str = "l2") -> DataFrame:
    """Contiguous shards of the rows in id order, searched apart and merged."""
    n = max(base.count(), 1)
    starts = F.array(*[F.lit(s * n // shards) for s in range(1, shards)]) if shards > 1 else F.array().cast("array<long>")
    numbered = global_rank(base, "id").withColumn("shard", F.size(F.filter(starts, lambda c: c <= F.col("place"))))
    return merge_results([knn(queries, numbered.filter(F.col("shard") == s), k, metric) for s in range(shards)], k, metric)


def knn_1d(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Neighbours of scalars (qid, x) among (id, x) by absolute difference.

    Both sides are range-partitioned on the value into the same slices; a slice's queries
    also see the k rows on either side of the slice, found per slice, so no query needs
    another shuffle and the cost is a sort."""
    rows = base.select("id", F.col("x").cast("double").alias("x")).filter("x IS NOT NULL")
    n = rows.count() // BLOCK_ROWS + 1
    cuts = sorted(set(rows.approxQuantile("x", [i / n for i in range(1, n)], 1 / (10 * n)))) if n > 1 else []
    rows = rows.withColumn("s", slice_of(F.col("x"), cuts))
    low = rows.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("x", "id"))).filter(F.col("r") <= k)
    high = rows.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy(F.desc("x"), "id"))).filter(F.col("r") <= k)
    edges = low.unionByName(high).select("id", "x", "s").distinct()
    # next slices only, unless one is too small to hold k rows
    sizes = [r[1] for r in rows.groupBy("s").count().collect()]
    near = len(sizes) == len(cuts) + 1 and min(sizes) >= k
    others = F.array(F.col("s") - 1, F.col("s") + 1) if near else F.sequence(F.lit(0), F.lit(len(cuts)))
    spread = edges.withColumn("t", F.explode(others)).filter("t <> s")
    seen = rows.select("id", "x", F.col("s").alias("t")).unionByName(spread.select("id", "x", "t"))
    asked = queries.select("qid", F.col("x").cast("double").alias("qx")).filter("qx IS NOT NULL").withColumn("t", slice_of(F.col("qx"), cuts))

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        x, ids = np.asarray(b.column("x").combine_chunks()), np.asarray(b.column("id").combine_chunks())
        order = np.lexsort((ids, x))
        x, ids = x[order], ids[order]
        qx, qid = np.asarray(q.column("qx").combine_chunks()), np.asarray(q.column("qid").combine_chunks())
        out = ([], [], [])
        for v, name in zip(qx, qid, strict=True):
            at, m = int(np.searchsorted(x, v)), len(x)
            lo, hi = max(at - k, 0), min(at + k, m)
            if hi > lo:  # all ties of the outermost values
                lo, hi = int(np.searchsorted(x, x[lo])), int(np.searchsorted(x, x[hi - 1], side="right"))
            d = np.abs(x[lo:hi] - v)
            best = np.lexsort((ids[lo:hi], d))[:k]
            out[0].append(np.full(len(best), name))
            out[1].append(d[best])
            out[2].append(ids[lo:hi][best])
        return pa.Table.from_batches([_pairs(*(np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.float64, np.int64), strict=True)))])

    pairs = asked.groupBy("t").cogroup(seen.groupBy("t")).applyInArrow(run, _PAIRS)
    return rank_pairs(pairs, k, "l2")


def split_search(queries: DataFrame, parts: list[tuple[int, int, DataFrame]]) -> DataFrame:
    """One nearest row per slice of dimensions, combined into one label: label_0 +
    label_1 * n_0 + ...; ``parts`` are (first dimension, end, sub-database)."""
    out, factor = None, 1
    for m, (a, b, base) in enumerate(parts):
        sub = queries.select("qid", F.slice("vec", a + 1, b - a).alias("vec"))
        near = knn(sub, base, 1).select("qid", (F.col("id") * F.lit(factor)).alias(f"i{m}"), F.col("distance").alias(f"d{m}"))
        out = near if out is None else out.join(near, "qid")
        factor *= base.count()
    n = range(len(parts))
    return out.select("qid", sum((F.col(f"i{m}") for m in n), F.lit(0)).cast("long").alias("id"), sum((F.col(f"d{m}") for m in n), F.lit(0.0)).alias("distance"))
