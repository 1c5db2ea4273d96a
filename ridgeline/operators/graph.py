"""Graph indexes as edge tables: (shard, level, src, rank, dst).

Graphs are built and searched per shard: rows are dealt by hash into shards of about
``SHARD_ROWS`` rows, each shard's graph is built in one task, all shards are searched and
their results merged.  A shard bounds the memory of a task whatever the table's size.
NN-descent is distributed instead: neighbours of neighbours are joins, with every round
written to the shared folder.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import best_of_rows, matrix, pairwise
from ..session import scratch
from .knn import knn_graph, rank_pairs

SHARD_ROWS = 20_000
_EDGES = "shard int, level int, src long, rank int, dst long"


def with_shards(df: DataFrame, shards: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    n = shards or max(1, -(-df.count() // shard_rows))
    return df.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def draw_levels(n: int, m: int, seed: int) -> np.ndarray:
    """Geometric levels: each level up has a 1/m share."""
    u = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int)


def _greedy(d, neighbours, start: list[int], ef: int) -> list[tuple[float, int]]:
    """Best-first search from ``start``; d(ids) gives distances."""
    seen = set(start)
    first = d(np.array(start))
    queue = [(float(x), i) for x, i in zip(first, start, strict=True)]
    heapq.heapify(queue)
    best = [(-x, -i) for x, i in queue]
    heapq.heapify(best)
    while queue:
        x, i = heapq.heappop(queue)
        if len(best) >= ef and x > -best[0][0]:
            break
        new = [j for j in neighbours(i) if j not in seen]
        if not new:
            continue
        seen.update(new)
        for y, j in zip(d(np.array(new)), new, strict=True):
            if len(best) < ef or y < -best[0][0]:
                heapq.heappush(queue, (float(y), j))
                heapq.heappush(best, (-float(y), -j))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-x, -i) for x, i in best)


def _diverse(x: np.ndarray, found: list[tuple[float, int]], m: int, dist) -> list[int]:
    """Nearest first, each only if it is nearer to the node than to one already taken."""
    kept: list[int] = []
    for d, i in found:
        if len(kept) >= m:
            break
        if not kept or (dist(x[i], x[kept]) > d).all():
            kept.append(i)
    return kept


def _row_distance(metric: str):
    if metric == "ip":
        return lambda v, rows: -(rows @ v)
    return lambda v, rows: ((rows - v) ** 2).sum(1)


def build_small_world(x: np.ndarray, m: int = 16, ef: int = 40, metric: str = "l2", seed: int = 7) -> tuple[list[dict[int, list[int]]], int]:
    """Layered small-world graph of the rows: (links by level, entry point)."""
    dist = _row_distance(metric)
    levels = draw_levels(len(x), m, seed)
    links: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
    entry = -1
    for i in np.lexsort((np.arange(len(x)), -levels)).tolist():  # top levels first
        d = lambda ids, v=x[i]: dist(v, x[ids])
        at = [entry] if entry >= 0 else []
        for level in range(len(links) - 1, -1, -1):
            graph = links[level]
            if at and at[0] in graph:
                found = _greedy(d, lambda j, g=graph: g.get(j, ()), at, ef if level <= levels[i] else 1)
                at = [j for _, j in found]
            else:
                found = []
            if level > levels[i]:
                continue
            most = 2 * m if level == 0 else m
            near = _diverse(x, found, most, dist)
            graph[i] = near
            for j in near:
                graph[j].append(i)
                if len(graph[j]) > most:
                    ranked = sorted(zip(dist(x[j], x[graph[j]]).tolist(), graph[j], strict=True))
                    graph[j] = _diverse(x, ranked, most, dist)
        if entry < 0:
            entry = i
    return links, entry


def hnsw_build(df: DataFrame, m: int = 16, ef: int = 40, metric: str = "l2", seed: int = 7) -> DataFrame:
    """Edges of each shard's graph; the entry point of a shard is its edge with level -1."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = np.asarray(rows.column("id").combine_chunks())
        links, entry = build_small_world(matrix(rows.column("vec")), m, ef, metric, seed)
        out = [(-1, ids[entry], 0, ids[entry])]
        for level, graph in enumerate(links):
            out += [(level, ids[i], r, ids[j]) for i, near in graph.items() for r, j in enumerate(near)]
            out += [(level, ids[i], -1, ids[i]) for i, near in graph.items() if not near]
        level, src, rank, dst = (list(c) for c in zip(*out, strict=True))
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(level, pa.int32()), pa.array(src, pa.int64()), pa.array(rank, pa.int32()), pa.array(dst, pa.int64())], ["shard", "level", "src", "rank", "dst"])

    return df.select("shard", "id", "vec").groupBy("shard").applyInArrow(run, _EDGES)


def _adjacency(edges: pa.Table, number: dict[int, int]) -> tuple[list[dict[int, list[int]]], int]:
    links: dict[int, dict[int, list[int]]] = {}
    entry = 0
    for r in edges.sort_by([("level", "ascending"), ("src", "ascending"), ("rank", "ascending")]).to_pylist():
        if r["level"] < 0:
            entry = number[r["src"]]
        else:
            own = links.setdefault(r["level"], {}).setdefault(number[r["src"]], [])
            if r["rank"] >= 0:
                own.append(number[r["dst"]])
    return [links.get(i, {}) for i in range(max(links, default=-1) + 1)], entry


def graph_search(queries: DataFrame, df: DataFrame, edges: DataFrame, k: int, ef: int = 16, metric: str = "l2") -> DataFrame:
    """Greedy descent, then best-first with max(ef, k) at the bottom, in every shard.
    Queries go to all shards, in parts that were counted to fit a broadcast."""
    from .knn import BROADCAST_BYTES, _query_matrix, fits_broadcast

    if not fits_broadcast(queries):  # as many parts as fit, one after the other
        n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        parts, out = n * width * 8 // (BROADCAST_BYTES // 2) + 2, None
        for i in range(parts):
            found = graph_search(queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i), df, edges, k, ef, metric)
            out = found if out is None else out.unionByName(found)
        return out
    shared = df.sparkSession.sparkContext.broadcast(_query_matrix(queries))
    dist = _row_distance(metric)

    def run(rows: pa.Table, links: pa.Table) -> pa.Table:
        qids, q = shared.value
        ids = np.asarray(rows.column("id").combine_chunks())
        x = matrix(rows.column("vec"))
        graphs, entry = _adjacency(links, {int(i): n for n, i in enumerate(ids)})
        out = ([], [], [])
        for qid, v in zip(qids.tolist(), q, strict=True):
            d = lambda n, v=v: dist(v, x[n])
            at = [entry]
            for level in range(len(graphs) - 1, -1, -1):
                near = _greedy(d, lambda j, g=graphs[level]: g.get(j, ()), at, max(ef, k) if level == 0 else 1)
                at = [j for _, j in near]
            for y, j in near[:k]:
                out[0].append(qid)
                out[1].append(int(ids[j]))
                out[2].append(-y if metric == "ip" else y)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qid", "id", "distance"])

    pairs = df.select("shard", "id", "vec").groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(run, "qid long, id long, distance double")
    return rank_pairs(pairs, k, metric)


def nsg_build(df: DataFrame, r: int = 16, k: int = 32) -> DataFrame:
    """Pruned k-NN graph of each shard: from the node nearest to the mean, each node keeps
    up to r diverse neighbours; nodes not reachable are hung on their nearest reachable."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, x = np.asarray(rows.column("id").combine_chunks()), matrix(rows.column("vec"))
        dist = _row_distance("l2")
        entry = int(pairwise(x.mean(0)[None, :], x)[0].argmin())
        graph = []
        for a in range(0, len(x), 1024):
            d = pairwise(x[a : a + 1024], x)
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
            graph += [_diverse(x, [(float(d[i, j]), int(j)) for j in row], r, dist) for i, row in enumerate(near)]
        for i, near in list(enumerate(graph)):  # links back, while there is room
            for j in near:
                if i not in graph[j] and len(graph[j]) < r:
                    graph[j].append(i)
        reached, queue = {entry}, [entry]
        while True:
            while queue:
                new = [j for j in graph[queue.pop()] if j not in reached]
                reached.update(new)
                queue += new
            rest = [i for i in range(len(x)) if i not in reached]
            if not rest:
                break
            known = np.array(sorted(reached))
            j = int(known[dist(x[rest[0]], x[known]).argmin()])
            graph[j].append(rest[0])
            reached.add(rest[0])
            queue = [rest[0]]
        out = [(-1, ids[entry], 0, ids[entry])] + [(0, ids[i], n, ids[j]) for i, near in enumerate(graph) for n, j in enumerate(near)]
        level, src, rank, dst = (list(c) for c in zip(*out, strict=True))
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(level, pa.int32()), pa.array(src, pa.int64()), pa.array(rank, pa.int32()), pa.array(dst, pa.int64())], ["shard", "level", "src", "rank", "dst"])

    return df.select("shard", "id", "vec").groupBy("shard").applyInArrow(run, _EDGES)


def _nearest_inside(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, distance): for each row the ``most`` nearest others of the group."""
    d = pairwise(x, x)
    d[ids[:, None] == ids[None, :]] = np.nan
    p, q = best_of_rows(d, most)
    return ids[p], ids[q], d[p, q]


def _groups_nearest(rows: pa.Table, most: int) -> pa.Table:
    """``_nearest_inside`` for each group ``u`` of a table (u, id, vec)."""
    rows = rows.sort_by("u")
    u, ids, x = np.asarray(rows.column("u").combine_chunks()), np.asarray(rows.column("id").combine_chunks()), matrix(rows.column("vec"))
    cuts = np.append(np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))), len(u))
    parts = [_nearest_inside(ids[a:b], x[a:b], most) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table([pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], ["qid", "id", "distance"])


def _near_pairs(groups: DataFrame, groups_per_task: int, most: int) -> DataFrame:
    """Pairs of (u, id, vec) rows that are among the nearest of one group, each pair once."""
    dealt = groups.withColumn("task", F.pmod(F.xxhash64("u"), F.lit(max(1, groups_per_task))))
    found = dealt.groupBy("task").applyInArrow(lambda t: _groups_nearest(t.select(["u", "id", "vec"]), most), "qid long, id long, distance double")
    return found.groupBy("qid", "id").agg(F.min("distance").alias("distance"))


#: Rows of a start bucket, and its random-hyperplane tables.
BUCKET_ROWS, START_TABLES = 256, 4
#: Links of a node, to and from it, that are joined in a round; more than the k asked for.
MORE_LINKS, MORE_POOL = 24, 50


def _start_buckets(df: DataFrame, n: int, seed: int) -> DataFrame:
    """(u, id, vec): each row in START_TABLES buckets of like rows, of a bounded size."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS)))
    tables = START_TABLES

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec"))
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * max(bits, 1)))
            keys = (x @ planes >= 0).reshape(len(x), tables, -1) @ (1 << np.arange(max(bits, 1), dtype=np.int64))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t] * tables + t), b.column("id"), b.column("vec")], ["u", "id", "vec"])

    kind = df.schema["vec"].dataType.simpleString()
    rows = df.select("id", "vec").mapInArrow(run, f"u long, id long, vec {kind}")
    # a bucket of very many rows is dealt into pieces
    sizes = rows.groupBy("u").agg(F.count(F.lit(1)).alias("size"))
    pieces = sizes.select("u", F.ceil(F.col("size") / (2 * BUCKET_ROWS)).cast("int").alias("pieces"))
    rows = rows.join(pieces, "u").withColumn("piece", F.pmod(F.xxhash64("id", "u"), F.col("pieces")))
    return rows.select(F.xxhash64("u", "piece").alias("u"), "id", "vec")


def nn_descent(df: DataFrame, k: int, rounds: int = 10, seed: int = 3, least_change: float = 0.001) -> DataFrame:
    """Approximate k-NN graph (qid, rank, id, distance): neighbours of a node are compared
    with each other, and each keeps a pool of the k + MORE_POOL best it has met; rounds end
    when few of the first k change.  It starts from buckets of random hyperplanes.

    A node joins at most k + MORE_LINKS of its links to others and as many to it, so a node
    that is everybody's neighbour does not multiply; every round is written to the shared
    folder."""
    spark, n = df.sparkSession, df.count()
    pool, links = k + MORE_POOL, k + MORE_LINKS
    tasks = n // BUCKET_ROWS + 1

    def stored(pairs: DataFrame) -> DataFrame:
        path = scratch(spark, "graph")
        rank_pairs(pairs, pool, "l2").write.parquet(path)
        return spark.read.parquet(path)

    graph = stored(_near_pairs(_start_buckets(df, n, seed), tasks, pool))
    vecs = df.select("id", "vec")
    for _ in range(rounds):
        out = graph.filter(F.col("rank") <= links).select(F.col("qid").alias("u"), "id", "distance")
        w = W.partitionBy("u").orderBy("distance", "id")
        back = out.select(F.col("id").alias("u"), F.col("u").alias("id"), "distance").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= links)
        near = out.select("u", "id").unionByName(back.select("u", "id")).unionByName(df.select(F.col("id").alias("u"), "id")).distinct()
        met = _near_pairs(near.join(vecs, "id").select("u", "id", "vec"), tasks, k)
        both = met.unionByName(graph.select("qid", "id", "distance")).groupBy("qid", "id").agg(F.min("distance").alias("distance"))
        new = stored(both)
        first = lambda g: g.filter(F.col("rank") <= k).select("qid", "id")
        changed = first(new).join(first(graph), ["qid", "id"], "left_anti").count()
        graph = new
        if changed <= least_change * n * k:
            break
    return graph.filter(F.col("rank") <= k)


def edges_from_neighbours(graph: DataFrame) -> DataFrame:
    """A k-NN graph as level-0 edges of a single shard."""
    return graph.select(F.lit(0).alias("shard"), F.lit(0).alias("level"), F.col("qid").alias("src"), (F.col("rank") - 1).cast("int").alias("rank"), F.col("id").alias("dst"))


def shrink(edges: DataFrame, level: int, most: int) -> DataFrame:
    """At most ``most`` links of a level's nodes."""
    return edges.filter((F.col("level") != level) | (F.col("rank") < most))


def link_singletons(edges: DataFrame, df: DataFrame) -> DataFrame:
    """Rows that nothing links to are linked from their nearest row."""
    lonely = df.join(edges.filter("level = 0 AND rank >= 0").select(F.col("dst").alias("id")), "id", "left_anti")
    from .knn import knn

    near = knn(lonely.select(F.col("id").alias("qid"), "vec"), df, 1, exclude_self=True)
    extra = near.join(df.select("id", "shard"), "id").select("shard", F.lit(0).alias("level"), F.col("id").alias("src"), F.lit(1 << 20).alias("rank"), F.col("qid").alias("dst"))
    return edges.unionByName(extra)


exact_graph = knn_graph
