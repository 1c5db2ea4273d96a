"""Inverted-file search: rows partitioned by nearest centroid, probed list by list.

postings (id, list_no, vec, ...), probes (qid, probe, list_no, coarse_distance),
results as in ``knn``.  Only probed lists are read: their numbers are a filter on the
postings, which prunes folders where postings are stored by list (``store``).  Queries that
were counted to be few are broadcast by list, and rows stream past those that probe their
list without a shuffle; many queries meet rows by (list, page, block), where pages cut long
lists and blocks cut much-probed ones, so a list that holds a third of all rows is many
tasks.  Distances are matrix products over bounded blocks, and only the k best rows per
query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.kernels import BLOCK, TopK, best_of_rows, matrix, pairwise
from . import knn as knn_module
from .cluster import assign_lists, kmeans
from .knn import rank_pairs

PAGE_ROWS = 16_384
#: Lists up to which their numbers are written into the filter of a scan.
LITERAL_LISTS = 2048


def train(df: DataFrame, nlist: int, metric: str = "l2", mode: str = "kmeans", niter: int = 10, seed: int = 1234, coarse=None) -> np.ndarray:
    """Coarse centroids.  mode: ``kmeans`` over the rows; ``given``: ``coarse`` (a function
    of the data frame) trains itself; ``flat``: k-means in L2, then ``coarse`` (a function
    of the centroid matrix) gives what stands in their place, or they stay."""
    if mode == "given":
        return np.asarray(coarse(df), float)
    spherical = metric in ("ip", "cosine")
    found = kmeans(df, nlist, niter=niter, metric="l2" if mode == "flat" else metric, spherical=spherical, seed=seed).centroids
    return np.asarray(coarse(found), float) if mode == "flat" and coarse else found


def add(df: DataFrame, centroids: np.ndarray, metric: str = "l2", numbers: np.ndarray | None = None) -> DataFrame:
    """Postings: ``df`` with its list; rows with NaN components belong to no list."""
    good = df.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    return assign_lists(good, centroids, metric, numbers).drop("centroid_distance")


def store(postings: DataFrame, path: str) -> DataFrame:
    """Postings written in folders by list, so that a search reads the probed ones."""
    postings.write.partitionBy("list_no").parquet(path)
    columns = [c for c in postings.columns if c != "list_no"]
    return postings.sparkSession.read.parquet(path).select(*columns, F.col("list_no").cast("int").alias("list_no"))


def add_preassigned(df: DataFrame, lists: DataFrame) -> DataFrame:
    """Postings from given (id, list_no); negative lists are ignored."""
    return df.join(lists.filter("list_no >= 0"), "id")


def probe(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str = "l2", numbers: np.ndarray | None = None) -> DataFrame:
    """The nprobe best lists of each query; nprobe is clamped to their number."""
    number = np.arange(len(centroids)) if numbers is None else numbers
    shared = queries.sparkSession.sparkContext.broadcast((centroids, number))

    def run(batches):
        c, num = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            top = TopK(min(nprobe, len(c)), metric in V.LARGEST_FIRST)
            top.add(pairwise(matrix(b.column("vec")), c, metric), np.asarray(num, np.int64))
            q, d, i = top.result()
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column("qid"))[q]), pa.array(rank.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(d)], ["qid", "probe", "list_no", "coarse_distance"])

    return queries.select("qid", "vec").mapInArrow(run, "qid long, probe int, list_no int, coarse_distance double")


def list_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("list_no").agg(F.count(F.lit(1)).alias("size"))


def imbalance_factor(postings: DataFrame, nlist: int | None = None) -> DataFrame:
    """One row: imbalance; 1.0 means equal lists.  nlist counts empty lists too."""
    sizes = list_sizes(postings)
    n = F.lit(nlist) if nlist else F.count(F.lit(1))
    return sizes.agg((n * F.sum(F.col("size").cast("double") * F.col("size")) / F.pow(F.sum("size").cast("double"), F.lit(2))).alias("imbalance"))


def cut_probes(probes: DataFrame, postings: DataFrame, max_codes: int) -> DataFrame:
    """Probes of a query until the lists before hold ``max_codes`` rows; whole lists."""
    before = F.sum("size").over(W.partitionBy("qid").orderBy("probe").rowsBetween(W.unboundedPreceding, -1))
    sized = probes.join(list_sizes(postings), "list_no", "left").fillna(0, ["size"])
    return sized.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_codes).drop("before", "size")


def statistics(probes: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, nlists, ndis): lists probed and rows compared."""
    sized = probes.join(list_sizes(postings), "list_no", "left").fillna(0, ["size"])
    return sized.groupBy("qid").agg(F.count(F.lit(1)).alias("nlists"), F.sum("size").alias("ndis"))


def paginate(postings: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Postings with a page in their list: rows are dealt by hash to as many pages as the
    list's size asks for, so no window over a long list is needed."""
    pages = list_sizes(postings).select("list_no", F.greatest(F.ceil(F.col("size") / page_rows), F.lit(1)).cast("int").alias("pages"))
    return postings.join(pages, "list_no").withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")).cast("int"))


def page_size(sizes: list[int], start: int | None = None, step: int = 256, most_pages: float = 11.0) -> int:
    """A page size that cuts lists evenly: from the mean list size rounded down to a
    multiple of ``step``, smaller until the pages' sizes vary by at most a fifth of the
    size or there are more than ``most_pages`` pages per list."""
    sizes = [s for s in sizes if s > 0]
    if not sizes:
        return step
    size = start or max(int(np.mean(sizes)) // step * step, step)
    while size > step:
        pages = [p for s in sizes for p in [size] * (s // size) + ([s % size] if s % size else [])]
        if np.std(pages) <= 0.2 * size or len(pages) > most_pages * len(sizes):
            break
        size -= step
    return size


def _probed(postings: DataFrame, wanted: DataFrame, lists: list[int] | None) -> DataFrame:
    """Postings of probed lists only.  Few lists become a literal filter, which prunes the
    folders of postings stored by list; many are a join on their numbers."""
    if lists is None or len(lists) > LITERAL_LISTS:
        return postings.join(wanted.select("list_no").distinct(), "list_no", "left_semi")
    return postings.filter(F.col("list_no").isin(lists)) if lists else postings.limit(0)


def _few_probes(queries: DataFrame, wanted: DataFrame) -> pa.Table | None:
    """The (qid, list_no) rows, if queries and probes are each at most BROADCAST_BYTES;
    counted, not guessed."""
    if not knn_module.fits_broadcast(queries):
        return None
    most = knn_module.BROADCAST_BYTES // 16
    got = wanted.limit(most + 1).toArrow()
    return got if got.num_rows <= most else None


def _scan(q: np.ndarray, x: np.ndarray, table: pa.Table, ids: np.ndarray, number: int, k, metric: str, p, radius, scorer):
    """(qid, id, distance) arrays of one list's rows against its queries, in blocks of
    queries; per query the k best, or all strictly within the radius."""
    largest = metric in V.LARGEST_FIRST
    rows = None if scorer else matrix(table.column("vec"))
    for s in range(0, len(q), max(1, BLOCK // max(1, len(ids)))):
        part = slice(s, s + max(1, BLOCK // max(1, len(ids))))
        d = scorer(x[part], table, number) if scorer else pairwise(x[part], rows, metric, p)
        if radius is not None:
            a, b = np.nonzero(d > radius if largest else d < radius)
        else:
            a, b = best_of_rows(-d if largest else d, k)
            finite = np.isfinite(d[a, b])
            a, b = a[finite], b[finite]
        yield q[part][a], ids[b], d[a, b]


def _cut(parts: list[tuple], k: int | None, largest: bool) -> list[np.ndarray]:
    """(qid, id, distance, list) of parts, the k best per query."""
    kinds = (np.int64, np.int64, np.float64, np.int32)
    out = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, t) for i, t in enumerate(kinds)]
    if k is None or not parts:
        return out
    q, i, d, n = out
    order = np.lexsort((i, -d if largest else d, q))
    q = q[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    order = order[rank < k]
    return [x[order] for x in out]


_FOUND = ["qid", "id", "distance", "list_no"]
_FOUND_TYPES = "qid long, id long, distance double, list_no int"


def _stream(queries: DataFrame, postings: DataFrame, pairs: pa.Table, k, metric, p, radius, scorer, columns) -> DataFrame:
    """Few queries: they are broadcast by list, and rows of probed lists stream past them."""
    asked = queries.select("qid", "vec").toArrow()
    at = {int(q): i for i, q in enumerate(asked.column("qid").to_pylist())}
    by_list: dict[int, list[int]] = {}
    for q, n in zip(pairs.column("qid").to_pylist(), pairs.column("list_no").to_pylist(), strict=True):
        if q in at:
            by_list.setdefault(n, []).append(at[q])
    lists = {n: np.array(v) for n, v in by_list.items()}
    shared = postings.sparkSession.sparkContext.broadcast((np.asarray(asked.column("qid").combine_chunks(), np.int64), matrix(asked.column("vec")), lists))
    largest = metric in V.LARGEST_FIRST

    def run(batches):
        qids, x, lists = shared.value
        held: list[tuple] = []
        for batch in batches:
            number = np.asarray(batch.column("list_no"))
            order = np.argsort(number, kind="stable")
            cuts = np.append(np.flatnonzero(np.concatenate(([True], number[order][1:] != number[order][:-1]))), len(order)) if len(order) else []
            table = pa.Table.from_batches([batch])
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = int(number[order[a]])
                if n not in lists:
                    continue
                rows = table.take(pa.array(order[a:b]))
                mine = lists[n]
                for q, i, d in _scan(qids[mine], x[mine], rows, np.asarray(rows.column("id").combine_chunks()), n, k, metric, p, radius, scorer):
                    held.append((q, i, d, np.full(len(q), n, np.int32)))
            if radius is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _cut(held, None, largest)], _FOUND)
                held = []
            else:
                held = [tuple(_cut(held, k, largest))] if held else []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], _FOUND)

    return postings.select("id", "list_no", *columns).mapInArrow(run, _FOUND_TYPES)


def _meet(queries: DataFrame, postings: DataFrame, wanted: DataFrame, k, metric, p, radius, scorer, columns, page_rows: int) -> DataFrame:
    """Many queries: pages of a list's rows meet blocks of its queries, each pair a task."""
    asked = wanted.groupBy("list_no").agg(F.count(F.lit(1)).alias("asks"))
    shape = list_sizes(postings).join(asked, "list_no").select(
        "list_no",
        F.greatest(F.ceil(F.col("size") / page_rows), F.lit(1)).cast("int").alias("pages"),
        F.greatest(F.ceil(F.col("asks") / page_rows), F.lit(1)).cast("int").alias("blocks"),
    )
    number = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = postings.select("id", "list_no", *columns).join(shape, "list_no")
    rows = rows.withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")).cast("int")).withColumn("block", number("blocks")).drop("pages", "blocks")
    # other names than the postings': both sides come from one table
    wanted = wanted.join(shape, "list_no")
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("page", number("pages"))
    wanted = wanted.select("qid", F.col("list_no").alias("q_list"), F.col("page").alias("q_page"), F.col("block").alias("q_block"))
    wanted = wanted.join(queries.select("qid", F.col("vec").alias("qv")), "qid")
    largest = metric in V.LARGEST_FIRST

    def run(q: pa.Table, rows: pa.Table) -> pa.Table:
        held: list[tuple] = []
        if q.num_rows and rows.num_rows:
            n = q.column("q_list")[0].as_py()
            qids, ids = (np.asarray(t.column(c).combine_chunks()) for t, c in ((q, "qid"), (rows, "id")))
            for a, i, d in _scan(qids, matrix(q.column("qv")), rows, ids, n, k, metric, p, radius, scorer):
                held.append((a, i, d, np.full(len(a), n, np.int32)))
        return pa.table([pa.array(c) for c in _cut(held, None if radius is not None else k, largest)], _FOUND)

    return wanted.groupBy("q_list", "q_page", "q_block").cogroup(rows.groupBy("list_no", "page", "block")).applyInArrow(run, _FOUND_TYPES)


def search(
    queries: DataFrame,
    postings: DataFrame,
    probes: DataFrame,
    k: int | None,
    metric: str = "l2",
    p: float | None = None,
    radius: float | None = None,
    page_rows: int = PAGE_ROWS,
    with_list: bool = False,
    scorer: Callable | None = None,
    payload: list[str] | None = None,
) -> DataFrame:
    """Top k (or all strictly within ``radius``) over the probed lists.

    ``scorer(query matrix, table of rows, list number) -> distances`` replaces the exact
    distance for coded postings, whose columns are ``payload``."""
    columns = payload or ["vec"]
    wanted = probes.filter("list_no >= 0").select("qid", "list_no")
    few = _few_probes(queries, wanted)
    if few is not None:
        rows = _probed(postings, wanted, sorted(set(few.column("list_no").to_pylist())))
        pairs = _stream(queries, rows, few, k, metric, p, radius, scorer, columns)
    else:
        pairs = _meet(queries, _probed(postings, wanted, None), wanted, k, metric, p, radius, scorer, columns, page_rows)
    if radius is not None:
        return pairs if with_list else pairs.drop("list_no")
    w = W.partitionBy("qid").orderBy(V.best_first(metric, F.col("distance")), "id")
    best = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("qid", "rank", "id", "distance", *(["list_no"] if with_list else []))


def search_expression(queries: DataFrame, postings: DataFrame, probes: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """``search`` as an equi-join on list_no in built-in expressions."""
    pairs = probes.join(queries.select("qid", F.col("vec").alias("qv")), "qid").join(postings.select("id", "list_no", "vec"), "list_no")
    return rank_pairs(pairs.select("qid", "id", V.distance(metric, F.col("qv"), F.col("vec")).alias("distance")), k, metric)


# --- identical vectors stored once ----------------------------------------------------


def deduplicate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives (id, vec), instances (rep, id)); the smallest id represents."""
    groups = df.groupBy("vec").agg(F.min("id").alias("rep"))
    instances = df.join(groups, "vec").select("rep", "id")
    return groups.select(F.col("rep").alias("id"), "vec"), instances


def expand_duplicates(result: DataFrame, instances: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Search results over representatives, with all instances, cut at k again."""
    pairs = result.join(instances.withColumnRenamed("id", "inst"), result["id"] == F.col("rep"))
    return rank_pairs(pairs.select("qid", F.col("inst").alias("id"), "distance"), k, metric)


# --- multi-index: lists are pairs of sub-centroids ---------------------------------------


def multi_index_probe(queries: DataFrame, books: list[np.ndarray], nprobe: int) -> DataFrame:
    """The nprobe cells of the Cartesian product of sub-codebooks with the smallest sum of
    squared distances; the cell number has the first code lowest."""
    dims = [b.shape[1] for b in books]
    shared = queries.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x, at, out = matrix(b.column("vec")), 0, ([], [], [], [])
            tables = []
            for book, width in zip(books, dims, strict=True):
                tables.append(pairwise(x[:, at : at + width], book))
                at += width
            for i, qid in enumerate(b.column("qid").to_pylist()):
                sums, codes, factor = np.zeros(1), np.zeros(1, np.int64), 1
                for t in tables:  # the best nprobe of a sum only need the best nprobe of each part
                    best = np.argsort(t[i], kind="stable")[:nprobe]
                    both = (sums[:, None] + t[i][best][None, :]).ravel()
                    number = (codes[:, None] + best[None, :] * factor).ravel()
                    order = np.lexsort((number, both))[:nprobe]
                    sums, codes, factor = both[order], number[order], factor * t.shape[1]
                out[0].extend([qid] * len(sums))
                out[1].extend(range(1, len(sums) + 1))
                out[2].extend(codes)
                out[3].extend(sums)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64())], ["qid", "probe", "list_no", "coarse_distance"])

    return queries.select("qid", "vec").mapInArrow(run, "qid long, probe int, list_no int, coarse_distance double")


def multi_index_centroid(books: list[np.ndarray], number: int) -> np.ndarray:
    parts = []
    for book in books:
        parts.append(book[number % len(book)])
        number //= len(book)
    return np.concatenate(parts)
