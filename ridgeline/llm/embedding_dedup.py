"""Embedding near-deduplication with randomised-rotation binary codes.

Unit vectors are rotated by a seeded random orthogonal matrix and coded once: their signs
are the binary code, beside which go a byte per component (so that a vector can also ask),
the rounding error of these, and the correction factor, the inner product of the vector
with its own code.  For a vector q and a coded vector o,
    <q, code(o)> / <o, code(o)>
is an unbiased estimate of their cosine, and its error stays within
    z * sqrt(1 - f**2) / f / sqrt(d - 1),      f = <o, code(o)>
with the probability of z standard errors, and the rounding error of q divided by f.
Vectors of a run go on only if the bound of one of their pairs reaches the threshold; those
are recomputed exactly in double precision, so that nothing below it is ever linked.

Candidates are pairs that agree on all ``bits`` sign bits of at least one of several
tables of random hyperplanes.  ``bits`` grows with the logarithm of the number of
different vectors, and the number of tables follows from the chance that a pair exactly
at the threshold is met at least once (``recall``, 0.99; the recall of all pairs is
higher).  A pair is counted in the first table that has it.

Equal vectors are one class from the start, weighted by their number.  Only identifiers
and codes (a byte per component) are sent to every table, and whole vectors only to the
runs in which they have a pair to recompute.  Runs of a table give one row per vector that
has links (its number of links and a neighbour in a spanning forest), never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components have no links and are their own component; vectors of different length are
never linked; rows that repeat an identifier are vectors of their own; null identifiers
take part and never name a component; a cosine of exactly the threshold links; an empty
table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import durable, few
from .components import components

THRESHOLD, RECALL, Z, SEED = 0.95, 0.99, 4.0, 11
_BLOCK = 1024
#: Vectors of a key that one task compares; keys with more are cut into pairs of blocks.
RUN_ROWS = 8192
#: Runs up to this length are compared many at a time.
SHORT_RUN = 48


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def table_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n different vectors."""
    bits = min(max(math.ceil(math.log2(max(n, 2))) - 2, 6), 31)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _vectors(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of an Arrow list column, for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    for d in np.unique(size):
        mine = np.flatnonzero(size == d)
        x = flat[starts[mine][:, None] + np.arange(d)].astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)  # keeps squares of huge and tiny components in range
        yield mine, x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit vectors: the rotated components in steps of a 127th of the largest,
    one signed byte each, whose sign is the binary code; and (scale, rounding error,
    correction factor) of each."""
    turned = x @ rotation(x.shape[1])
    scale = np.abs(turned).max(1, keepdims=True) / 127
    steps = np.clip(np.floor(turned / scale), -128, 127).astype(np.int8)
    error = np.sqrt(((turned - (steps + 0.5) * scale) ** 2).sum(1))
    factor = (turned * np.where(steps >= 0, 1.0, -1.0)).sum(1) / math.sqrt(x.shape[1])
    return steps, np.stack((scale[:, 0], error, factor), 1).astype(np.float32)


def decode(steps: np.ndarray, head: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounded vectors, signs, correction factors, errors of estimates against a vector,
    and rounding errors."""
    d = steps.shape[1]
    scale, rounding, factor = (head[:, k].astype(np.float64) for k in range(3))
    error = z * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(d - 1, 1)) + 1e-6
    return (steps + 0.5) * scale[:, None], np.where(steps >= 0, 1.0, -1.0) / math.sqrt(d), factor, error, rounding


def _code(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, w, v, signature in each table, code), each vector coded once."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            for mine, x in _vectors(part.column("v")):
                planes = np.random.default_rng(SEED * 1000 + x.shape[1]).standard_normal((x.shape[1], bits * tables))
                keys = ((x @ planes >= 0).reshape(len(mine), tables, bits) @ weights).astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                steps, head = encode(x)
                codes = [h.tobytes() + s.tobytes() for h, s in zip(head, steps, strict=True)]
                kept = part.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*kept.columns, sigs, pa.array(codes, pa.binary())], [*kept.schema.names, "sig", "code"])


def _ask_run(steps: np.ndarray, head: np.ndarray, threshold: float, z: float, side: np.ndarray | None) -> np.ndarray:
    """Which vectors of a run have a pair whose bound reaches the threshold; with ``side``,
    a pair across the two sides."""
    n = len(steps)
    q, signs, factor, error, rounding = decode(steps, head, z)
    asks = np.zeros(n, bool)
    for a in range(0, n, _BLOCK):
        for b in range(a, n, _BLOCK):
            i, j = slice(a, min(a + _BLOCK, n)), slice(b, min(b + _BLOCK, n))
            if asks[i].all() and asks[j].all():
                continue
            ask = (q[i] @ signs[j].T + rounding[i][:, None]) / factor[j] + error[j] >= threshold
            if a == b:
                np.fill_diagonal(ask, False)
            if side is not None:
                ask &= side[i][:, None] != side[j][None, :]
            asks[i] |= ask.any(1)
            asks[j] |= ask.any(0)
    return asks


def _ask_small_runs(steps: np.ndarray, head: np.ndarray, cut: np.ndarray, side: np.ndarray, cross: np.ndarray, threshold: float, z: float) -> np.ndarray:
    """``_ask_run`` for many short runs at once: rows cut[i]:cut[i + 1] are a run."""
    q, signs, factor, error, rounding = decode(steps, head, z)
    asks = np.zeros(len(steps), bool)
    for p, r in _short_pairs(cut):
        ask = (np.einsum("ij,ij->i", q[p], signs[r]) + rounding[p]) / factor[r] + error[r] >= threshold
        ask &= ~(cross[p] & (side[p] == side[r]))
        asks[p[ask]] = True
        asks[r[ask]] = True
    return asks


def _short_pairs(cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same run, for short runs."""
    size = np.diff(cut)
    for s in np.unique(size[size > 1]):
        i, j = np.triu_indices(s, 1)
        starts = cut[:-1][size == s]
        step = max(1, (1 << 18) // len(i))
        for a in range(0, len(starts), step):
            some = starts[a : a + step, None]
            yield (some + i).ravel(), (some + j).ravel()


def link_run(x: np.ndarray, w: np.ndarray, sig: np.ndarray, t: int, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted numbers of links, first met in table t, and component labels of unit
    vectors, recomputed exactly; with ``side``, of pairs across the two sides only."""
    n = len(x)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, n, _BLOCK):
        for b in range(a, n, _BLOCK):
            i, j = slice(a, min(a + _BLOCK, n)), slice(b, min(b + _BLOCK, n))
            near = x[i] @ x[j].T >= threshold
            if a == b:
                near &= np.tri(*near.shape, -1, dtype=bool).T
            if side is not None:
                near &= side[i][:, None] != side[j][None, :]
            for u in range(t):
                if not near.any():
                    break
                near &= sig[i, u][:, None] != sig[j, u][None, :]
            p, q = np.nonzero(near)
            if not len(p):
                continue
            p, q = a + p, b + q
            links += np.bincount(p, w[q], n).astype(np.int64) + np.bincount(q, w[p], n).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))), len(p))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own, others = label[p[lo]], label[q[lo:hi]]
                if (others != own).any():
                    joined = np.append(np.unique(others), own)
                    label[np.isin(label, joined)] = joined.min()
    return links, label


def link_small_runs(x: np.ndarray, w: np.ndarray, sig: np.ndarray, cut: np.ndarray, t: np.ndarray, side: np.ndarray, cross: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``link_run`` for many short runs at once."""
    n = len(x)
    ps, qs = [], []
    for p, q in _short_pairs(cut):
        near = ((x[p] * x[q]).sum(1) >= threshold) & ~(cross[p] & (side[p] == side[q]))
        p, q = p[near], q[near]
        earlier = np.arange(sig.shape[1])[None, :] < t[p][:, None]
        new = ~((sig[p] == sig[q]) & earlier).any(1)
        ps.append(p[new])
        qs.append(q[new])
    label = np.arange(n)
    if not ps:
        return np.zeros(n, np.int64), label
    p, q = np.concatenate(ps), np.concatenate(qs)
    links = np.bincount(p, w[q], n).astype(np.int64) + np.bincount(q, w[p], n).astype(np.int64)
    while (label[p] != label[q]).any():
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
    return links, label


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs from rows sorted by run; a run that crosses batches is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column("run").to_numpy()
        at = int(np.searchsorted(run, run[-1]))
        if at or (held and held[0].column("run")[0].as_py() != int(run[0])):
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _cuts(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs, and which of them are long."""
    cut = np.append(np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))), len(run))
    return cut, np.diff(cut) > SHORT_RUN


def _ask(batches: Iterator[pa.RecordBatch], threshold: float, z: float) -> Iterator[pa.RecordBatch]:
    """The rows of runs that have a pair to be recomputed, decided by their codes."""
    for rows in _whole_runs(batches):
        rows = rows.combine_chunks()
        codes = rows.column("code").combine_chunks()
        size = pc.binary_length(codes).to_numpy(zero_copy_only=False)
        run, block, cross = (np.asarray(rows.column(c).combine_chunks()) for c in ("run", "block", "other"))
        asks = np.zeros(rows.num_rows, bool)
        for d in np.unique(size):  # a run holds one length, a table may hold several
            mine = np.flatnonzero(size == d)
            raw = np.frombuffer(b"".join(codes.take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), int(d))
            head, steps = np.ascontiguousarray(raw[:, :12]).view(np.float32), np.ascontiguousarray(raw[:, 12:]).view(np.int8)
            cut, long = _cuts(run[mine])
            for a, b in zip(cut[:-1][long], cut[1:][long], strict=True):
                asks[mine[a:b]] = _ask_run(steps[a:b], head[a:b], threshold, z, block[mine[a:b]] if cross[mine[a]] else None)
            rest = np.flatnonzero(~np.repeat(long, np.diff(cut)))
            if len(rest):
                short = np.append(0, np.cumsum(np.diff(cut)[~long]))
                asks[mine[rest]] = _ask_small_runs(steps[rest], head[rest], short, block[mine[rest]], cross[mine[rest]], threshold, z)
        yield from rows.filter(pa.array(asks)).drop(["code"]).to_batches()


def _link(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of runs, recomputed exactly in double precision."""
    for rows in _whole_runs(batches):
        run, t, block, ids, w, cross = (np.asarray(rows.column(c).combine_chunks()) for c in ("run", "t", "block", "id", "w", "other"))
        sig = rows.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        out = []
        for mine, x in _vectors(rows.column("v")):
            cut, long = _cuts(run[mine])
            for a, b in zip(cut[:-1][long], cut[1:][long], strict=True):
                part = mine[a:b]
                links, label = link_run(x[a:b], w[part], sig[part], int(t[part[0]]), threshold, block[part] if cross[part[0]] else None)
                out.append((links, ids[part][label], ids[part]))
            rest = np.flatnonzero(~np.repeat(long, np.diff(cut)))
            if len(rest):
                short, part = np.append(0, np.cumsum(np.diff(cut)[~long])), mine[rest]
                links, label = link_small_runs(x[rest], w[part], sig[part], short, t[part], block[part], cross[part], threshold)
                out.append((links, ids[part][label], ids[part]))
        out = [(i[n > 0], n[n > 0], near[n > 0]) for n, near, i in out]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["id", "links", "near"])


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, z: float = Z
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    v = F.col(f"`{vec_col}`")
    item = "float" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "double"
    good = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    plain = F.transform(v.cast(f"array<{item}>"), lambda x: x + F.lit(0.0).cast(item))  # -0.0 is 0.0
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"),
        good.alias("good"),
        F.when(good, F.xxhash64(plain)).alias("h1"),
        F.when(good, F.xxhash64(F.lit(1), plain)).alias("h2"),
        F.when(good, plain).alias("v"),
    )
    kinds = rows.filter("good").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    kinds = durable(kinds, "vectors").withColumn("id", F.xxhash64("h1", "h2"))
    bits, tables = table_shape(kinds.count(), threshold, recall)
    coded = kinds.select("id", "w", "v").mapInArrow(lambda it: _code(it, bits, tables), f"id long, w long, v array<{item}>, sig array<int>, code binary")
    coded = durable(coded, "codes")
    # runs: rows of equal signature in a table, told apart by their length; codes travel alone
    met = coded.select("id", "code", F.octet_length("code").alias("d"), F.posexplode("sig").alias("t", "s"))
    met = met.select("id", "code", "t", F.xxhash64("d", "t", "s").alias("key"))
    # Keys with very many vectors: blocks of RUN_ROWS, each pair of blocks a run of its own.
    big = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RUN_ROWS)
    big = durable(big.select("key", F.ceil(F.col("n") / RUN_ROWS).cast("int").alias("blocks")), "big")
    met = met.join(F.broadcast(big) if few(big) else big, "key", "left")
    met = met.withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), "blocks").cast("int"), F.lit(0)))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    run = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    met = met.select("id", "t", "block", (F.col("block") != F.col("other")).alias("other"), run.alias("run"), "code")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parts, "run").sortWithinPartitions("run")
    asked = dealt.mapInArrow(lambda it: _ask(it, threshold, z), "id long, t int, block int, other boolean, run long")
    asked = durable(asked, "asked")
    # the vectors of those, by run again
    near = asked.join(coded.select("id", "w", "sig", "v"), "id").repartition(parts, "run").sortWithinPartitions("run")
    linked = durable(near.mapInArrow(lambda it: _link(it, threshold), "id long, links long, near long"), "links")
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(linked.select(F.col("id").alias("u"), F.col("near").alias("v")))
    named = (
        kinds.select("id", "h1", "h2", "least", "w")
        .join(counts, "id", "left")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = rows.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
n AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_inner_product(x, x))) AS u FROM v
  WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a, n b WHERE a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
