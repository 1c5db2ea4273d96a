"""Registry of the vector-analytics queries and their SQL twins.

Searches ask for every row whose id is divisible by 20, against all rows.  Coarse
centroids and codebooks that SQL must rebuild are the component-wise means by label.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import vector as V
from ..operators import binary, cluster, codecs, evaluate, graph, ivf, knn, maintain, refine, spec, transforms
from ..operators.ordering import global_rank
from ..session import scratch
from ..sources import store, vecs
from ..streaming import ingest

D = 64
K = 10
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- inputs ---------------------------------------------------------------------------


def _emb(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _emb_stream(spark, d) -> DataFrame:
    """The rows of embeddings as a stream, whether the table is one file or a folder of them."""
    # a pattern: a stream takes a path without one for a folder
    return spark.readStream.schema(_emb(spark, d).schema).parquet(f"{d}/embeddings.parque[t]")


def _base(spark, d) -> DataFrame:
    return knn.vectors(_emb(spark, d), "vec_id", "embedding")


def _asked(spark, d) -> DataFrame:
    return _base(spark, d).filter(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vec")


def _means(spark, d) -> tuple[np.ndarray, np.ndarray]:
    """Means by label and the labels: one row per label and dimension."""
    rows = _emb(spark, d).select(F.col("label").alias("list_no"), F.col("embedding").alias("vec"))
    got = cluster.centroid_means(rows).collect()
    labels = sorted({r.list_no for r in got})
    out = np.zeros((len(labels), D))
    for r in got:
        out[labels.index(r.list_no), r.dim] = r.mean
    return out, np.array(labels)


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols or ("distance",):
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df


_Q = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0)"
_B = "b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_C = f"c AS (SELECT label AS list_no, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, {D + 1}) t(i) GROUP BY ALL) GROUP BY label)"


def _sum(term: str, a: str = "qv", b: str = "v", n: int = D) -> str:
    """Sum over dimensions of a term in x and y."""
    return f"list_sum([{term.replace('x', f'{a}[i]').replace('y', f'{b}[i]')} for i in range(1, {n + 1})])"


_DIST = {
    "l2": _sum("(x-y)*(x-y)"),
    "ip": _sum("x*y"),
    "cosine": f"{_sum('x*y')} / sqrt({_sum('x*x')}) / sqrt({_sum('y*y')})",
    "l1": _sum("@(x-y)"),
    "linf": f"list_max([@(qv[i]-v[i]) for i in range(1, {D + 1})])",
    "lp": _sum("pow(@(x-y), 3)"),
    "canberra": _sum("CASE WHEN abs(x) + abs(y) = 0 THEN 0 ELSE abs(x-y) / (abs(x) + abs(y)) END"),
    "braycurtis": f"{_sum('@(x-y)')} / {_sum('@(x+y)')}",
}


def _knn_sql(metric: str, k: int = K, pairs: str = "q, b", extra: str = "", dist: str | None = None, where: str = "") -> str:
    order = "DESC" if metric in V.LARGEST_FIRST else ""
    return f"""WITH {_Q}, {_B}{extra},
p AS (SELECT qid, id, {dist or _DIST[metric]} AS distance FROM {pairs} {where})
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance {order}, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance
FROM p QUALIFY rank <= {k}"""


# --- exact joins ----------------------------------------------------------------------


def _exact(metric: str, p: float | None = None):
    return lambda s, d: _r(knn.knn(_asked(s, d), _base(s, d), K, metric, p))


for _m in ("l2", "ip", "cosine", "l1", "linf", "canberra", "braycurtis"):
    query(f"knn_{_m}", _knn_sql(_m))(_exact(_m))
query("knn_lp3", _knn_sql("lp"))(_exact("lp", 3.0))

_TERM = "(CASE WHEN {0} > 0 THEN {0} * ln({0} / ((abs(qv[i]) + abs(v[i])) / 2)) ELSE 0 END)"
_JS = f"list_sum([({_TERM.format('abs(qv[i])')} + {_TERM.format('abs(v[i])')}) / 2 for i in range(1, {D + 1})])"

@query("knn_jensenshannon", _knn_sql("l2", dist=_JS))
def _(s, d):
    a = lambda df, c: df.select(c, F.transform(V.doubles(F.col("vec")), F.abs).alias("vec"))
    return _r(knn.knn(a(_asked(s, d), "qid"), a(_base(s, d), "id"), K, "jensenshannon"))


@query("knn_l2_expression", _knn_sql("l2"))
def _(s, d):
    return _r(knn.knn_expression(_asked(s, d), _base(s, d), K))


@query("knn_with_vectors", f"SELECT qid, rank, id, distance, round(b.v[1], 6) + 0.0 AS first FROM ({_knn_sql('l2', 3)}) k JOIN (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) b USING (id)")
def _(s, d):
    out = knn.with_vectors(_r(knn.knn(_asked(s, d), _base(s, d), 3)), _base(s, d))
    return _r(out.withColumn("first", F.get(V.doubles(F.col("vec")), F.lit(0))).drop("vec"), "first")


@query("knn_assign", f"SELECT qid, rank, id FROM ({_knn_sql('l2', 1)})")
def _(s, d):
    return knn.assign(_asked(s, d), _base(s, d))


@query(
    "knn_graph",
    f"""WITH {_B}, a AS (SELECT id AS qid, v AS qv FROM b), p AS (SELECT qid, id, list_distance(qv, v) ** 2 AS distance FROM a, b WHERE qid <> id)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= 5""",
)
def _(s, d):
    return _r(knn.knn_graph(_base(s, d), 5))


RADIUS, SIMILAR = 1.4, 0.3


@query("range_l2", f"WITH {_Q}, {_B} SELECT qid, id, round({_DIST['l2']}, 6) + 0.0 AS distance FROM q, b WHERE {_DIST['l2']} < {RADIUS}")
def _(s, d):
    return _r(knn.range_join(_asked(s, d), _base(s, d), RADIUS))


@query("range_ip", f"WITH {_Q}, {_B} SELECT qid, id, round({_DIST['ip']}, 6) + 0.0 AS distance FROM q, b WHERE {_DIST['ip']} > {SIMILAR}")
def _(s, d):
    return _r(knn.range_join(_asked(s, d), _base(s, d), SIMILAR, "ip"))


@query(
    "range_count",
    f"WITH {_Q}, {_B}, n AS (SELECT qid, count(id) AS n FROM q LEFT JOIN b ON {_DIST['l2']} < {RADIUS} GROUP BY qid) SELECT qid, n, sum(n) OVER (ORDER BY qid)::BIGINT AS lims FROM n",
)
def _(s, d):
    return knn.range_counts(_asked(s, d), knn.range_join(_asked(s, d), _base(s, d), RADIUS))


@query(
    "range_budget",
    f"""WITH {_Q}, {_B}, p AS (SELECT qid, id, {_DIST['l2']} AS distance FROM q, b WHERE {_DIST['l2']} < {RADIUS}),
r AS (SELECT CASE WHEN (SELECT count(*) FROM p) <= 60 THEN 1e9 ELSE (SELECT max(distance) FROM (SELECT distance FROM p ORDER BY distance LIMIT 49)) END AS radius)
SELECT qid, id, round(distance, 6) + 0.0 AS distance FROM p, r WHERE distance < radius""",
)
def _(s, d):
    return _r(knn.range_budget(knn.range_join(_asked(s, d), _base(s, d), RADIUS), 60))


@query("range_tightened", f"WITH {_Q}, {_B} SELECT qid, id, round({_DIST['l2']}, 6) + 0.0 AS distance FROM q, b WHERE {_DIST['l2']} < 1.2")
def _(s, d):
    return _r(knn.filter_radius(knn.range_join(_asked(s, d), _base(s, d), RADIUS), 1.2))


@query(
    "knn_1d",
    """WITH q AS (SELECT p_partkey AS qid, p_retailprice AS x FROM part WHERE p_partkey % 20 = 0), p AS (SELECT qid, p_partkey AS id, abs(p_retailprice - x) AS distance FROM q, part)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= 5""",
)
def _(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))
    return _r(knn.knn_1d(part.filter("id % 20 = 0").select(F.col("id").alias("qid"), "x"), part, 5))


@query("pair_distances", f"WITH {_B} SELECT a.id AS qid, b.id, round(list_distance(a.v, b.v) ** 2, 6) + 0.0 AS distance FROM b a JOIN b ON b.id = a.id + 1")
def _(s, d):
    base = _base(s, d)
    pairs = base.select(F.col("id").alias("qid"), (F.col("id") + 1).alias("id"))
    return _r(knn.pair_distances(pairs, base.select(F.col("id").alias("qid"), "vec"), base))


@query("knn_among", _knn_sql("l2", 3, where="WHERE (id + qid) % 7 = 0"))
def _(s, d):
    q, b = _asked(s, d), _base(s, d)
    # candidate lists: rows whose id plus the query's is a multiple of 7
    pairs = q.select("qid", F.pmod(-F.col("qid"), F.lit(7)).alias("m")).join(b.select("id", F.pmod("id", F.lit(7)).alias("m")), "m").select("qid", "id")
    return _r(knn.knn_among(pairs, q, b, 3))


@query("knn_padded", f"WITH k AS ({_knn_sql('l2', 2)}), s AS (SELECT vec_id AS qid, r::INT AS rank FROM embeddings, range(1, 4) t(r) WHERE vec_id % 20 = 0) SELECT qid, s.rank, coalesce(id, -1) AS id, coalesce(distance, 'inf'::DOUBLE) AS distance FROM s LEFT JOIN k USING (qid, rank)")
def _(s, d):
    q = _asked(s, d)
    return knn.pad(_r(knn.knn(q, _base(s, d), 2)), q, 3)


@query("sharded_topk", _knn_sql("l2"))
def _(s, d):
    return _r(knn.sharded_knn(_asked(s, d), _base(s, d), 3, K))


@query(
    "split_search",
    f"""WITH {_Q}, {_B}, {_C},
p AS (SELECT qid, list_no, list_sum([(qv[i]-c[i])**2 for i in range(1, 33)]) AS lo, list_sum([(qv[i]-c[i])**2 for i in range(33, 65)]) AS hi FROM q, c),
m AS (SELECT qid, arg_min(list_no, lo) AS a, min(lo) AS da, arg_min(list_no, hi) AS b, min(hi) AS db FROM p GROUP BY qid)
SELECT qid, a + b * (SELECT count(*) FROM c) AS id, round(da + db, 6) + 0.0 AS distance FROM m""",
)
def _(s, d):
    c, labels = _means(s, d)
    table = s.createDataFrame([(int(n), [float(x) for x in r]) for n, r in zip(labels, c, strict=True)], "id long, vec array<double>")
    half = lambda a: table.select("id", F.slice("vec", a + 1, 32).alias("vec"))
    return _r(knn.split_search(_asked(s, d), [(0, 32, half(0)), (32, 64, half(32))]))


# --- clustering -----------------------------------------------------------------------

_ASSIGN = f"{_B}, {_C}, l AS (SELECT id, v, arg_min(list_no, (d, list_no)) AS list_no, min(d) AS d FROM (SELECT id, v, list_no, list_sum([(v[i]-c[i])**2 for i in range(1, 65)]) AS d FROM b, c) GROUP BY id, v)"


def _listed(s, d) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    c, labels = _means(s, d)
    return ivf.add(_base(s, d), c, numbers=labels), c, labels


@query("assign_label_centroids", f"WITH {_ASSIGN} SELECT id, list_no, round(d, 6) + 0.0 AS centroid_distance FROM l")
def _(s, d):
    c, labels = _means(s, d)
    return _r(cluster.assign_lists(_base(s, d), c, numbers=labels).drop("vec"), "centroid_distance")


@query("centroid_update", f"WITH {_ASSIGN} SELECT list_no, (i - 1)::INT AS dim, round(avg(v[i]), 6) + 0.0 AS mean, count(*) AS n FROM l, range(1, 65) t(i) GROUP BY ALL")
def _(s, d):
    return _r(cluster.centroid_means(_listed(s, d)[0]), "mean")


@query("kmeans_step_objective", f"WITH {_ASSIGN} SELECT round(sum(d), 5) AS objective, count(*) AS n FROM l")
def _(s, d):
    c, labels = _means(s, d)
    out = cluster.assign_lists(_base(s, d), c, numbers=labels)
    return out.agg(F.round(F.sum("centroid_distance"), 5).alias("objective"), F.count(F.lit(1)).alias("n"))


@query("imbalance", f"WITH {_ASSIGN}, n AS (SELECT count(*) AS n FROM l GROUP BY list_no) SELECT round(count(*) * sum(n * n) / (sum(n) ** 2), 6) AS imbalance FROM n")
def _(s, d):
    return _r(ivf.imbalance_factor(_listed(s, d)[0]), "imbalance")


@query("list_sizes", f"WITH {_ASSIGN} SELECT list_no, count(*) AS size FROM l GROUP BY list_no")
def _(s, d):
    return ivf.list_sizes(_listed(s, d)[0])


@query("kmeans_train")
def _(s, d):
    return cluster.kmeans(_base(s, d), 16, niter=8).table(s)


@query("kmeans_spherical")
def _(s, d):
    return cluster.kmeans(_base(s, d), 8, niter=5, metric="ip", spherical=True).table(s)


@query("kmeans_stats")
def _(s, d):
    return s.createDataFrame(cluster.kmeans(_base(s, d), 12, niter=6, nredo=2).stats, "iteration int, objective double, imbalance double, nsplit int")


@query("kmeans_1d")
def _(s, d):
    c, _ = cluster.kmeans_1d(*cluster.weighted_values(s.read.parquet(f"{d}/part.parquet"), "p_retailprice"), 8)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "list_no int, centre double")


# --- inverted lists -------------------------------------------------------------------

_PROBE = f"{_Q}, {_ASSIGN}, r AS (SELECT qid, qv, list_no, list_sum([(qv[i]-c[i])**2 for i in range(1, 65)]) AS coarse_distance FROM q, c), pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coarse_distance, list_no)::INT AS probe FROM r)"


def _ivf_sql(nprobe: int, k: int = K, more: str = "") -> str:
    return f"""WITH {_PROBE}, p AS (SELECT qid, id, l.list_no, {_DIST['l2']} AS distance FROM pr JOIN l ON l.list_no = pr.list_no WHERE probe <= {nprobe})
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance{more} FROM p QUALIFY rank <= {k}"""


def _ivf(s, d, nprobe: int, k: int | None = K, **args) -> DataFrame:
    rows, c, labels = _listed(s, d)
    q = _asked(s, d)
    return _r(ivf.search(q, rows, ivf.probe(q, c, nprobe, numbers=labels), k, **args))


query("ivf_search_np1", _ivf_sql(1))(lambda s, d: _ivf(s, d, 1))
query("ivf_search_np4", _ivf_sql(4))(lambda s, d: _ivf(s, d, 4))
query("ivf_search_all_lists", _knn_sql("l2"))(lambda s, d: _ivf(s, d, 10**6))
query("ivf_paged_search", _ivf_sql(4))(lambda s, d: _ivf(s, d, 4, page_rows=16))
query("ivf_result_lists", _ivf_sql(2, more=", list_no"))(lambda s, d: _ivf(s, d, 2, with_list=True))


@query("ivf_search_expression", _ivf_sql(4))
def _(s, d):
    rows, c, labels = _listed(s, d)
    q = _asked(s, d)
    return _r(ivf.search_expression(q, rows, ivf.probe(q, c, 4, numbers=labels), K))


@query("ivf_probe", f"WITH {_PROBE} SELECT qid, probe, list_no, round(coarse_distance, 6) + 0.0 AS coarse_distance FROM pr WHERE probe <= 4")
def _(s, d):
    c, labels = _means(s, d)
    return _r(ivf.probe(_asked(s, d), c, 4, numbers=labels), "coarse_distance")


@query("ivf_range", f"WITH {_PROBE} SELECT qid, id, round({_DIST['l2']}, 6) + 0.0 AS distance FROM pr JOIN l ON l.list_no = pr.list_no WHERE probe <= 4 AND {_DIST['l2']} < {RADIUS}")
def _(s, d):
    return _ivf(s, d, 4, None, radius=RADIUS)


_SIZED = f"{_PROBE}, z AS (SELECT list_no, count(*) AS size FROM l GROUP BY list_no), e AS (SELECT pr.*, coalesce(sum(size) OVER (PARTITION BY qid ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr JOIN z USING (list_no))"


@query(
    "ivf_max_codes",
    f"""WITH {_SIZED}, p AS (SELECT qid, id, {_DIST['l2']} AS distance FROM e JOIN l ON l.list_no = e.list_no WHERE before < 100)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= {K}""",
)
def _(s, d):
    rows, c, labels = _listed(s, d)
    q = _asked(s, d)
    return _r(ivf.search(q, rows, ivf.cut_probes(ivf.probe(q, c, 10**6, numbers=labels), rows, 100), K))


@query("ivf_statistics", f"WITH {_PROBE}, z AS (SELECT list_no, count(*) AS size FROM l GROUP BY list_no) SELECT qid, count(*) AS nlists, sum(size)::BIGINT AS ndis FROM pr JOIN z USING (list_no) WHERE probe <= 4 GROUP BY qid")
def _(s, d):
    rows, c, labels = _listed(s, d)
    return ivf.statistics(ivf.probe(_asked(s, d), c, 4, numbers=labels), rows)


@query("ivf_residuals", f"WITH {_ASSIGN} SELECT id, list_no, (i - 1)::INT AS dim, round(v[i] - c[i], 6) + 0.0 AS x FROM l JOIN c USING (list_no), range(1, 65) t(i)")
def _(s, d):
    rows, c, _ = _listed(s, d)  # labels run from 0
    return _r(spec.residuals(rows, c).select("id", "list_no", F.posexplode("vec").alias("dim", "x")), "x")


@query(
    "ivf_preassigned",
    f"""WITH {_Q}, {_B}, a AS (SELECT id, (id % 6)::INT AS list_no, v FROM b), p AS (SELECT qid, id, {_DIST['l2']} AS distance FROM q JOIN a ON a.list_no IN ((qid // 20) % 6, (qid // 20 + 1) % 6))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= {K}""",
)
def _(s, d):
    base, q = _base(s, d), _asked(s, d)
    rows = ivf.add_preassigned(base, base.select("id", (F.col("id") % 6).cast("int").alias("list_no")))
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    probes = q.select("qid", step.alias("n")).select("qid", (F.col("n") + 1).alias("probe"), F.pmod(F.floor(F.col("qid") / 20) + F.col("n"), F.lit(6)).cast("int").alias("list_no"), F.lit(0.0).alias("coarse_distance"))
    return _r(ivf.search(q, rows, probes, K))


@query("merge_results", f"WITH s AS ({_knn_sql('l2', 3)}), m AS (SELECT qid, id, distance FROM s UNION ALL SELECT qid, id + 1000000, distance FROM s) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, distance FROM m QUALIFY rank <= 4")
def _(s, d):
    found = _r(knn.knn(_asked(s, d), _base(s, d), 3))
    return knn.merge_results([found, found], 4, offsets=[0, 1_000_000])


@query(
    "multi_index_probe",
    f"""WITH {_Q}, {_C}, h AS (SELECT qid, list_no AS c, list_sum([(qv[i]-c[i])**2 for i in range(1, 33)]) AS lo, list_sum([(qv[i]-c[i])**2 for i in range(33, 65)]) AS hi FROM q, c),
p AS (SELECT a.qid, (a.c + b.c * (SELECT count(*) FROM c))::INT AS list_no, a.lo + b.hi AS d FROM h a JOIN h b USING (qid))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, list_no)::INT AS probe, list_no, round(d, 6) + 0.0 AS coarse_distance FROM p QUALIFY probe <= 8""",
)
def _(s, d):
    c, _ = _means(s, d)
    return _r(ivf.multi_index_probe(_asked(s, d), [c[:, :32], c[:, 32:]], 8), "coarse_distance")


@query("ivf_trained_search")
def _(s, d):
    base, q = _base(s, d), _asked(s, d)
    c = ivf.train(base, 16)
    return _r(ivf.search(q, ivf.add(base, c), ivf.probe(q, c, 4), K))


# --- codecs ---------------------------------------------------------------------------

_RANGE = "m AS (SELECT i, min(embedding[i]::DOUBLE) AS lo, max(embedding[i]::DOUBLE) - min(embedding[i]::DOUBLE) AS w FROM embeddings, range(1, 65) t(i) GROUP BY i)"
_CODE = "CASE WHEN w = 0 THEN 0 ELSE trunc(least(greatest((embedding[i]::DOUBLE - lo) / w, 0), 1) * {n})::INT END"


@query("sq8_roundtrip", f"WITH {_RANGE} SELECT vec_id AS id, (i - 1)::INT AS dim, round(({_CODE.format(n=255)} + 0.5) / 255 * w + lo, 6) + 0.0 AS x FROM embeddings, m")
def _(s, d):
    base = _base(s, d)
    sq = codecs.ScalarQuantizer.train(base, "8bit")
    out = base.select("id", sq.decode_column(sq.encode_column(F.col("vec"))).alias("v"))
    return _r(out.select("id", F.posexplode("v").alias("dim", "x")), "x")


@query("sq4_codes", f"WITH {_RANGE} SELECT vec_id AS id, (i - 1)::INT AS dim, {_CODE.format(n=15)} AS code FROM embeddings, m")
def _(s, d):
    base = _base(s, d)
    sq = codecs.ScalarQuantizer.train(base, "4bit")
    return base.select("id", F.posexplode(sq.encode_column(F.col("vec"))).alias("dim", "code"))


@query("sq8_uniform_codes", f"WITH m AS (SELECT min(x) AS lo, max(x) - min(x) AS w FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)) SELECT vec_id AS id, (i - 1)::INT AS dim, {_CODE.format(n=255)} AS code FROM embeddings, m, range(1, 65) t(i)")
def _(s, d):
    base = _base(s, d)
    sq = codecs.ScalarQuantizer.train(base, "8bit_uniform")
    return sq.encode(base).select("id", F.posexplode("code").alias("dim", "code"))


@query("sq6_ranges", "SELECT (i - 1)::INT AS dim, round(avg(x) - 2 * stddev_pop(x), 6) + 0.0 AS lo, round(avg(x) + 2 * stddev_pop(x), 6) + 0.0 AS hi FROM (SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)) GROUP BY i")
def _(s, d):
    sq = codecs.ScalarQuantizer.train(_base(s, d), "6bit", "meanstd", 2.0)
    rows = [(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(sq.vmin, sq.vdiff, strict=True))]
    return _r(s.createDataFrame(rows, "dim int, lo double, hi double"), "lo", "hi")


_BOOK = f"{_C}, k AS (SELECT m, list_no AS code, c[m * 16 + 1 : m * 16 + 16] AS s FROM c, range(0, 4) t(m))"
_PQ = f"{_B}, {_BOOK}, e AS (SELECT id, m, arg_min(code, (d, code)) AS code FROM (SELECT id, m, code, list_sum([(v[m * 16 + i] - s[i])**2 for i in range(1, 17)]) AS d FROM b, k) GROUP BY id, m)"


def _pq(s, d) -> codecs.ProductQuantizer:
    c, _ = _means(s, d)
    return codecs.ProductQuantizer(np.stack(np.split(c, 4, axis=1)))


@query("pq_encode", f"WITH {_PQ} SELECT id, m::INT AS m, code::INT AS code FROM e")
def _(s, d):
    return _pq(s, d).encode(_base(s, d)).select("id", F.posexplode("code").alias("m", "code"))


@query(
    "pq_adc_topk",
    f"""WITH {_Q}, {_PQ}, t AS (SELECT qid, m, code, list_sum([(qv[m * 16 + i] - s[i])**2 for i in range(1, 17)]) AS d FROM q, k),
p AS (SELECT qid, id, sum(d) AS distance FROM e JOIN t USING (m, code) GROUP BY qid, id)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= {K}""",
)
def _(s, d):
    pq, base = _pq(s, d), _base(s, d)
    # equal codes have the same sums of table entries, and tie by id
    return _r(pq.search(_asked(s, d), pq.encode(base), K))


@query(
    "pq_generalized_hamming",
    f"""WITH {_PQ}, x AS (SELECT id, list(code ORDER BY m) AS w FROM e GROUP BY id), p AS (SELECT a.id AS qid, x.id, list_sum([CASE WHEN a.w[i] = x.w[i] THEN 0 ELSE 1 END for i in range(1, 5)])::DOUBLE AS distance FROM x a, x WHERE a.id % 20 = 0)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, distance FROM p QUALIFY rank <= {K}""",
)
def _(s, d):
    pq, base = _pq(s, d), _base(s, d)
    return pq.search(_asked(s, d), pq.encode(base), K, kind="generalized")


@query("pq_symmetric_table", f"WITH {_BOOK} SELECT a.m::INT AS m, a.code::INT AS a, b.code::INT AS b, round(list_distance(a.s, b.s) ** 2, 6) + 0.0 AS distance FROM k a JOIN k b USING (m)")
def _(s, d):
    t = _pq(s, d).symmetric_tables()
    rows = [(m, a, b, float(t[m, a, b])) for m in range(t.shape[0]) for a in range(t.shape[1]) for b in range(t.shape[2])]
    return _r(s.createDataFrame(rows, "m int, a int, b int, distance double"))


@query("pq_code_duplicates", f"WITH {_PQ}, w AS (SELECT id, string_agg(code, ',' ORDER BY m) AS code FROM e GROUP BY id) SELECT code, string_agg(id, ',' ORDER BY id) AS ids FROM w GROUP BY code HAVING count(*) > 1")
def _(s, d):
    coded = _pq(s, d).encode(_base(s, d)).select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))
    return maintain.duplicate_groups(coded, ["code"]).select("code", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    "refine_topk",
    f"""WITH {_Q}, {_B}, {_RANGE}, y AS (SELECT vec_id AS id, list(({_CODE.format(n=15)} + 0.5) / 15 * w + lo ORDER BY i) AS v FROM embeddings, m GROUP BY vec_id),
c AS (SELECT qid, id, {_DIST['l2']} AS d FROM q, y QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) <= 40),
p AS (SELECT qid, id, {_DIST['l2']} AS distance FROM c JOIN q USING (qid) JOIN b USING (id))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= {K}""",
)
def _(s, d):
    base, q = _base(s, d), _asked(s, d)
    sq = codecs.ScalarQuantizer.train(base, "4bit")
    return _r(refine.refine(sq.search(q, sq.encode(base), refine.base_k(K, 4.0)), q, base, K))


@query("pq_trained_search")
def _(s, d):
    base = _base(s, d)
    pq = codecs.ProductQuantizer.train(base, 8, 4, niter=8)
    return _r(pq.search(_asked(s, d), pq.encode(base), K))


@query("pq_polysemous_search")
def _(s, d):
    base = _base(s, d)
    pq = codecs.ProductQuantizer.train(base, 8, 4, niter=8).polysemous(2000)
    return _r(pq.search(_asked(s, d), pq.encode(base), K, kind="polysemous", ht=12))


@query("residual_quantizer_search")
def _(s, d):
    base = _base(s, d)
    rq = codecs.ResidualQuantizer.train(base, 4, 4, niter=6)
    return _r(rq.search(_asked(s, d), rq.encode(base), K))


@query("local_search_quantizer_search")
def _(s, d):
    base = _base(s, d)
    lsq = codecs.LocalSearchQuantizer.fit(codecs.sample_matrix(base, 4096), 4, 4, train_rounds=3)
    return _r(lsq.search(_asked(s, d), lsq.encode(base), K))


@query("lattice_roundtrip")
def _(s, d):
    base = _base(s, d)
    codec = codecs.LatticeCodec.train(base, 8, 10, 6)
    back = codec.decode(codec.encode(base).select("id", "code")).select("id", F.col("vec").alias("back"))
    return base.join(back, "id").select("id", F.round(V.l2(F.col("vec"), F.col("back")), 6).alias("error"))


# --- binary ---------------------------------------------------------------------------

_BITS = "z AS (SELECT vec_id AS id, [CASE WHEN x >= 0 THEN 1 ELSE 0 END for x in embedding] AS w FROM embeddings)"
_HAM = f"list_sum([abs(a.w[i] - z.w[i]) for i in range(1, {D + 1})])::INT"
_BQ = f"{_BITS}, a AS (SELECT id AS qid, w FROM z WHERE id % 20 = 0)"


def _codes(s, d) -> tuple[DataFrame, DataFrame]:
    rows = _base(s, d).select("id", V.pack_bits(V.sign_bits(F.col("vec")), D).alias("code"))
    return rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), "code"), rows


_HAMKNN = f"WITH {_BQ}, p AS (SELECT qid, z.id, {_HAM} AS distance FROM a, z) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, distance FROM p QUALIFY rank <= {K}"


@query("lsh_hamming_knn", _HAMKNN)
def _(s, d):
    return binary.hamming_knn(*_codes(s, d), K)


@query("hamming_knn_by_real", _HAMKNN)
def _(s, d):
    return binary.knn_by_real(*_codes(s, d), K, D)


@query("hamming_range", f"WITH {_BQ} SELECT qid, z.id, {_HAM} AS distance FROM a, z WHERE {_HAM} < 24")
def _(s, d):
    return binary.hamming_range(*_codes(s, d), 24)


@query("hamming_count", f"WITH {_BQ} SELECT count(*) AS n FROM a, z WHERE {_HAM} < 28")
def _(s, d):
    return binary.hamming_count(*_codes(s, d), 28)


def _flips(lo: int, hi: int) -> str:
    return f"list_sum([abs(a.w[i] - z.w[i]) for i in range({lo}, {hi})])"


@query("hash_bucket_join", f"WITH {_BQ} SELECT qid, z.id, {_HAM} AS distance FROM a, z WHERE {_flips(1, 9)} <= 1")
def _(s, d):
    return binary.hash_candidates(*_codes(s, d), 8, 1)


@query("multihash_range", f"WITH {_BQ} SELECT qid, z.id, {_HAM} AS distance FROM a, z WHERE ({_flips(1, 9)} <= 1 OR {_flips(9, 17)} <= 1 OR {_flips(17, 25)} <= 1) AND {_HAM} < 26")
def _(s, d):
    return binary.hash_range(*_codes(s, d), 26, 8, 1, 3)


@query("bit_histogram", f"WITH {_BITS} SELECT (i - 1)::INT AS bit, sum(w[i])::BIGINT AS n FROM z, range(1, 65) t(i) GROUP BY i")
def _(s, d):
    return evaluate.bit_histogram(_base(s, d).select(V.sign_bits(F.col("vec")).alias("bits")))


@query("lsh_median_bits", "WITH m AS (SELECT i, quantile_cont(embedding[i]::DOUBLE, 0.5) AS t FROM embeddings, range(1, 65) t(i) GROUP BY i) SELECT vec_id AS id, sum(CASE WHEN embedding[i] >= t THEN 1 ELSE 0 END)::INT AS ones FROM embeddings, m GROUP BY vec_id")
def _(s, d):
    base = _base(s, d)
    bits = codecs.lsh_bits(F.col("vec"), codecs.median_thresholds(base))
    return base.select("id", F.aggregate(bits, F.lit(0), lambda a, b: a + b).alias("ones"))


@query("spectral_bits", f"WITH {_ASSIGN} SELECT id, list_sum([(floor((v[i] - c[i]) * 2 / 0.25)::INT % 2 + 2) % 2 for i in range(1, 65)])::INT AS ones FROM l JOIN c USING (list_no)")
def _(s, d):
    rows, c, labels = _listed(s, d)
    table = s.createDataFrame([(int(n), [float(x) for x in r]) for n, r in zip(labels, c, strict=True)], "list_no int, c array<double>")
    bits = codecs.spectral_bits(F.col("vec"), F.col("c"), 0.25)
    return rows.join(F.broadcast(table), "list_no").select("id", F.aggregate(bits, F.lit(0), lambda a, b: a + b).alias("ones"))


@query("binary_ivf_search")
def _(s, d):
    return binary.binary_ivf_search(*_codes(s, d), D, 8, 4, K)


# --- transforms and statistics ----------------------------------------------------------


@query("l2_normalize", "SELECT vec_id AS id, (i - 1)::INT AS dim, round(embedding[i]::DOUBLE / sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) + 0.0 AS x FROM embeddings, range(1, 65) t(i)")
def _(s, d):
    return _r(_base(s, d).select("id", F.posexplode(V.normalize(F.col("vec"))).alias("dim", "x")), "x")


@query("center", "WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY i) SELECT vec_id AS id, (i - 1)::INT AS dim, round(embedding[i]::DOUBLE - m, 6) + 0.0 AS x FROM embeddings, m")
def _(s, d):
    base = _base(s, d)
    return _r(transforms.centring(base).apply(base).select("id", F.posexplode("vec").alias("dim", "x")), "x")


@query("pad_dims", "SELECT vec_id AS id, (i - 1)::INT AS dim, round(coalesce(embedding[i], 0)::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(1, 73) t(i)")
def _(s, d):
    pad = transforms.Remap.pad(D, 72)
    return _r(_base(s, d).select("id", F.posexplode(pad.column(F.col("vec"))).alias("dim", "x")), "x")


_DCT = f"cos(pi() * (i - 0.5) * j / {D})"


@query("linear_transform", f"SELECT vec_id AS id, j::INT AS dim, round(list_sum([embedding[i]::DOUBLE * {_DCT} for i in range(1, 65)]), 6) + 0.0 AS x FROM embeddings, range(0, 8) t(j)")
def _(s, d):
    a = np.array([[math.cos(math.pi * (i + 0.5) * j / D) for i in range(D)] for j in range(8)])
    return _r(transforms.Linear(a).apply(_base(s, d)).select("id", F.posexplode("vec").alias("dim", "x")), "x")


@query("linear_transform_expression", f"SELECT vec_id AS id, j::INT AS dim, round(list_sum([embedding[i]::DOUBLE * {_DCT} for i in range(1, 65)]), 6) + 0.0 AS x FROM embeddings, range(0, 4) t(j)")
def _(s, d):
    a = np.array([[math.cos(math.pi * (i + 0.5) * j / D) for i in range(D)] for j in range(4)])
    return _r(_base(s, d).select("id", F.posexplode(transforms.Linear(a).column(F.col("vec"))).alias("dim", "x")), "x")


@query("covariance", "SELECT (i - 1)::INT AS a, (j - 1)::INT AS b, round(covar_pop(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 6) + 0.0 AS x FROM embeddings, range(1, 65) t(i), range(1, 65) u(j) GROUP BY i, j")
def _(s, d):
    _, _, cov = transforms.moments(_base(s, d))
    rows = [(a, b, float(cov[a, b])) for a in range(D) for b in range(D)]
    return _r(s.createDataFrame(rows, "a int, b int, x double"), "x")


@query(
    "matrix_stats",
    """SELECT (i - 1)::INT AS dim, count(*) AS n, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, count(CASE WHEN x = 0 THEN 1 END) AS n_zero,
round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std
FROM (SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)) GROUP BY i""",
)
def _(s, d):
    return _r(evaluate.matrix_stats(_base(s, d)), "lo", "hi", "mean", "std")


_FEATURES = "[l_quantity, l_extendedprice, l_discount, l_tax]"


@query("feature_stats", f"SELECT (i - 1)::INT AS dim, count(*) AS n, round(min(x), 4) AS lo, round(max(x), 4) AS hi, round(avg(x), 4) AS mean FROM (SELECT i, {_FEATURES}[i] AS x FROM lineitem, range(1, 5) t(i)) GROUP BY i")
def _(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("vec"))
    return _r(evaluate.matrix_stats(rows).select("dim", "n", "lo", "hi", "mean"), "lo", "hi", "mean", digits=4)


@query("vector_stats", "WITH n AS (SELECT embedding, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS norm FROM embeddings) SELECT count(*) AS n, count(DISTINCT embedding) AS n_distinct, round(min(norm), 6) AS lo_norm, round(max(norm), 6) AS hi_norm, max(norm) < 1.0001 * min(norm) AS normalised FROM n")
def _(s, d):
    out = evaluate.vector_stats(_base(s, d))
    return _r(out.withColumn("n", F.col("n").cast("long")), "lo_norm", "hi_norm")


@query(
    "vector_arithmetic",
    f"""WITH {_B} SELECT a.id, round(list_sum([a.v[i] + b.v[i] for i in range(1, 65)]), 5) + 0.0 AS added, round(list_sum([a.v[i] - 0.5 * b.v[i] for i in range(1, 65)]), 5) + 0.0 AS combined,
(list_position(a.v, list_min(a.v)) - 1)::INT AS least, round(list_sort(a.v)[2], 6) + 0.0 AS second FROM b a JOIN b ON b.id = a.id + 1""",
)
def _(s, d):
    a = _base(s, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    v, w = V.doubles(F.col("vec")), V.doubles(F.col("w"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda p, q: p + q)
    out = a.join(b, "id").select("id", total(V.add(v, w)).alias("added"), total(V.madd(v, -0.5, w)).alias("combined"), V.argmin(v).alias("least"), F.get(V.kmin(v, 2), F.lit(1)).alias("second"))
    return _r(_r(out, "added", "combined", digits=5), "second")


@query(
    "vector_reflect",
    f"""WITH {_B}, u AS (SELECT a.id, a.v, [x / sqrt(list_inner_product(b.v, b.v)) for x in b.v] AS u FROM b a JOIN b ON b.id = a.id + 1)
SELECT id, (i - 1)::INT AS dim, round(v[i] - 2 * list_inner_product(v, u) * u[i], 6) + 0.0 AS x FROM u, range(1, 65) t(i)""",
)
def _(s, d):
    a = _base(s, d)
    b = a.select((F.col("id") - 1).alias("id"), V.normalize(F.col("vec")).alias("u"))
    return _r(a.join(b, "id").select("id", F.posexplode(V.reflect(F.col("vec"), F.col("u"))).alias("dim", "x")), "x")


@query("bit_shuffle", f"WITH {_BITS} SELECT id, list_sum([w[64 - i] * (1 << i) for i in range(0, 16)])::BIGINT AS code, list_sum(w)::BIGINT AS checksum FROM z")
def _(s, d):
    bits = V.sign_bits(F.col("vec"))
    return _base(s, d).select("id", F.get(V.pack_bits(V.select_bits(bits, [63 - i for i in range(16)]), 16), F.lit(0)).alias("code"), V.checksum(bits).alias("checksum"))


@query("nth_smallest", "SELECT vec_id AS id, round(list_sort(embedding)[9]::DOUBLE, 6) + 0.0 AS x FROM embeddings")
def _(s, d):
    return _r(_base(s, d).select("id", V.nth_smallest(V.doubles(F.col("vec")), 8).alias("x")), "x")


@query("pca_project")
def _(s, d):
    base = _base(s, d)
    return _r(transforms.pca(base, 8).apply(base).select("id", F.posexplode("vec").alias("dim", "x")), "x")


@query("opq_roundtrip_error")
def _(s, d):
    base = _base(s, d)
    moved = transforms.opq(base, 8, bits=4, niter=3).apply(base)
    pq = codecs.ProductQuantizer.train(moved, 8, 4, niter=8)
    back = pq.decode(pq.encode(moved).select("id", "code")).select("id", F.col("vec").alias("back"))
    return moved.join(back, "id").select("id", F.round(V.l2(F.col("vec"), F.col("back")), 6).alias("error"))


@query("itq_codes")
def _(s, d):
    base = _base(s, d)
    return transforms.itq(base, 32, niter=10).apply(base).select("id", V.pack_bits(V.sign_bits(F.col("vec")), 32).alias("code"))


# --- maintenance ----------------------------------------------------------------------

_SUM = "round(list_sum([x::DOUBLE for x in embedding]), 5) + 0.0"


def _digest(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, s): each row with the sum of its components."""
    return _r(df.select(*keys, "id", F.aggregate(V.doubles(F.col("vec")), F.lit(0.0), lambda a, b: a + b).alias("s")), "s", digits=5)


@query("remove_ids", f"SELECT vec_id AS id, {_SUM} AS s FROM embeddings WHERE NOT (vec_id >= 10 AND vec_id < 100)")
def _(s, d):
    return _digest(maintain.remove_ids(_base(s, d), maintain.IdRange(10, 100)))


@query("remove_listed_ids", f"SELECT vec_id AS id, {_SUM} AS s FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def _(s, d):
    ids = s.read.parquet(f"{d}/part.parquet").filter("p_size > 25").select(F.col("p_partkey").alias("id"))
    return _digest(maintain.remove_ids(_base(s, d), maintain.IdTable(ids)))


@query("update_vectors", f"SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END * ({_SUM}) + 0.0 AS s FROM embeddings")
def _(s, d):
    base = _base(s, d)
    new = base.filter("id % 3 = 0").select("id", F.transform("vec", lambda x: -x).alias("vec"))
    return _r(_digest(maintain.update_vectors(base, new)), "s", digits=5)


@query("merge_shifted", f"SELECT vec_id AS id, {_SUM} AS s FROM embeddings UNION ALL SELECT vec_id + 1000000, {_SUM} FROM embeddings")
def _(s, d):
    return _digest(maintain.merge(_base(s, d), _base(s, d), 1_000_000, ("Flat", "Flat")))


@query("copy_subset_modulo", f"SELECT vec_id AS id, {_SUM} AS s FROM embeddings WHERE vec_id % 5 = 2")
def _(s, d):
    return _digest(maintain.copy_subset(_base(s, d), "modulo", 5, 2))


@query(
    "copy_subset_share",
    f"""WITH {_ASSIGN}, t AS (SELECT count(*) AS n FROM l), z AS (SELECT list_no, count(*) AS c FROM l GROUP BY list_no), e AS (SELECT list_no, c, sum(c) OVER (ORDER BY list_no) AS e FROM z),
g AS (SELECT list_no, (floor(e * 100.0 / n) - floor((e - c) * 100.0 / n))::INT AS lo, (floor(e * 300.0 / n) - floor((e - c) * 300.0 / n))::INT AS hi FROM e, t),
o AS (SELECT list_no, id, row_number() OVER (PARTITION BY list_no ORDER BY id) - 1 AS place FROM l)
SELECT list_no, id FROM o JOIN g USING (list_no) WHERE place >= lo AND place < hi""",
)
def _(s, d):
    return maintain.copy_subset(_listed(s, d)[0], "share", 100, 300).select("list_no", "id")


@query("stop_lists", f"WITH {_ASSIGN} SELECT list_no, id FROM l WHERE list_no IN (SELECT list_no FROM l GROUP BY list_no HAVING count(*) <= 50)")
def _(s, d):
    return maintain.stop_lists(_listed(s, d)[0], 50).select("list_no", "id")


@query("mask_lists", f"WITH {_ASSIGN} SELECT list_no, id FROM l WHERE list_no % 2 = 0 UNION ALL SELECT list_no, id + 1000000 FROM l WHERE list_no % 2 <> 0")
def _(s, d):
    rows = _listed(s, d)[0].select("list_no", "id")
    return maintain.mask_lists(rows.filter("list_no % 2 = 0"), maintain.shift_ids(rows, 1_000_000))


@query("stack_lists", f"WITH {_ASSIGN} SELECT list_no, id FROM l UNION ALL SELECT list_no + 10, id FROM l")
def _(s, d):
    rows = _listed(s, d)[0].select("list_no", "id")
    return maintain.stack_vertically([(rows, 10), (rows, 10)])


@query("slice_lists", f"WITH {_ASSIGN} SELECT list_no - 2 AS list_no, id FROM l WHERE list_no >= 2 AND list_no < 6")
def _(s, d):
    return maintain.slice_lists(_listed(s, d)[0], 2, 6).select("list_no", "id")


@query("dedup_groups", "SELECT list_min(ids) AS rep, len(ids)::INT AS n FROM (SELECT list(id) AS ids FROM (SELECT vec_id AS id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings) GROUP BY embedding HAVING count(*) > 1)")
def _(s, d):
    both = maintain.merge(_base(s, d), _base(s, d), 1_000_000)
    return maintain.duplicate_groups(both, ["vec"]).select(F.array_min("ids").alias("rep"), F.size("ids").alias("n"))


@query(
    "dedup_knn_expand",
    f"""WITH {_Q}, {_B}, u AS (SELECT * FROM b UNION ALL SELECT id + 1000000, v FROM b), p AS (SELECT qid, id, round({_DIST['l2']}, 9) AS distance FROM q, u)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= {K}""",
)
def _(s, d):
    both = maintain.merge(_base(s, d), _base(s, d), 1_000_000)
    reps, instances = ivf.deduplicate(both)
    found = knn.knn(_asked(s, d), reps, K)
    found = found.withColumn("distance", F.round("distance", 9))
    return _r(ivf.expand_duplicates(found, instances, K))


@query("window_slices_knn", _knn_sql("l2", where="WHERE id * 10 // ((SELECT max(vec_id) FROM embeddings) + 1) > 6"))
def _(s, d):
    """The three newest of ten slices of the whole table."""
    rows = _base(s, d)
    last = rows.agg(F.max("id")).first()[0] or 0
    rows = rows.withColumn("slice", F.floor(F.col("id") * 10 / F.lit(last + 1)))
    return _r(knn.knn(_asked(s, d), maintain.window_of(rows, "slice", 9, 3), K))


@query("window_list_ends", f"WITH {_ASSIGN} SELECT list_no, (id % 4)::INT AS slice, count(*) AS size, sum(count(*)) OVER (PARTITION BY list_no ORDER BY id % 4)::BIGINT AS \"end\" FROM l GROUP BY list_no, id % 4")
def _(s, d):
    rows = _listed(s, d)[0]
    window = maintain.SlidingWindow()
    for i in range(4):
        window = window.step(rows.filter(F.col("id") % 4 == i), False)
    return window.list_ends()


@query("global_rank", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events")
def _(s, d):
    return global_rank(s.read.parquet(f"{d}/events.parquet").select("event_id", "value"), "value", ties=["event_id"]).select("event_id", "place")


# --- evaluation -----------------------------------------------------------------------


@query("recall_at_r", f"WITH t AS ({_knn_sql('l2', 1)}), f AS ({_ivf_sql(2)}), h AS (SELECT t.qid, f.rank FROM t LEFT JOIN f USING (qid, id)) SELECT r::INT AS r, avg(CASE WHEN rank <= r THEN 1.0 ELSE 0.0 END) AS recall FROM h, (SELECT unnest([1, 5, 10]) AS r) GROUP BY r")
def _(s, d):
    return evaluate.recall_at(_ivf(s, d, 2), knn.knn(_asked(s, d), _base(s, d), 1), [1, 5, 10])


@query("intersection_at_r", f"WITH t AS ({_knn_sql('l2')}), f AS ({_ivf_sql(2)}) SELECT round(count(*) / (SELECT count(DISTINCT qid) * {K} FROM t), 6) AS intersection FROM t JOIN f USING (qid, id)")
def _(s, d):
    return _r(evaluate.intersection_at(_ivf(s, d, 2), knn.knn(_asked(s, d), _base(s, d), K), K), "intersection")


_TRUE = f"WITH {_Q}, {_B} SELECT qid, id, {_DIST['l2']} AS distance FROM q, b WHERE {_DIST['l2']} < {RADIUS}"
_FOUND = f"WITH {_PROBE} SELECT qid, id, {_DIST['l2']} AS distance FROM pr JOIN l ON l.list_no = pr.list_no WHERE probe <= 4 AND {_DIST['l2']} < {RADIUS}"


@query("range_precision_recall", f"WITH t AS ({_TRUE}), f AS ({_FOUND}) SELECT round((SELECT count(*) FROM t JOIN f USING (qid, id)) / (SELECT count(*) FROM f), 6) AS precision, round((SELECT count(*) FROM t JOIN f USING (qid, id)) / (SELECT count(*) FROM t), 6) AS recall")
def _(s, d):
    q = _asked(s, d)
    return _r(evaluate.range_precision_recall(q, _ivf(s, d, 4, None, radius=RADIUS), knn.range_join(q, _base(s, d), RADIUS)), "precision", "recall")


@query(
    "range_precision_recall_at",
    f"""WITH t AS ({_TRUE}), f AS ({_FOUND}), h AS (SELECT r AS threshold, count(*) AS n, count(t.id) AS k FROM (SELECT unnest([1.2::DOUBLE, 1.3::DOUBLE, 1.4::DOUBLE]) AS r) JOIN f ON f.distance < r LEFT JOIN t USING (qid, id) GROUP BY r)
SELECT threshold, round(k / n, 6) AS precision, round(k / (SELECT count(*) FROM t), 6) AS recall FROM h""",
)
def _(s, d):
    q = _asked(s, d)
    truth = knn.range_join(q, _base(s, d), RADIUS)
    return _r(evaluate.range_precision_recall_at(_ivf(s, d, 4, None, radius=RADIUS), truth, [1.2, 1.3, 1.4]), "precision", "recall")


@query("pareto_frontier", "WITH p AS (SELECT p_partkey AS key, p_size::DOUBLE AS perf, p_retailprice AS t FROM part) SELECT key, perf, t FROM p WHERE perf > 0 AND NOT EXISTS (SELECT 1 FROM p o WHERE (o.perf > p.perf AND o.t <= p.t) OR (o.perf = p.perf AND (o.t < p.t OR o.t = p.t AND o.key < p.key)))")
def _(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    return evaluate.pareto(part.select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("perf"), F.col("p_retailprice").alias("t")))


# --- graphs, specifications -------------------------------------------------------------


@query("hnsw_search")
def _(s, d):
    rows = graph.with_shards(_base(s, d))
    return _r(graph.graph_search(_asked(s, d), rows, graph.hnsw_build(rows, 8), K, 64))


@query("nsg_search")
def _(s, d):
    rows = graph.with_shards(_base(s, d))
    return _r(graph.graph_search(_asked(s, d), rows, graph.nsg_build(rows, 12, 24), K, 64))


@query("nn_descent_graph")
def _(s, d):
    return _r(graph.nn_descent(_base(s, d), 8))


def _spec(text: str, **args):
    return lambda s, d: _r(spec.build(text, _base(s, d), niter=6).add(_base(s, d)).search(_asked(s, d), K, **args))


query("spec_flat", _knn_sql("l2"))(_spec("Flat"))
query("spec_ivf_flat")(_spec("IVF16,Flat", nprobe=4))
query("spec_ivf_pq_refined")(_spec("IVF16,PQ8x4,RFlat", nprobe=8, k_factor=4.0))
query("spec_opq_ivf_pq")(_spec("OPQ8_32,IVF16,PQ8x4", nprobe=8))
query("spec_pca_sq8")(_spec("PCA32,SQ8"))
query("spec_ivf_sq8")(_spec("IVF16,SQ8", nprobe=4))


# --- files and streams ------------------------------------------------------------------


@query("vecs_round_trip", f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, {_SUM} AS s FROM embeddings")
def _(s, d):
    path = scratch(s, "vecs")
    vecs.write_vecs(_base(s, d), path)
    return _digest(vecs.read_vecs_folder(s, path))


@query("saved_index_search", _knn_sql("l2"))
def _(s, d):
    path = scratch(s, "index")
    store.save(spec.build("IVF16,Flat", _base(s, d), niter=3).add(_base(s, d)), path)
    return _r(store.load(s, path).search(_asked(s, d), K, nprobe=16))


@query("stream_ingest", f"WITH {_ASSIGN} SELECT id, list_no FROM l")
def _(s, d):
    c, labels = _means(s, d)
    path = scratch(s, "postings")
    ingest.ingest(knn.vectors(_emb_stream(s, d), "vec_id", "embedding"), c, path, scratch(s, "stream"), numbers=labels).awaitTermination()
    return ingest.postings(s, path).select("id", "list_no")


@query("index_bytes_search", _knn_sql("l2"))
def _(s, d):
    index = spec.build("IVF16,Flat", _base(s, d), niter=3).add(_base(s, d))
    return _r(store.index_from_bytes(s, store.index_to_bytes(index)).search(_asked(s, d), K, nprobe=16))


@query("saved_binary_search", _HAMKNN)
def _(s, d):
    path = scratch(s, "binary")
    q, rows = _codes(s, d)
    store.save_binary(spec.build_binary("BFlat", rows, D), path)
    return store.load_binary(s, path).search(q, K)


@query("lists_in_folders_search", _knn_sql("l2"))
def _(s, d):
    """Postings stored by list; all lists are probed, so all rows are found."""
    base, q = _base(s, d), _asked(s, d)
    c = ivf.train(base, 16, niter=3)
    return _r(ivf.search(q, ivf.store(ivf.add(base, c), scratch(s, "lists")), ivf.probe(q, c, 16), K))


@query("vector_set_ground_truth", _knn_sql("l2"))
def _(s, d):
    return _r(vecs.VectorSet(_base(s, d), _asked(s, d)).ground_truth(K, 4))


@query("stream_window_counts", f"WITH {_ASSIGN} SELECT list_no, id // 100 AS window_no, count(*) AS n FROM l GROUP BY ALL")
def _(s, d):
    """List sizes by event-time windows of a stream; every vector is a second of event time."""
    c, labels = _means(s, d)
    rows = knn.vectors(_emb_stream(s, d), "vec_id", "embedding").withColumn("at", F.timestamp_seconds("id"))
    counts = ingest.windowed_counts(rows, c, "at", "100 seconds", "1 day")
    path, out = scratch(s, "window-checkpoint"), scratch(s, "windows")
    # complete mode: every batch gives all counts so far, and the last one stands
    sink = lambda found, number: found.write.mode("overwrite").parquet(out)
    counts.writeStream.foreachBatch(sink).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", path).start().awaitTermination()
    number = F.element_at(F.lit([int(v) for v in labels]), F.col("list_no") + 1)
    return s.read.parquet(out).select(number.cast("int").alias("list_no"), F.floor(F.unix_timestamp("window.start") / 100).alias("window_no"), "n")


@query("stream_queries", _knn_sql("l2"))
def _(s, d):
    """A stream of queries against stored postings, all lists probed."""
    base = _base(s, d)
    c = ivf.train(base, 16, niter=3)
    lists, out = ivf.store(ivf.add(base, c), scratch(s, "lists")), scratch(s, "answers")
    asked = knn.vectors(_emb_stream(s, d).filter("vec_id % 20 = 0"), "vec_id", "embedding", "qid")
    sink = lambda found, number: found.write.mode("overwrite").parquet(f"{out}/batch={number}")
    ingest.query_stream(asked, lists, c, K, 16, sink, scratch(s, "queries-checkpoint")).awaitTermination()
    return _r(s.read.option("basePath", out).parquet(out).select("qid", "rank", "id", "distance"))


# --- further forms of search -----------------------------------------------------------


@query("range_by_topk", _SQL["range_l2"])
def _(s, d):
    return _r(knn.range_by_topk(_asked(s, d), _base(s, d), RADIUS, 3))


@query("range_in_blocks", _SQL["range_l2"])
def _(s, d):
    return _r(knn.range_in_blocks(_asked(s, d), _base(s, d), RADIUS, 1 << 40)[0])


@query("index_range_search", _SQL["range_l2"])
def _(s, d):
    index = spec.build("IVF16,Flat", _base(s, d), niter=3).add(_base(s, d))
    return _r(index.range_search(_asked(s, d), RADIUS, nprobe=16))


_TWICE = "b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 3 = 0)"


def _twice(s, d) -> DataFrame:
    base = _base(s, d)
    return base.unionByName(base.filter("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000))


@query("flat_dedup_search", _knn_sql("l2").replace(_B, _TWICE))
def _(s, d):
    """Identical vectors stored once, added in two parts, all of them in the results."""
    index = spec.build("IVF16,FlatDedup", _base(s, d), niter=3).add(_base(s, d))
    return _r(index.add(_twice(s, d).filter("id >= 1000000")).search(_asked(s, d), K, nprobe=16))


@query("replica_search", _knn_sql("l2"))
def _(s, d):
    index = spec.build("Flat", _base(s, d)).add(_base(s, d))
    return _r(spec.replica_search([index, index.clone()], _asked(s, d), K))


@query("reset_and_add", _knn_sql("l2"))
def _(s, d):
    index = spec.build("SQ8,RFlat", _base(s, d)).add(_twice(s, d))
    return _r(index.reset().add(_base(s, d)).search(_asked(s, d), K, k_factor=8.0))


_FAR = 1e6


@query("knn_far_from_origin", f"WITH {_Q}, {_B}, p AS (SELECT qid, id, {_sum('((x + 1e6) - (y + 1e6)) * ((x + 1e6) - (y + 1e6))')} AS distance FROM q, b) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= {K}")
def _(s, d):
    """Vectors whose norms are huge against their distances."""
    far = F.transform(F.col("vec").cast("array<double>"), lambda x: x + F.lit(_FAR))
    return _r(knn.knn(_asked(s, d).withColumn("vec", far), _base(s, d).withColumn("vec", far), K))


@query("knn_with_holes", _knn_sql("l2", where="WHERE id % 7 > 1"))
def _(s, d):
    """Vectors with null or NaN components are in the table and never in a result."""
    hole = lambda x, i: F.when((F.col("id") % 7 == 0) & (i == 3), F.lit(None)).when((F.col("id") % 7 == 1) & (i == 5), F.lit(float("nan"))).otherwise(x)
    return _r(knn.knn(_asked(s, d), _base(s, d).withColumn("vec", F.transform("vec", hole)), K))


@query("ivf_standalone_codes", f"WITH {_ASSIGN} SELECT id, list_no, 1 AS prefix, 0.0::DOUBLE AS error FROM l")
def _(s, d):
    """Codes that begin with their list number, packed, unpacked and decoded: the inner
    code keeps all bits, so nothing is lost."""
    c, labels = _means(s, d)
    codec = codecs.CoarseCodec(c, codecs.Identity(D))
    back = codec.decode(codec.encode(_base(s, d)).select("id", "code")).select("id", F.col("vec").alias("back"))
    numbers = codec.encode(_base(s, d)).select("id", F.get("code", F.lit(0)).alias("at")).join(back, "id").join(_base(s, d), "id")
    number = F.element_at(F.lit([int(v) for v in labels]), F.col("at").cast("int") + 1)
    return numbers.select("id", number.cast("int").alias("list_no"), F.lit(codec.prefix).alias("prefix"), (F.round(V.l2(F.col("vec"), F.col("back")), 6) + 0.0).alias("error"))


@query("rotated_knn", _knn_sql("l2"))
def _(s, d):
    """A random rotation keeps distances."""
    return _spec("RR64,Flat")(s, d)


@query("pca_all_dimensions_knn", _knn_sql("l2"))
def _(s, d):
    return _spec("PCA64,Flat")(s, d)


@query("id_map_search", f"WITH {_Q}, b AS (SELECT vec_id * 3 + 7 AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT qid, id, {_DIST['l2']} AS distance FROM q, b) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, round(distance, 6) + 0.0 AS distance FROM p QUALIFY rank <= {K}")
def _(s, d):
    rows = _base(s, d).withColumn("id", F.col("id") * 3 + 7)
    return _r(spec.build("IDMap,Flat", rows).add(rows).search(_asked(s, d), K))


@query("reconstruct_rotated", f"SELECT vec_id AS id, {_SUM} AS s FROM embeddings WHERE vec_id IN (1, 5, 9, 400)")
def _(s, d):
    """Stored vectors by id, transformed back."""
    return _digest(spec.build("RR64,Flat", _base(s, d)).add(_base(s, d)).reconstruct([1, 5, 9, 400]))


@query("merged_shards_search", _knn_sql("l2"))
def _(s, d):
    """Two saved shards of one trained index in one folder."""
    trained, paths = spec.build("IVF16,Flat", _base(s, d), niter=3), []
    for i in range(2):
        paths.append(scratch(s, "shard"))
        store.save(trained.add(_base(s, d).filter(F.col("id") % 2 == i)), paths[-1])
    return _r(store.merge_on_disk(s, trained, paths, scratch(s, "merged")).search(_asked(s, d), K, nprobe=16))


@query("bvecs_round_trip", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, list_sum([floor((x::DOUBLE + 1.0) * 100) for x in embedding])::BIGINT AS s FROM embeddings")
def _(s, d):
    path = scratch(s, "bvecs")
    bytes_of = F.transform("vec", lambda x: F.floor((x.cast("double") + 1.0) * 100).cast("int"))
    vecs.write_vecs(_base(s, d).withColumn("vec", bytes_of), path, "bvecs")
    return vecs.read_vecs_folder(s, path, "bvecs").select("id", F.aggregate("vec", F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))


@query("l2_from_products", f"WITH {_Q}, {_B} SELECT qid, id, round({_DIST['l2']}, 6) + 0.0 AS distance FROM q JOIN b ON b.id = q.qid + 1")
def _(s, d):
    pairs = _asked(s, d).withColumnRenamed("vec", "qv").join(_base(s, d).withColumnRenamed("vec", "v"), F.col("id") == F.col("qid") + 1)
    norm = lambda c: V.ip(F.col(c), F.col(c))
    return _r(pairs.select("qid", "id", V.l2_from_ip(V.ip(F.col("qv"), F.col("v")), norm("qv"), norm("v")).alias("distance")))


@query("binary_ivf_all_lists", _HAMKNN)
def _(s, d):
    return binary.binary_ivf_search(*_codes(s, d), D, 8, 8, K)


@query("binary_multihash_all_flips", _HAMKNN.replace(f"rank <= {K}", "rank <= 1"))
def _(s, d):
    """Every query's own code is found by any of its hash groups."""
    q, rows = _codes(s, d)
    return spec.build_binary("BHash4x16", rows, D).search(q, 1, nflip=0)


@query("code_sizes", "SELECT * FROM (VALUES ('SQ8', 64), ('SQ6', 48), ('SQ4', 32), ('SQfp16', 128), ('PQ8x4', 4), ('PQ16x8', 16), ('RQ3x4', 2), ('LSHr', 8)) t(spec, bytes)")
def _(s, d):
    base = _base(s, d).filter("id < 300")
    rows = [(t, int(spec.build(t, base, niter=1).codec.code_size)) for t in ("SQ8", "SQ6", "SQ4", "SQfp16", "PQ8x4", "PQ16x8", "RQ3x4", "LSHr")]
    return s.createDataFrame(rows, "spec string, bytes int")


def _told(name: str, test: Callable[[SparkSession, str], bool]) -> None:
    """A query that tells whether a property holds on the whole table."""
    query(name, "SELECT true AS holds")(lambda s, d: s.createDataFrame([(bool(test(s, d)),)], "holds boolean"))


_told("results_agree_up_to_ties", lambda s, d: evaluate.same_results(knn.knn(_asked(s, d), _base(s, d), K), knn.knn_expression(_asked(s, d), _base(s, d), K), K))
_told("kmeans_objective_falls", lambda s, d: (lambda o: all(a >= b - 1e-9 for a, b in zip(o, o[1:], strict=False)))([x["objective"] for x in cluster.kmeans(_base(s, d), 8, niter=6).stats]))
_told("kmeans_spherical_is_unit", lambda s, d: np.allclose((cluster.kmeans(_base(s, d), 8, niter=3, metric="ip", spherical=True).centroids ** 2).sum(1), 1.0))
_told("kmeans_frozen_stays", lambda s, d: (lambda c: np.allclose(cluster.kmeans(_base(s, d), 12, niter=3, init=c, frozen=True).centroids[: len(c)], c))(_means(s, d)[0]))
_told("kmeans_progressive_is_close", lambda s, d: cluster.progressive_kmeans(_base(s, d), 8, niter=4).objective <= 1.1 * cluster.kmeans(_base(s, d), 8, niter=8).objective)
_told("rotation_is_orthonormal", lambda s, d: transforms.random_rotation(D, D).orthonormal)
_told("opq_is_orthonormal", lambda s, d: transforms.opq(_base(s, d), 8, bits=4, niter=2).orthonormal)
_told("subsample_is_bounded_and_repeats", lambda s, d: (lambda a, b: a == b and len(a) == 100)(*[sorted(r.id for r in cluster.hash_sample(_base(s, d).repartition(n), 100).collect()) for n in (2, 5)]))
_told("packed_codes_unpack", lambda s, d: (lambda c: bool((kernels.unpack_codes(kernels.pack_codes(c, 4), c.shape[1], 4) == c).all()))(_pq4(s, d)))
_told("quantised_tables_are_close", lambda s, d: _tables_close(s, d))


def _pq4(s, d) -> np.ndarray:
    """Codes of a bounded sample."""
    x = codecs.sample_matrix(_base(s, d), 1000)
    return codecs.ProductQuantizer.fit(x, 8, 4, 4).encode_matrix(x)


def _tables_close(s, d) -> bool:
    x = codecs.sample_matrix(_base(s, d), 1000)
    pq = codecs.ProductQuantizer.fit(x, 8, 4, 4)
    codes, q = pq.encode_matrix(x), x[:20]
    steps, scale, low = kernels.quantize_tables(pq.tables(q))
    off = np.abs(kernels.lookup_sum(steps.astype(np.int64), codes) * scale[:, None] + low[:, None] - kernels.lookup_sum(pq.tables(q), codes))
    return bool((off <= pq.m / 2 * scale[:, None] + 1e-9).all())


# --- recall floors of what SQL cannot compute --------------------------------------------


def _floor(name: str, found: Callable[[SparkSession, str], DataFrame], least: float, exact: Callable[[SparkSession, str], DataFrame] | None = None, k: int = K) -> None:
    """A query that tells whether a search finds at least this share of the exact k."""

    def run(s, d):
        truth = (exact or (lambda s, d: knn.knn(_asked(s, d), _base(s, d), k)))(s, d)
        share = evaluate.intersection_at(found(s, d), truth, k)
        return share.select((F.element_at(F.array(*share.columns), 1) >= least).alias("reached"), F.lit(least).alias("floor"))

    query(name, f"SELECT true AS reached, {least}::DOUBLE AS floor")(run)


_floor("recall_hnsw", lambda s, d: _QUERIES["hnsw_search"](s, d), 0.9)
_floor("recall_nsg", lambda s, d: _QUERIES["nsg_search"](s, d), 0.9)
_floor("recall_nn_descent", lambda s, d: _QUERIES["nn_descent_graph"](s, d), 0.9, lambda s, d: knn.knn_graph(_base(s, d), 8), 8)
for _name, _text, _least, _args in (
    ("sq8", "SQ8", 0.95, {}),
    ("ivf_sq8", "IVF16,SQ8", 0.95, {"nprobe": 16}),
    ("pq_refined", "PQ8x4,RFlat", 0.9, {"k_factor": 30.0}),
    ("ivf_pq_refined", "IVF16,PQ16x4,RFlat", 0.9, {"nprobe": 16, "k_factor": 20.0}),
    ("opq_refined", "OPQ8_32,IVF16,PQ8x4,RFlat", 0.9, {"nprobe": 16, "k_factor": 40.0}),
    ("pq_fast_refined", "PQ16x4fs,RFlat", 0.9, {"k_factor": 20.0}),
    ("polysemous_refined", "PQ16x4,RFlat", 0.9, {"k_factor": 30.0, "ht": 40}),
    ("residual_refined", "RQ4x4,RFlat", 0.9, {"k_factor": 40.0}),
    ("local_search_refined", "LSQ4x4,RFlat", 0.9, {"k_factor": 40.0}),
    ("lattice_refined", "ZnLattice8x10_6,RFlat", 0.9, {"k_factor": 10.0}),
    ("two_codes", "IVF16,PQ16+16", 0.6, {"nprobe": 16}),
    ("coarse_hnsw", "IVF16_HNSW8,Flat", 0.95, {"nprobe": 16}),
    ("coarse_nsg", "IVF16_NSG8,Flat", 0.95, {"nprobe": 16}),
    ("coarse_index", "IVF16(IVF4,Flat),Flat", 0.95, {"nprobe": 16}),
    ("multi_index", "IMI2x3,Flat", 0.95, {"nprobe": 64}),
    ("spectral_refined", "IVF16,ITQ32,SH-1.5g,RFlat", 0.6, {"nprobe": 16, "k_factor": 20.0}),
    ("hnsw_sq8", "HNSW16,SQ8", 0.85, {"ef": 80}),
):
    _floor(f"recall_{_name}", lambda s, d, t=_text, a=_args: spec.build(t, _base(s, d), niter=6).add(_base(s, d)).search(_asked(s, d), K, **a), _least)


# --- generators -------------------------------------------------------------------------


@query("synthetic_vectors")
def _(s, d):
    return _digest(vecs.synthetic(s, 1000, 16))
