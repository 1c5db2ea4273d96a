"""Recall, precision, operating points, tuning, and matrix statistics."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V


def recall_at(result: DataFrame, truth: DataFrame, ranks: list[int]) -> DataFrame:
    """(r, recall): share of queries whose true nearest row is among the first r."""
    best = truth.filter("rank = 1").select("qid", F.col("id").alias("true_id"))
    hits = best.join(result.select("qid", "rank", F.col("id").alias("true_id")), ["qid", "true_id"], "left")
    hits = hits.groupBy("qid").agg(F.min("rank").alias("rank"))
    sums = hits.agg(*[F.avg(F.when(F.col("rank") <= r, 1.0).otherwise(0.0)).alias(f"r{r}") for r in ranks])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"r{r}").alias("recall")) for r in ranks])).alias("x")).select("x.*")


def intersection_at(result: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """(intersection): mean overlap of the first r neighbours."""
    a, b = (df.filter(F.col("rank") <= r).select("qid", "id") for df in (result, truth))
    n = truth.agg(F.countDistinct("qid")).first()[0]
    return a.join(b, ["qid", "id"]).agg((F.count(F.lit(1)) / F.lit(float(max(n, 1) * r))).alias("intersection"))


def range_counts(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, n_result, n_truth, n_both)"""
    a = result.select("qid", "id", F.lit(1).alias("a"))
    b = truth.select("qid", "id", F.lit(1).alias("b"))
    both = a.join(b, ["qid", "id"], "full")
    return both.groupBy("qid").agg(F.count("a").alias("n_result"), F.count("b").alias("n_truth"), F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("n_both"))


def _ratio(part: str, whole: str, other: str):
    """part / whole; an empty whole counts 1, but for recall 0 if something was returned."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.when(F.lit(other == "") | (F.col(other or whole) == 0), 1.0).otherwise(0.0))


def range_precision_recall(queries: DataFrame, result: DataFrame, truth: DataFrame, mode: str = "overall") -> DataFrame:
    """(precision, recall) over all pairs, or the mean over queries (``average``)."""
    counts = queries.select("qid").join(range_counts(result, truth), "qid", "left").fillna(0)
    if mode == "overall":
        counts = counts.agg(*[F.sum(c).alias(c) for c in ("n_result", "n_truth", "n_both")])
    return counts.select(_ratio("n_both", "n_result", "").alias("precision"), _ratio("n_both", "n_truth", "n_result").alias("recall")).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall")
    )


def range_precision_recall_at(result: DataFrame, truth: DataFrame, thresholds: list[float], metric: str = "l2") -> DataFrame:
    """(threshold, precision, recall) overall, of results cut at each threshold."""
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    inside = (lambda d, r: d > r) if metric in V.LARGEST_FIRST else (lambda d, r: d < r)
    marked = result.select("qid", "id", "distance").join(truth.select("qid", "id", F.lit(1).alias("true")), ["qid", "id"], "left")
    cut = marked.select("distance", "true", F.explode(t).alias("threshold")).groupBy("threshold").agg(
        F.sum(F.when(inside(F.col("distance"), F.col("threshold")), 1).otherwise(0)).alias("n_result"),
        F.sum(F.when(inside(F.col("distance"), F.col("threshold")) & F.col("true").isNotNull(), 1).otherwise(0)).alias("n_both"),
    )
    rows = cut.withColumn("n_truth", F.lit(truth.count()))
    return rows.select("threshold", _ratio("n_both", "n_result", "").alias("precision"), _ratio("n_both", "n_truth", "n_result").alias("recall"))


def pareto(points: DataFrame) -> DataFrame:
    """(key, perf, t): points that no better or equal one beats in time; perf 0 never."""
    first = W.partitionBy("perf").orderBy("t", "key")
    fastest = points.filter("perf > 0").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    # operating points are a driver-sized table: one row per setting that was tried
    above = F.min("t").over(W.partitionBy(F.lit(0)).orderBy(F.desc("perf")).rowsBetween(W.unboundedPreceding, -1))
    return fastest.withColumn("_above", above).filter("_above IS NULL OR t < _above").drop("_above")


def time_for(points: DataFrame, perf: float) -> float | None:
    """Least time of a point with at least this performance."""
    return points.filter(F.col("perf") >= perf).agg(F.min("t")).first()[0]


def merge_points(a: DataFrame, b: DataFrame, prefix: str = "") -> DataFrame:
    return pareto(a.unionByName(b.withColumn("key", F.concat(F.lit(prefix), "key"))))


def same_results(a: DataFrame, b: DataFrame, k: int, digits: int = 4) -> bool:
    """Whether two neighbour tables agree up to ties: equal distances by rank, and equal
    ids except within the last distance of a query."""
    x = a.select("qid", "rank", F.round("distance", digits).alias("d"), "id")
    y = b.select("qid", "rank", F.round("distance", digits).alias("d"), "id")
    if x.select("qid", "rank", "d").exceptAll(y.select("qid", "rank", "d")).limit(1).count():
        return False
    last = x.groupBy("qid").agg(F.max("d").alias("lo"), F.min("d").alias("hi"))
    inner = lambda t: t.join(last, "qid").filter((F.col("d") != F.col("lo")) & F.col("d").isNotNull()).select("qid", "d", "id")
    return not inner(x).exceptAll(inner(y)).limit(1).count()


# --- tuning ---------------------------------------------------------------------------


def parameter_grid(kind: str, nlist: int = 0, code_bits: int = 0) -> dict[str, list[float]]:
    """Values to try, by index kind (ivf, imi, pq, hnsw, refine)."""
    powers = lambda a, b: [2**i for i in range(a, b)]
    out: dict[str, list[float]] = {}
    if kind in ("ivf", "imi"):
        out["nprobe"] = [n for n in powers(0, 13) if n < nlist]
    if kind == "imi":
        out["max_codes"] = [*powers(8, 20), float("inf")]
    if kind == "pq":
        out["ht"] = [*range(2, code_bits // 2 + 1, 2), code_bits]
    if kind == "hnsw":
        out["efSearch"] = powers(2, 10)
    if kind == "refine":
        out["k_factor"] = powers(0, 7)
    return out


def set_parameters(target: dict, name: str) -> dict:
    """``target`` with settings from "nprobe=4,ht=20"."""
    out = dict(target)
    for item in filter(None, name.split(",")):
        key, value = item.split("=")
        out[key.strip()] = float(value) if "." in value or value in ("inf", "nan") else int(value)
    return out


def explore(run: Callable[[dict], DataFrame], criterion: Callable[[DataFrame], float], grid: dict[str, list], spark, n_experiments: int = 0, seed: int = 1) -> DataFrame:
    """(key, perf, t) of settings tried.  All combinations, or the extremes and
    ``n_experiments`` others in a seeded order; one is skipped when a setting at least as
    large in every parameter was no better than a known faster one."""
    import random

    names = list(grid)
    combos = list(itertools.product(*(range(len(grid[n])) for n in names)))
    if n_experiments:
        rest = combos[1:-1]
        random.Random(seed).shuffle(rest)
        combos = [combos[0], combos[-1], *rest[: max(0, n_experiments - 2)]] if len(combos) > 1 else combos
    done: list[tuple[tuple, float, float]] = []
    for c in combos:
        most = min((p for o, p, _ in done if all(a >= b for a, b in zip(o, c, strict=True))), default=float("inf"))
        least = max((t for o, _, t in done if all(a <= b for a, b in zip(o, c, strict=True))), default=0.0)
        if n_experiments and any(p >= most and t <= least for _, p, t in done):
            continue
        start = time.perf_counter()
        perf = criterion(run({n: grid[n][i] for n, i in zip(names, c, strict=True)}))
        done.append((c, perf, time.perf_counter() - start))
    rows = [(",".join(f"{n}={grid[n][i]}" for n, i in zip(names, c, strict=True)), float(p), float(t)) for c, p, t in done]
    return spark.createDataFrame(rows, "key string, perf double, t double")


# --- matrix statistics ----------------------------------------------------------------


def matrix_stats(df: DataFrame) -> DataFrame:
    """Per dimension: n, n_nan, n_inf, n_zero, lo, hi, mean, std over finite values."""
    x = F.col("x")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.when(finite, x)
    rows = df.select(F.posexplode("vec").alias("dim", "x")).withColumn("x", x.cast("double"))
    return rows.groupBy("dim").agg(
        F.count("x").alias("n"),
        F.count(F.when(F.isnan(x), 1)).alias("n_nan"),
        F.count(F.when(F.abs(x) == float("inf"), 1)).alias("n_inf"),
        F.count(F.when(x == 0, 1)).alias("n_zero"),
        F.min(good).alias("lo"),
        F.max(good).alias("hi"),
        F.avg(good).alias("mean"),
        F.stddev_pop(good).alias("std"),
    )


def vector_stats(df: DataFrame) -> DataFrame:
    """One row: n, n_distinct, lo_norm, hi_norm, normalised."""
    n = df.select("vec", V.norm(F.col("vec")).alias("norm"))
    one = n.groupBy("vec").agg(F.count(F.lit(1)).alias("c"), F.first("norm").alias("norm"))
    return one.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("norm").alias("lo_norm"), F.max("norm").alias("hi_norm")).withColumn(
        "normalised", F.col("hi_norm") < 1.0001 * F.col("lo_norm")
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def bit_histogram(df: DataFrame, bits: str = "bits") -> DataFrame:
    """(bit, n): rows that have each bit set."""
    return df.select(F.posexplode(bits).alias("bit", "v")).groupBy("bit").agg(F.sum("v").cast("long").alias("n"))
