"""Global ranks and running totals without a single-task window.

The order column is cut into slices at fixed quantiles; totals per slice are one row
each, and windows run inside slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_ROWS = 200_000


def slices(df: DataFrame, column: str, rows: int = SLICE_ROWS) -> tuple[Column, int]:
    """(slice number of a row, number of slices) by value of a numeric column."""
    n = df.count() // rows + 1
    cuts = sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 1 / (10 * n)))) if n > 1 else []
    return slice_of(F.col(column), cuts), len(cuts) + 1


def slice_of(value: Column, cuts: list[float]) -> Column:
    out = F.lit(0)
    if cuts:
        out = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value))
    return out


def running_total(df: DataFrame, order: str, value: Column, name: str, ties: list[str] | None = None) -> DataFrame:
    """``df`` with the running total of ``value`` in the order of a numeric column."""
    number, _ = slices(df, order)
    rows = df.withColumn("_slice", number).withColumn("_value", value)
    totals = {r[0]: r[1] for r in rows.groupBy("_slice").agg(F.sum("_value")).collect()}  # one row per slice
    before, at = [], 0
    for s in sorted(totals):
        before.append((s, at))
        at += totals[s] or 0
    starts = df.sparkSession.createDataFrame(before or [(0, 0)], f"_slice int, _before {'double' if isinstance(at, float) else 'long'}")
    w = W.partitionBy("_slice").orderBy(order, *(ties or [])).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(starts), "_slice").withColumn(name, F.col("_before") + F.sum("_value").over(w))
    return out.drop("_slice", "_value", "_before")


def global_rank(df: DataFrame, order: str, name: str = "place", ties: list[str] | None = None) -> DataFrame:
    """``df`` with its place from 0 in the order of a numeric column."""
    out = running_total(df, order, F.lit(1).cast("long"), name, ties)
    return out.withColumn(name, F.col(name) - 1)
