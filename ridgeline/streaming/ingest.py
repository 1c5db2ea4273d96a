"""Streams of vectors into postings, and streams of queries against them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ivf


def ingest(stream: DataFrame, centroids: np.ndarray, path: str, checkpoint: str, metric: str = "l2", trigger: dict | None = None, numbers: np.ndarray | None = None):
    """Assign each micro-batch of (id, vec, ...) to its lists and append it to a postings
    folder partitioned by list.  A batch that is retried replaces its own folder.
    ``numbers``: of the lists, if not the places of their centroids."""

    def write(batch: DataFrame, number: int) -> None:
        rows = ivf.add(batch, centroids, metric, numbers)
        rows.write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def postings(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def query_stream(stream: DataFrame, rows: DataFrame, centroids: np.ndarray, k: int, nprobe: int, sink, checkpoint: str, metric: str = "l2", trigger: dict | None = None):
    """Answer each micro-batch of (qid, vec) from stored postings; ``sink(result, batch)``."""

    def answer(batch: DataFrame, number: int) -> None:
        q = batch.select("qid", "vec").persist()
        try:
            sink(ivf.search(q, rows, ivf.probe(q, centroids, nprobe, metric), k, metric), number)
        finally:
            q.unpersist()

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, centroids: np.ndarray, time_col: str, width: str, delay: str, metric: str = "l2") -> DataFrame:
    """(window, list_no, n): list sizes by event-time window; late rows beyond the
    watermark are left out, closed windows are final."""
    listed = ivf.add(stream, centroids, metric)
    return listed.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "list_no").agg(F.count(F.lit(1)).alias("n"))


def expire(rows: DataFrame, time_col: str, newest, keep: str) -> DataFrame:
    """Rows of the newest interval only (the sliding window over event time)."""
    return rows.filter(F.col(time_col) > F.lit(newest) - F.expr(f"INTERVAL {keep}"))


