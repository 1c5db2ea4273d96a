"""Two-stage search: candidates from a coarse result, distances from better vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .knn import knn_among


def refine(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact re-ranking of candidate (qid, id) pairs, top k."""
    if metric not in ("l2", "ip"):
        raise ValueError("refinement is defined for l2 and ip")
    return knn_among(candidates.select("qid", "id"), queries, base, k, metric)


def base_k(k: int, k_factor: float = 1.0) -> int:
    return int(k * k_factor)
