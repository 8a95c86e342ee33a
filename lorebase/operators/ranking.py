"""Ranks, fusion and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60
#: Fixed value: the largest candidate window.
MOST = 4096


def rrf(vec_rank: str, fts_rank: str, weight_vec: float = 1.0, weight_fts: float = 1.0, k: int = RRF_K) -> Column:
    """Weighted reciprocal rank fusion; a missing channel adds nothing."""
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return part(vec_rank, weight_vec) + part(fts_rank, weight_fts)


def fused(vec: DataFrame, fts: DataFrame, keys: list[str], weight_vec: float = 1.0, weight_fts: float = 1.0) -> DataFrame:
    """Full outer join of (keys, vec_rank) and (keys, fts_rank) with ``score``."""
    return vec.join(fts, keys, "full").withColumn("score", rrf("vec_rank", "fts_rank", weight_vec, weight_fts))


def top(rows: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark drops what a task need not send (a limit of its own within each partition's group)."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def within_budget(rows: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(w)).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where((F.col("_sum") <= budget) | (F.col("_nth") == 1)).drop("_sum", "_nth")


def candidate_window(limit: int, overfetch: float = 2, multiplier: int = 10, most: int = MOST) -> int:
    """How many candidates each channel gives."""
    return min(most, max(1, -(-int(limit * max(1, overfetch)) // 1)) * multiplier)
