"""Retrieval evaluation: recall at k, reciprocal ranks, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_rankings(hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall at ``ks`` and mean reciprocal rank of the first gold hit, from ``query_id, rank, gold``."""
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first"))
    return first.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float], floor: bool = False) -> DataFrame:
    """Nearest-rank percentiles: the value at place ``ceil(p n)``, or with ``floor`` that at place ``floor(p n) + 1``, the last at most.

    Equal values are counted before the running sum, so the window sorts different values, not rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy(value)
    upto = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(by))
    d = counts.withColumn("_upto", upto).withColumn("_total", total)

    def at(p: float) -> Column:
        place = F.least(F.floor(F.lit(p) * F.col("_total")) + 1, F.col("_total")) if floor else F.ceil(F.lit(p) * F.col("_total"))
        return F.min(F.when(F.col("_upto") >= place, F.col(value)))

    return d.groupBy(by).agg(F.max("_total").alias("n"), *[at(p).alias(name) for name, p in shares.items()])
