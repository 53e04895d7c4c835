"""Tool rounds: a model's search calls answered under one budget of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemara.operators.retrieval import MAX_COMBINED, rrf_fuse, top_fused

BUDGET = 5
UNAVAILABLE = "memory_search_unavailable"


def within_budget(calls: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``calls`` (``round_id, call_no, queries``) with ``used``: the first queries, as far as the calls before have left some of the round's budget."""
    before = Window.partitionBy("round_id").orderBy("call_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(F.greatest(F.lit(0), F.size("queries"))).over(before), F.lit(0)))
    used = F.slice(F.coalesce("queries", F.array().cast("array<string>")), 1, left.cast("int"))
    return calls.withColumn("used", used)


def tool_round(calls: DataFrame, search: Callable[[DataFrame], DataFrame], failed: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """``round_id, call_no, used, error, results`` for every call: what its queries found, fused by rank, the best score of each id kept.

    ``search`` maps different queries (``query_id, text``) to ``query_id, id, score, rank``, so a query that many calls make is
    searched once. Calls with a query among ``failed`` (``text``) get no results and an error; the round goes on.
    """
    asked = within_budget(calls, budget).select("round_id", "call_no", "used")
    each = asked.select("round_id", "call_no", F.posexplode("used").alias("place", "text"))
    texts = each.select("text").distinct().withColumn("query_id", F.xxhash64("text"))
    found = search(texts.select("query_id", "text")).join(texts, "query_id")
    met = each.join(found.select("text", "id", "score", "rank"), "text")
    by = ["round_id", "call_no"]
    best = met.groupBy(*by, "id").agg(F.max("score").alias("best"))
    # Each query of a call is a leg of its own.
    fused = top_fused(rrf_fuse([(met, 0)], by), by, MAX_COMBINED).join(best, [*by, "id"])
    lists = fused.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("best").alias("score")))).alias("results"))
    none = F.array().cast("array<struct<rank:int,id:bigint,score:double>>")
    out = asked.join(lists, by, "left").withColumn("results", F.coalesce("results", none))
    if failed is None:
        return out.select(*by, "used", F.lit(None).cast("string").alias("error"), "results")
    bad = each.join(failed.select("text").distinct(), "text", "left_semi").select(*by).distinct().withColumn("bad", F.lit(True))
    out = out.join(bad, by, "left")
    return out.select(*by, "used", F.when(F.col("bad"), UNAVAILABLE).alias("error"), F.when(F.col("bad"), none).otherwise(F.col("results")).alias("results"))
