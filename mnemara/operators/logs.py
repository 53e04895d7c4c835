"""Audit and error logs: grouped reads, traces of searches, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemara.functions import text as tx
from mnemara.operators import lifecycle
from mnemara.operators.snapshots import Conflict, Manifest, Snapshots

TRACE_TEXT = 1200
PRUNE_EVERY = 25
TRACE = "id string, kind string, status string, query string, queries array<string>, search_mode string, result_count int, latency_ms long, retrieved string, created_at timestamp"


def error_groups(events: DataFrame, by: list[str], limit: int = 50) -> DataFrame:
    """Occurrences by group with first and last time and the newest message, groups with the newest error first."""
    newest = F.struct("ts", "event_id")
    return (
        events.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.max_by("message", newest).alias("last_message"),
        )
        .orderBy(F.desc("last_seen"), *by)
        .limit(limit)
    )


def trace_items(results: DataFrame, kind: str, limit: int = TRACE_TEXT) -> DataFrame:
    """``query_id, result_count, retrieved``: each query's results (``query_id, rank, id, text, version, similarity``) in order, as a JSON array.

    Texts are clipped to ``limit`` characters beside their whole length; a search's results are bounded by its limit.
    """
    length = F.length(F.coalesce("text", F.lit("")))
    clipped = tx.clip(F.coalesce("text", F.lit("")), limit)
    item = F.struct(F.lit(kind).alias("type"), "id", "version", F.round("similarity", 6).alias("similarity"), clipped.alias("content"), length.alias("contentLength"), (length > limit).alias("truncated"))
    each = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("r"))
    return each.select("query_id", F.size("r").alias("result_count"), F.to_json(F.transform("r", lambda x: x["item"])).alias("retrieved"))


def traces(queries: DataFrame, results: DataFrame, kind: str, mode: str, latency_ms: Column, now: Column, limit: int = TRACE_TEXT) -> DataFrame:
    """A row of the trace log for each of ``queries`` (``query_id, id, text``): what was asked, what was found; without results an empty list."""
    found = trace_items(results, mode, limit)
    asked = tx.clip(F.col("text"), limit)
    rows = queries.join(found, "query_id", "left")
    return rows.select(
        F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), F.lit("ok").alias("status"), asked.alias("query"), F.array(asked).alias("queries"), F.lit(mode).alias("search_mode"),
        F.coalesce("result_count", F.lit(0)).alias("result_count"), F.greatest(F.lit(0), F.round(latency_ms)).cast("long").alias("latency_ms"), F.coalesce("retrieved", F.lit("[]")).alias("retrieved"), now.cast("timestamp").alias("created_at"),
    )


def record_traces(log: Snapshots, rows: DataFrame, keep: int, every: int = PRUNE_EVERY, key: str = "id", order: str = "created_at") -> Manifest:
    """Append to a log in one commit; with every ``every`` writes since the last time it is cut to the newest ``keep`` (0: never)."""
    rows = rows.cache()
    n = rows.count()
    try:
        while True:
            base = log.newest()
            since = int(base.notes.get("since", 0)) + n
            prune = keep > 0 and since >= every
            gone, new = None, rows
            if prune:
                old = log.read(base)
                both = old.select(key, order).unionByName(rows.select(key, order))
                gone = lifecycle.pruned(both, keep, key, [order, key]).select(key)
                new = rows.join(gone, key, "left_anti")
                gone = old.select(key).join(gone, key, "left_semi")
            try:
                return log.commit(new, base, gone=gone, notes={"since": 0 if prune else since})
            except Conflict:
                continue
    finally:
        rows.unpersist()
