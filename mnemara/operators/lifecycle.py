"""Versioned records: exact duplicates, version windows, as-of reads, repair, forgetting, retention, upserts.

State is derived: each operator maps a state and operations to a new state, and nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HOT = 1000


def exact_dedup(df: DataFrame, space: str, text: str, key: str) -> DataFrame:
    """``key, kept, action``: the first of equal texts in a space is created, the others are unchanged; nulls are equal.

    Texts are grouped by digest, so what is shuffled is small. The at most ``HOT`` groups with more than 1 / ``HOT`` of all rows
    are broadcast to their rows, so no group of copies meets in one task.
    """
    d = df.select(F.col(key).alias("_key"), F.col(space).alias("_space"), F.coalesce(F.sha2(F.col(text), 256), F.lit("")).alias("_digest"))
    first = d.groupBy("_space", "_digest").agg(F.min("_key").alias("kept"), F.count(F.lit(1)).alias("_n"))
    most = max(HOT, d.count() // HOT)
    same = F.col("d._space").eqNullSafe(F.col("f._space")) & (F.col("d._digest") == F.col("f._digest"))
    hot = F.broadcast(first.where(F.col("_n") > most)).alias("f")
    rest = d.alias("d").join(hot, same, "left_anti").alias("d").join(first.where(F.col("_n") <= most).alias("f"), same)
    met = d.alias("d").join(hot, same).select("_key", "kept").unionByName(rest.select("_key", "kept"))
    return met.select(F.col("_key").alias(key), "kept", F.when(F.col("_key") == F.col("kept"), "created").otherwise("unchanged").alias("action"))


def version_windows(df: DataFrame) -> DataFrame:
    """Versions of each chain (``chain, id, ts, kind``): the first is open at its start, the last at its end."""
    w = Window.partitionBy("chain").orderBy("ts", "id")
    seen = F.sum(F.when(F.col("kind") == "supersede", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("version", F.row_number().over(w))
        .withColumn("valid_from", F.when(F.col("version") > 1, F.col("ts")))
        .withColumn("valid_to", F.lead("ts").over(w))
        .withColumn("is_latest", F.col("valid_to").isNull() & F.lead("id").over(w).isNull())
        .withColumn("source_count", (seen - F.when(F.first("kind").over(w) == "supersede", 1).otherwise(0) + 1).cast("long"))
    )


def as_of(df: DataFrame, instant: Column) -> DataFrame:
    """Rows whose half-open window holds an instant; null bounds are open."""
    return df.where((F.col("valid_from").isNull() | (F.col("valid_from") <= instant)) & (F.col("valid_to").isNull() | (F.col("valid_to") > instant)))


def latest(df: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """The newest row of each chain, by a grouped maximum (no sort, pre-aggregated)."""
    rest = [c for c in df.columns if c not in (chain, *order)]
    return df.groupBy(chain).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(chain, *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)])


def repair_chains(df: DataFrame, now: Column) -> DataFrame:
    """Leave the newest latest row of a chain latest; demote the others, closing open windows now."""
    w = Window.partitionBy("chain").orderBy(F.desc("version"), F.desc("ts"), F.desc("id"))
    d = df.withColumn("_no", F.when(F.col("is_latest"), F.row_number().over(w)))
    top = F.min("_no").over(Window.partitionBy("chain"))
    demote = F.col("is_latest") & (F.col("_no") > top)
    return (
        d.withColumn("valid_to", F.when(demote, F.coalesce("valid_to", now)).otherwise(F.col("valid_to")))
        .withColumn("is_latest", F.col("is_latest") & ~demote)
        .drop("_no")
    )


def latest_violations(df: DataFrame) -> DataFrame:
    return df.groupBy("chain").agg(F.sum(F.col("is_latest").cast("long")).alias("n_latest")).where("n_latest > 1")


def sweep_expired(df: DataFrame, now: Column, reason: str = "expired") -> DataFrame:
    """Forget rows whose time is up; a reason that is there stays."""
    due = ~F.col("is_forgotten") & F.col("forget_after").isNotNull() & (F.col("forget_after") <= now)
    return df.withColumn("forget_reason", F.when(due, F.coalesce("forget_reason", F.lit(reason))).otherwise(F.col("forget_reason"))).withColumn("is_forgotten", F.col("is_forgotten") | due)


def forget_chains(df: DataFrame, chains: DataFrame, reason: str, undo: bool = False) -> DataFrame:
    """Forget every version of some chains, or take that back (which clears reason and expiry too)."""
    d = df.join(chains.select("chain").distinct().withColumn("_hit", F.lit(True)), "chain", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    if undo:
        return (
            d.withColumn("is_forgotten", F.col("is_forgotten") & ~F.col("_hit"))
            .withColumn("forget_reason", F.when(~F.col("_hit"), F.col("forget_reason")))
            .withColumn("forget_after", F.when(~F.col("_hit"), F.col("forget_after")))
            .drop("_hit")
        )
    return (
        d.withColumn("is_forgotten", F.col("is_forgotten") | F.col("_hit"))
        .withColumn("forget_reason", F.when(F.col("_hit"), F.lit(reason)).otherwise(F.col("forget_reason")))
        .drop("_hit")
    )


def visible(df: DataFrame, now: Column) -> DataFrame:
    return df.where(~F.col("is_forgotten") & (F.col("forget_after").isNull() | (F.col("forget_after") > now)))


def newest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def pruned(df: DataFrame, n: int, key: str, order: list[str]) -> DataFrame:
    """What retention of the newest ``n`` removes."""
    return df.join(newest(df.select(key, *[c for c in order if c != key]), n, order), key, "left_anti")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """State with changes put over it by key."""
    return state.join(changes, keys, "left_anti").unionByName(changes)


def insert_ignore(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """State with the rows of ``new`` whose keys it lacks, one a key."""
    return state.unionByName(new.dropDuplicates(keys).join(state, keys, "left_anti"))
