"""Export of version chains as nested JSON, and import with validation and id remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemara.functions import text as tx

VERSION = "STRUCT<exportId: STRING, parentExportId: STRING, version: INT, isLatest: BOOLEAN, memory: STRING, validFrom: STRING, validTo: STRING>"


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def export_chains(windows: DataFrame) -> DataFrame:
    """``chain, chain_json``: the versions of each chain in order (a chain's versions are a bounded history)."""
    row = F.struct(
        F.col("version").alias("version"), tx.id_hash(F.col("id").cast("string")).alias("exportId"), tx.id_hash(F.col("parent").cast("string")).alias("parentExportId"),
        F.col("is_latest").alias("isLatest"), F.col("memory").alias("memory"), _iso(F.col("valid_from")).alias("validFrom"), _iso(F.col("valid_to")).alias("validTo"),
    )
    return windows.groupBy("chain").agg(F.array_sort(F.collect_list(row)).alias("versions")).select("chain", F.to_json(F.struct("versions")).alias("chain_json"))


def read_chains(exported: DataFrame) -> DataFrame:
    """One row a version of exported chains."""
    parsed = F.from_json("chain_json", f"versions ARRAY<{VERSION}>")
    return exported.select("chain", F.inline(parsed["versions"]))


def validate_chains(versions: DataFrame) -> DataFrame:
    """``chain, n_versions, ok``: ids are unique, parents lie inside the chain, texts aren't empty, one version is latest."""
    outside = (
        versions.where("parentExportId is not null")
        .select("chain", F.col("parentExportId").alias("exportId"))
        .join(versions.select("chain", "exportId"), ["chain", "exportId"], "left_anti")
        .select("chain")
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    each = versions.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.count_distinct("exportId").alias("_ids"),
        F.sum(F.when(F.coalesce(F.trim("memory"), F.lit("")) == "", 1).otherwise(0)).alias("_empty"),
        F.sum(F.col("isLatest").cast("int")).alias("_latest"),
    )
    ok = (F.col("_ids") == F.col("n_versions")) & (F.col("_empty") == 0) & (F.col("_latest") == 1) & F.col("_bad").isNull()
    return each.join(outside, "chain", "left").select("chain", "n_versions", ok.alias("ok"))


def remap(versions: DataFrame, prefix: str = "m") -> DataFrame:
    """New ids for imported versions; references follow, those that lead outside are dropped."""
    ids = versions.select(F.col("chain").alias("_c"), F.col("exportId").alias("_old"), F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("/", F.col("chain").cast("string"), "exportId"), 256), 1, 20)).alias("_new"))
    own = versions.join(ids, (F.col("chain") == F.col("_c")) & (F.col("exportId") == F.col("_old"))).withColumnRenamed("_new", "id").drop("_c", "_old")
    parent = ids.withColumnRenamed("_new", "parent_id")
    return own.join(parent, (F.col("chain") == F.col("_c")) & (F.col("parentExportId") == F.col("_old")), "left").select("chain", "version", "id", "parent_id", F.col("isLatest").alias("is_latest"))
