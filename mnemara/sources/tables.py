"""The given tables, and the views of them that stand for memories, versions and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: the language is the container tag, the source the space; hours before 2026 by id."""
    d = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01"), "yyyy-MM-dd") - F.col("doc_id") * 3600)
    return d.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("tag"), F.col("source").alias("space"), created.alias("created_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a label: its vector of smallest id."""
    v = vectors(spark, sf_dir)
    return v.groupBy("label").agg(F.min(F.struct("id", "v")).alias("q")).select(F.col("label").cast("long").alias("query_id"), F.col("q.id").alias("own_id"), F.col("q.v").alias("q"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes to versioned facts: a chain a user; ``error`` events are re-observations (supersede), others corrections."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("chain"), F.col("event_id").alias("id"), "ts", "value", F.when(F.col("event_type") == "error", "supersede").otherwise("correct").alias("kind"), "props"
    )


def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versioned memories with what a search needs: three in a row are a chain, some are forgotten or expire, some have no vector."""
    d, v = table(spark, sf_dir, "documents"), vectors(spark, sf_dir).select("id", "v")
    chain, version = F.floor(F.col("doc_id") / 3), (F.col("doc_id") % 3 + 1).cast("int")
    hours = F.unix_timestamp(F.lit("2026-01-01"), "yyyy-MM-dd") - chain * 21600 + version * 3600
    rows = d.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("tag"), chain.alias("chain"), version.alias("version"), F.timestamp_seconds(hours).alias("created_at"),
        (F.col("doc_id") % 11 == 0).alias("is_forgotten"), F.when(F.col("doc_id") % 13 == 0, F.timestamp_seconds(hours + 864000)).alias("forget_after"),
    )
    after = F.lead("created_at").over(Window.partitionBy("chain").orderBy("version"))
    rows = rows.withColumn("valid_from", F.when(F.col("version") > 1, F.col("created_at"))).withColumn("valid_to", after).withColumn("is_latest", F.col("valid_to").isNull())
    return rows.join(v, "id", "left")


def turn_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chat turns as chunks of documents, and the conversations as these documents; their tags are the roles in them."""
    c = table(spark, sf_dir, "conversations")
    vector = vectors(spark, sf_dir).select(F.col("id").alias("_id"), "v")
    n = F.col("conv_id") * 7 + F.col("turn")
    chunks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("text").alias("content"), F.col("role").alias("heading_path"), n.alias("_n"))
    chunks = chunks.join(vector, F.col("_n") == F.col("_id"), "left").drop("_n", "_id")
    docs = c.groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("conversation "), F.first("conv_id").cast("string")).alias("title"), F.collect_set("role").alias("tags"))
    return chunks, docs
