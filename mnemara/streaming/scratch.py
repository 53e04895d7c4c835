"""Where streams keep their progress and output: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, name: str) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; as a pattern, the path may be a folder or one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is now, and give its output as a table.

    Each batch is added under its batch id, so a batch that is run again after a failure replaces itself. In update mode the
    newest row of each of the ``keys`` counts.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, f"{name}-progress")).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
    return rows.select(*stream.columns)


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and several readers share one computation."""
    path = shared_folder(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
