"""Matrix files (safetensors) as tables, a row of the matrix a row, read by ranges of rows; and layouts by owner.

Neither the driver nor one task holds the file: the driver reads its header, and each task the bytes of its own rows. Files are
opened through Arrow's file systems, so a path may be local or name one that Arrow knows (``hdfs://``, ``s3://``, ...).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"F16": "<f2", "F32": "<f4", "F64": "<f8"}
ROWS = 8192


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def header(path: str, name: str | None = None) -> tuple[str, tuple[int, int], int]:
    """Kind of number, shape and first byte of a tensor (the only one, if no name is given)."""
    with _open(path) as f:
        size = int.from_bytes(f.read(8), "little")
        entries = {k: v for k, v in json.loads(f.read(size)).items() if k != "__metadata__"}
    entry = entries[name] if name else next(iter(entries.values()))
    if len(entry["shape"]) != 2:
        raise ValueError(f"not a matrix: {entry['shape']}")
    return KINDS[entry["dtype"]], (entry["shape"][0], entry["shape"][1]), 8 + size + entry["data_offsets"][0]


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("rows", ROWS))
        self.kind, self.shape, self.start = header(self.path, options.get("tensor"))

    def partitions(self) -> list[_Rows]:
        return [_Rows(at, min(at + self.size, self.shape[0])) for at in range(0, self.shape[0], self.size)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        width = np.dtype(self.kind).itemsize * self.shape[1]
        with _open(self.path) as f:
            f.seek(self.start + partition.first * width)
            raw = f.read((partition.last - partition.first) * width)
        x = np.frombuffer(raw, self.kind).astype(np.float32)
        n = partition.last - partition.first
        rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.shape[1]), pa.array(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last)), rows], ["row", "v"])


class MatrixSource(DataSource):
    """``spark.read.format("matrix").load(path)``: ``row, v``. Options: ``tensor``, and ``rows`` a task."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row long, v array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def matrix(spark: SparkSession, path: str, tensor: str | None = None, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("matrix").option("rows", str(rows))
    return (reader.option("tensor", tensor) if tensor else reader).load(path)


def pooled_tokens(tokens: DataFrame, rows: DataFrame, unit: bool = True) -> DataFrame:
    """``id, v`` for ``tokens`` (``id, ids``): the mean of the matrix rows that the token ids name, of length 1 if asked for.

    Rows join by number, so no task holds the matrix; how often a text has a token is counted first. Ids outside the matrix don't
    count; texts without any have a null vector.
    """
    used = tokens.select("id", F.explode("ids").alias("row")).groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).join(rows, "row")
    each = used.select("id", "n", F.posexplode("v").alias("axis", "x")).groupBy("id", "axis")
    means = each.agg((F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("axis", "x"))), lambda a: a["x"])
    out = tokens.select("id").join(means.groupBy("id").agg(v.alias("v")), "id", "left")
    if unit:
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        out = out.withColumn("v", F.transform("v", lambda x: x / (size + 1e-32)))
    return out


def stored_by(df: DataFrame, path: str, owner: str) -> DataFrame:
    """A table laid out by owner: a read of some owners opens their folders only, also where they come from a join."""
    df.repartition(owner, F.pmod(F.xxhash64(*[c for c in df.columns if c != owner]), F.lit(16))).write.partitionBy(owner).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
