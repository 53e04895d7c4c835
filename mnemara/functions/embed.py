"""Embedding functions that need no model service: hashed words, pooled token rows, a static token matrix; and their inputs."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemara.functions import hashed

DIM = 384
PAYLOAD_CHARS = 36_000
#: Prefixes of models that tell queries from passages.
PREFIXES = {"query": "query: ", "passage": "passage: "}
_VECTOR = T.ArrayType(T.FloatType())


def hash_embedder(dim: int = DIM):
    """A column function: unit vectors of hashed words ``[a-z0-9]+``; a text without words is the first axis. Null stays null."""

    @F.arrow_udf(_VECTOR)
    def embed(texts: pa.Array) -> pa.Array:
        return hashed.vectors(texts, dim)

    return embed


def for_task(text: Column, task: str) -> Column:
    return F.concat(F.lit(PREFIXES[task]), text)


def within_payload(texts: DataFrame, request: str, text: str, most: int = PAYLOAD_CHARS) -> DataFrame:
    """``text`` cut so that a request's texts, at two units a character, stay within ``most``: each to an equal share if they don't."""
    w = Window.partitionBy(request)
    share = F.floor(F.lit(most // 2) / F.greatest(F.count(F.lit(1)).over(w), F.lit(1))).cast("int")
    over = F.sum(F.length(text)).over(w) * 2 > most
    return texts.withColumn("_share", share).withColumn("_over", over).withColumn(text, F.when(F.col("_over"), F.expr(f"substring(`{text}`, 1, _share)")).otherwise(F.col(text))).drop("_share", "_over")


def pooled(rows: DataFrame, how: str = "mean") -> DataFrame:
    """``id, v`` from token rows ``id, place, mask, v``: the mean of the rows under the mask, the first row, or the last under the mask."""
    if how == "first":
        return rows.groupBy("id").agg(F.min_by("v", "place").alias("v"))
    if how == "last":
        return rows.groupBy("id").agg(F.coalesce(F.max_by("v", F.when(F.col("mask"), F.col("place"))), F.min_by("v", "place")).alias("v"))
    each = rows.select("id", "mask", F.posexplode("v").alias("axis", "x")).groupBy("id", "axis")
    means = each.agg(F.coalesce(F.avg(F.when(F.col("mask"), F.col("x").cast("double"))), F.lit(0.0)).alias("x"))
    return means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "x"))), lambda a: a["x"]).alias("v"))


def to_half(x: np.ndarray) -> np.ndarray:
    """Half precision by cutting the mantissa; what is too small is a signed zero, what is too large infinite."""
    x = np.asarray(x, np.float32)
    cut = (x.view(np.uint32) & np.uint32(0xFFFFE000)).view(np.float32)
    cut = np.where(np.abs(x) < 2.0**-14, np.copysign(np.float32(0), x), cut)
    with np.errstate(over="ignore"):
        return np.where(np.abs(x) >= 2.0**16, np.copysign(np.float32(np.inf), x), cut).astype(np.float16)


def read_matrix(spark: SparkSession, path: str, name: str | None = None) -> np.ndarray:
    """A tensor of a safetensors file (the only one, if no name is given) in half precision; a model's matrix has a bounded size."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    size = int.from_bytes(raw[:8], "little")
    header = {k: v for k, v in json.loads(raw[8 : 8 + size]).items() if k != "__metadata__"}
    entry = header[name] if name else next(iter(header.values()))
    kind = {"F32": "<f4", "F16": "<f2", "F64": "<f8"}[entry["dtype"]]
    a, b = entry["data_offsets"]
    x = np.frombuffer(raw[8 + size + a : 8 + size + b], kind).reshape(entry["shape"])
    return x.astype(np.float16) if kind == "<f2" else to_half(x.astype(np.float32))


def static_embedder(spark: SparkSession, matrix: np.ndarray, unit: bool = True):
    """A column function from token ids to the mean of their rows of a matrix, of length 1 if asked for. Ids outside it don't count."""
    shared = spark.sparkContext.broadcast(matrix)

    @F.pandas_udf(_VECTOR)
    def embed(ids: pd.Series) -> pd.Series:
        m = shared.value

        def one(x: np.ndarray | None) -> np.ndarray | None:
            if x is None:
                return None
            x = np.asarray(x)
            x = x[(x >= 0) & (x < len(m))]
            v = m[x].astype(np.float32).mean(axis=0) if len(x) else np.zeros(m.shape[1], np.float32)
            return v / (np.sqrt((v * v).sum()) + np.float32(1e-32)) if unit and len(x) else v

        return ids.map(one)

    return embed
