"""Shared helpers of the training-data operators: scratch tables in the shared folder and package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the size and shingle contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only on a local master (tests) is a temporary one made and set
    where that is unset; a cluster's machines would each write to their own disk.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def materialise(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a reread and no recomputation, and several readers share one computation.
    ``narrow`` tables, of a few numbers a row, are written by an eighth of the shuffle partitions, so files aren't tiny.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give this package to executors that don't have it on their path (once per application).

    Rows here are whole texts, so Arrow batches of the default 10 000 rows are made smaller; a value that was set stays.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2048")
    sc = spark.sparkContext
    if getattr(sc, "_mnemara_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "mnemara_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    sc._mnemara_shipped = True


def rows_of(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1)).alias("n")).first()["n"]


#: Keys of rows to drop that are broadcast at most; beyond that rows and keys are shuffled.
MAX_BROADCAST_KEYS = 200_000


def without_rows(keyed: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``keyed`` less the rows whose ``keys`` are in ``gone``, nulls being equal.

    ``gone`` is written once; if it is small it is broadcast, so no text is shuffled.
    """
    gone = materialise(gone.select(*keys).distinct(), "gone", narrow=True)
    few = rows_of(gone) <= MAX_BROADCAST_KEYS
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}"))
    return keyed.alias("d").join((F.broadcast(gone) if few else gone).alias("g"), same, "left_anti")


_kept: dict[object, object] = {}


def worker_state(kind: object, make: Callable[[], object] = object) -> object:
    """What a Python worker keeps between tasks: only what its last kind of work needs, so stages don't add up in memory."""
    if kind not in _kept:
        _kept.clear()
        _kept[kind] = make()
    return _kept[kind]


class Recent:
    """A bounded cache of two generations: what is asked for again stays, the rest goes with its generation.

    Keys longer than ``LONG`` are forgotten after their batch, so the bound on entries is one on memory.
    """

    LONG = 256

    def __init__(self, limit: int) -> None:
        self.half, self.new, self.old = max(1, limit // 2), {}, {}

    def find(self, keys: list) -> list:
        """Values of some keys, None for those unknown."""
        out = list(map(self.new.get, keys))
        if self.old and None in out:
            new, old = self.new, self.old
            for i, x in enumerate(out):
                if x is None and (y := old.get(keys[i])) is not None:
                    out[i] = new[keys[i]] = y
        return out

    def age(self) -> None:
        """Begin a generation if this one is full; called between batches, so a batch finds all it has learnt."""
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}

    def forget_long(self, keys: list[str]) -> None:
        for k in keys:
            if len(k) > self.LONG:
                self.new.pop(k, None)
