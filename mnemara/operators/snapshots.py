"""A state in versions: snapshots with a manifest, committed by compare-and-swap.

A version is a manifest: the folder of each bucket of keys, what the commit carried along (``notes``), and the version it was made
from. A commit writes anew only the buckets that it touches and then claims the next number by creating the manifest's file, which
the file system lets one writer do. Who comes second finds the number taken: if the buckets it touched are as it read them it goes on
from the newer version, else it has lost with nothing written over, and is told ``Conflict``. Readers keep the version that they began with.

A claim without content is a writer between its claim and its write, or one that died there; it is waited for until ``LEASE``
seconds have passed, after that it counts as given up. Folders that no manifest names are left by writers that lost; ``unused``
lists them. Works on any file system whose files can be created exclusively (HDFS, local disks).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEASE = 60.0
BUCKETS = 16


class Conflict(Exception):
    """The state has changed since the version that a commit was made from."""


@dataclass(frozen=True)
class Manifest:
    version: int
    folders: dict[int, str] = field(default_factory=dict)  # by bucket
    notes: dict[str, object] = field(default_factory=dict)


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    # Manifests

    def _numbers(self) -> list[int]:
        folder = self._path("manifests")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def _load(self, version: int) -> Manifest | None:
        """A manifest; None if its claim has no content yet."""
        path = self._path(f"manifests/{version:010d}")
        size = self._fs.getFileStatus(path).getLen()
        if not size:
            return None
        stream = self._fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            x = json.loads(text)
        except ValueError:
            return None  # half of it is there
        return Manifest(version, {int(k): v for k, v in x["folders"].items()}, x["notes"])

    def newest(self) -> Manifest:
        """The newest version; 0, without rows, if nothing was committed."""
        for version in reversed(self._numbers()):
            while True:
                if (m := self._load(version)) is not None:
                    return m
                if time.time() - self._fs.getFileStatus(self._path(f"manifests/{version:010d}")).getModificationTime() / 1000 > LEASE:
                    break  # given up
                time.sleep(0.05)
        return Manifest(0)

    def _claim(self, version: int, m: Manifest) -> bool:
        """Create a version's manifest; False if another writer has."""
        from py4j.protocol import Py4JJavaError

        path = self._path(f"manifests/{version:010d}")
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if self._fs.exists(path):
                return False
            raise e
        out.write(bytearray(json.dumps({"folders": m.folders, "notes": m.notes}).encode()))
        out.close()
        return True

    # Rows

    def read(self, at: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest one), or of some of its buckets."""
        at = at or self.newest()
        folders = [f for b, f in sorted(at.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def commit(self, changes: DataFrame, base: Manifest, gone: DataFrame | None = None, notes: dict[str, object] | None = None) -> Manifest:
        """The version with the rows of ``changes`` put over those of ``base`` by key, less those whose keys are in ``gone``."""
        columns = self.read(base).columns
        run = f"{self.root}/rows/{uuid.uuid4().hex}"
        changes.select(*columns).withColumn("_bucket", self.bucket()).write.partitionBy("_bucket").parquet(f"{run}/changes")
        new = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{run}/changes")
        keys = new.select(self.key, "_bucket")
        if gone is not None:
            keys = keys.unionByName(gone.select(self.key).withColumn("_bucket", self.bucket()))
        touched = sorted(r["_bucket"] for r in keys.select("_bucket").distinct().collect())  # at most ``buckets``
        old = self.read(base, touched).join(keys.select(self.key).distinct(), self.key, "left_anti").select(*columns).withColumn("_bucket", self.bucket())
        rows = old.unionByName(new.select(*columns, "_bucket"))
        rows.repartition("_bucket", F.pmod(F.hash(self.key), F.lit(8))).write.partitionBy("_bucket").parquet(f"{run}/state")
        there = {int(f.getPath().getName().split("=")[1]): f.getPath().toString() for f in self._fs.listStatus(self._path(f"rows/{run.rsplit('/', 1)[1]}/state")) if "=" in f.getPath().getName()}
        now = base
        while True:
            # Numbers are listed before the newest version is looked up: a claim made in between takes our number.
            number = max([now.version, *self._numbers()]) + 1
            newest = self.newest()
            if newest.version == now.version:
                done = Manifest(number, {b: f for b, f in now.folders.items() if b not in touched} | there, now.notes | (notes or {}))
                if self._claim(number, done):
                    return done
                newest = self.newest()
            now = newest
            if any(now.folders.get(b) != base.folders.get(b) for b in touched) or any(now.notes.get(k) != base.notes.get(k) for k in notes or ()):
                raise Conflict(f"version {base.version} has changed: the newest is {now.version}")

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20, notes: dict[str, object] | None = None) -> Manifest:
        """Commit what ``change`` makes of the newest rows; made again if another writer was first."""
        for _ in range(tries):
            base = self.newest()
            try:
                return self.commit(change(self.read(base)), base, notes=notes)
            except Conflict:
                continue
        raise Conflict(f"no commit in {tries} tries")

    def unused(self) -> list[str]:
        """Folders of rows that no version names."""
        named = {f for v in self._numbers() if (m := self._load(v)) for f in m.folders.values()}
        folder = self._path("rows")
        runs = [r.getPath().toString() for r in (self._fs.listStatus(folder) if self._fs.exists(folder) else [])]
        return [r for r in runs if not any(f.startswith(r) for f in named)]


def fold_stream(stream: DataFrame, store: Snapshots, name: str, change: Callable[[DataFrame, DataFrame], DataFrame], progress: str) -> None:
    """Fold all that a stream has now into a state, each batch once.

    ``change`` makes the new rows from the state and a batch. A batch's number is committed with its rows, in one manifest, so a
    batch that is run again after a failure, or by a second run of the stream, finds its number and changes nothing.
    """
    note = f"batch of {name}"

    def fold(batch: DataFrame, epoch: int) -> None:
        while True:
            base = store.newest()
            if base.notes.get(note, -1) >= epoch:
                return
            try:
                store.commit(change(store.read(base), batch), base, notes={note: epoch})
                return
            except Conflict:
                continue

    query = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(fold).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
