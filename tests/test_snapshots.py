"""Versions of a state: two writers, lost claims, and a stream folded in once."""

import threading

import pytest
from pyspark.sql import functions as F

from mnemara.operators import snapshots
from mnemara.operators.snapshots import Conflict, Snapshots
from mnemara.streaming.scratch import shared_folder

SCHEMA = "id long, n long"


def rows(store, at=None):
    return {r["id"]: r["n"] for r in store.read(at).collect()}


def frame(spark, values):
    return spark.createDataFrame(list(values.items()), SCHEMA)


def test_versions_and_conflicts(spark):
    store = Snapshots(spark, shared_folder(spark, "store"), SCHEMA, buckets=4)
    assert rows(store) == {} and store.newest().version == 0
    one = store.commit(frame(spark, {i: 0 for i in range(20)}), store.newest())
    two = store.commit(frame(spark, {1: 5, 30: 6}), one, gone=frame(spark, {2: 0}))
    assert (one.version, two.version) == (1, 2) and rows(store, one) == {i: 0 for i in range(20)}
    want = {i: 0 for i in range(20) if i != 2} | {1: 5, 30: 6}
    assert rows(store) == want and sum(one.folders[b] == two.folders.get(b) for b in one.folders) >= 1
    with pytest.raises(Conflict):  # made from a version whose row has changed since
        store.commit(frame(spark, {1: 7}), one)
    assert rows(store) == want and len(store.unused()) == 1
    other = next(i for i in range(20) if rows(store)[1] == 5 and store.spark.range(i, i + 1).select(store.bucket()).first()[0] not in {b for b in one.folders if one.folders[b] != two.folders.get(b)})
    assert store.commit(frame(spark, {other: 9}), one).version == 3  # another bucket: goes on from the newer version
    assert rows(store) == want | {other: 9}


def test_two_writers_lose_nothing(spark):
    store = Snapshots(spark, shared_folder(spark, "store"), SCHEMA, buckets=2)
    store.commit(frame(spark, {i: 0 for i in range(6)}), store.newest())
    base, conflicts = store.newest(), []

    def once(value):
        try:
            store.commit(frame(spark, {i: value for i in range(6)}), base)
        except Conflict:
            conflicts.append(value)

    def more():
        store.update(lambda s: s.withColumn("n", F.col("n") + 1))

    for target in (lambda: once(10), lambda: once(20)), (more, more, more):
        threads = [threading.Thread(target=t) for t in target]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert len(conflicts) == 1 and set(rows(store).values()) == {(10 if conflicts == [20] else 20) + 3}


def test_a_writer_that_died_after_its_claim(spark, monkeypatch):
    store = Snapshots(spark, shared_folder(spark, "store"), SCHEMA)
    store.commit(frame(spark, {1: 1}), store.newest())
    store._fs.create(store._path("manifests/0000000002"), False).close()
    monkeypatch.setattr(snapshots, "LEASE", 0.5)
    assert store.newest().version == 1
    assert store.commit(frame(spark, {1: 2}), store.newest()).version == 3 and rows(store) == {1: 2}


def test_a_replayed_stream_changes_nothing(spark):
    folder, store = shared_folder(spark, "in"), Snapshots(spark, shared_folder(spark, "store"), SCHEMA)
    spark.range(40).select((F.col("id") % 7).alias("id")).repartition(4).write.parquet(folder)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)

    def add(state, batch):
        return batch.groupBy("id").agg(F.count("*").alias("m")).join(state, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("m")).alias("n"))

    failed = []

    def fails_after_commit(state, batch):
        if store.newest().version == 2 and not failed:
            failed.append(1)
            raise RuntimeError("an executor is lost")
        return add(state, batch)

    progress = shared_folder(spark, "progress")
    with pytest.raises(Exception, match="an executor is lost"):
        snapshots.fold_stream(stream(), store, "s", fails_after_commit, progress)
    assert store.newest().version == 2
    snapshots.fold_stream(stream(), store, "s", add, progress)
    want = {i: len(range(i, 40, 7)) for i in range(7)}
    assert rows(store) == want and store.newest().version == 4
    snapshots.fold_stream(stream(), store, "s", add, shared_folder(spark, "again"))  # progress lost: all batches come again
    assert rows(store) == want and store.newest().version == 4
