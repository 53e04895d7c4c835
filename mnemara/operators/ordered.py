"""Ordered supersede in batches, without one task a space.

Writes come in order (``id``): each takes the place of the nearest current vector of its space if their cosine reaches tau, else
it is a new fact. A space is folded ``BATCH`` writes at a time. What a batch meets is what is current before it, so work grows
with writes times current vectors, not with all pairs of writes. Where at most ``DENSE`` vectors are current, they meet the batch in
one task. Where there are more, their blocks are dealt over all tasks, each of which finds the ``near`` nearest of every write
of the batch by matrix products; one task then folds the batch from these lists and the batch's own vectors. A write whose whole list
was taken within the batch, while more may be near, ends the batch there: the rest is searched again, with lists of double length.
All spaces and thresholds go side by side; rounds are as many as the largest space has batches.

Cosines are rounded to nine places; of equal ones the write of largest id counts. Vectors that are null, empty or without length are near nothing,
vectors of different lengths aren't near each other. Ids must be distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemara.streaming.scratch import written

NEAR = 32
BLOCK = 2048
BATCH = 8192
DENSE = 8192
COMPACT = 8
STEP = 256
MAX_BROADCAST_BLOCKS = 64

_BLOCK = "key string, no long, n long, ids binary, x binary"
_STATE = "tau double, key string, last long, no long, n long, ids binary, slots binary, versions binary, x binary"


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"double": pa.float64(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows ``key, id, v`` as blocks of unit vectors of one key in the order of ids; ``no`` is the first id."""
    most = BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs = None, [], []
        row = lambda: _table(_BLOCK, [(key, ids[0], len(ids), np.array(ids, np.int64).tobytes(), np.array(xs).tobytes())])
        for b in batches:
            keys, numbers = b.column(0).to_pylist(), b.column(1).to_pylist()
            length = np.asarray(b.column(2).value_lengths().fill_null(0))
            start, flat = np.cumsum(length) - length, b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
            for r in np.flatnonzero(length).tolist():
                x = flat[start[r] : start[r] + length[r]]
                size = np.sqrt((x * x).sum())
                if not np.isfinite(size) or size == 0:
                    continue
                if ids and (keys[r] != key or len(ids) == most):
                    yield row()
                    ids, xs = [], []
                key = keys[r]
                ids.append(numbers[r])
                xs.append(x / size)
        if ids:
            yield row()

    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return written(ordered.select("key", "id", "v").mapInArrow(pack, _BLOCK), "blocks")


def _batches(blocks: DataFrame) -> DataFrame:
    """Blocks by ``batch``: consecutive ones of a key, some ``BATCH`` writes each; ``last`` is the key's last batch."""
    w = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(w.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = blocks.select("key", "no", "n").withColumn("batch", F.floor(before / BATCH).cast("long")).withColumn("last", F.max("batch").over(w)).drop("n")
    return written(blocks.join(numbered, ["key", "no"]), "batches", by=["batch"])


def _ids(blobs: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.frombuffer(z, np.int64) for z in blobs]) if blobs else np.zeros(0, np.int64)


def _nearest(live: DataFrame, want: DataFrame, n: int, margin: float, few: bool) -> DataFrame:
    """``tau, key, id, near, s, slot, version, no``: of the vectors current in ``live``, the ``n`` nearest to each write of ``want``."""
    sent = want.select("tau", "key", F.col("no").alias("b"), F.col("ids").alias("j"), F.col("x").alias("y"))
    if few:
        spread = live.repartition(2 * live.sparkSession.sparkContext.defaultParallelism)
        met = spread.join(F.broadcast(sent), ["tau", "key"])
    else:  # pairs of numbers first; a space's blocks are then dealt over all tasks
        pairs = live.select("tau", "key", "no").join(sent.select("tau", "key", "b"), ["tau", "key"])
        met = pairs.join(live, ["tau", "key", "no"]).join(sent, ["tau", "key", "b"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                tau, key, no, gone, i, slot, version, x, j, y = (b.column(c)[r].as_py() for c in range(10))
                i, slot, version, j = (np.frombuffer(z, np.int64) for z in (i, slot, version, j))
                free = ~np.isin(i, _ids(gone))
                i, slot, version, x = i[free], slot[free], version[free], np.frombuffer(x).reshape(len(free), -1)[free]
                s = np.round(np.frombuffer(y).reshape(len(j), -1) @ x.T, 9)
                row, col = np.nonzero(s >= tau - margin)
                s = s[row, col]
                order = np.lexsort((-i[col], -s, row))
                row, col, s = row[order], col[order], s[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < n
                row, col, s = row[best], col[best], s[best]
                names = ["tau", "key", "id", "near", "s", "slot", "version", "no"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), tau)), pa.array([key] * len(s), pa.string()), *map(pa.array, (j[row], i[col], s, slot[col], version[col], np.full(len(s), no)))], names)

    columns = ["tau", "key", "no", "gone", "ids", "slots", "versions", "x", "j", "y"]
    found = met.select(*columns).mapInArrow(nearest, "tau double, key string, id long, near long, s double, slot long, version long, no long")
    w = Window.partitionBy("tau", "id").orderBy(F.desc("s"), F.desc("near"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def _folded(want: DataFrame, small: DataFrame, near: DataFrame | None, sizes: DataFrame | None, n: int, margin: float) -> DataFrame:
    """A batch of each key, written one after the other: ``kind`` and the columns of a state.

    ``done``: what became of writes; ``live``: those of them that are current; ``gone``: what was current before, by block;
    ``rest``: writes that must be searched again; ``size`` (``n``): how many vectors are current.
    """
    none = lambda k: F.lit(None).cast(k)
    shape = {"tau": "double", "key": "string", "last": "long", "no": "long", "part": "int", "n": "long", "ids": "binary", "slots": "binary", "versions": "binary", "x": "binary", "gone": "array<binary>"}
    shape |= {"id": "long", "near": "long", "s": "double", "slot": "long", "version": "long"}
    parts = [(0, sizes), (1, small), (2, near), (3, want)]
    laid = [df.withColumn("part", F.lit(p)).select(*[F.col(c).cast(k).alias(c) if c in (*df.columns, "part") else none(k).alias(c) for c, k in shape.items()]) for p, df in parts if df is not None]
    rows = laid[0]
    for more in laid[1:]:
        rows = rows.unionByName(more)
    block, step = BLOCK, STEP

    def fold(tau: float, key: str, rows: list[tuple]) -> Iterator[tuple]:
        size, last, old, lists, new = 0, None, [], {}, []
        for r in rows:
            if r[4] == 0:
                size = r[5]
            elif r[4] == 1:
                ids, slots, versions = (np.frombuffer(z, np.int64) for z in r[6:9])
                free = ~np.isin(ids, _ids(r[10]))
                old.append((ids[free], slots[free], versions[free], np.full(free.sum(), r[3]), np.frombuffer(r[9]).reshape(len(ids), -1)[free]))
            elif r[4] == 2:
                lists.setdefault(r[11], []).append((r[13], r[12], r[14], r[15], r[3]))
            else:
                last = r[2]
                ids = np.frombuffer(r[6], np.int64)
                new.append((ids, np.frombuffer(r[9]).reshape(len(ids), -1)))
        if not new:
            return
        ids, x = (np.concatenate(z) for z in zip(*new, strict=True))
        order = np.argsort(ids)
        ids, x, m = ids[order], x[order], len(ids)
        i, slot, version, no, xo = (np.concatenate(z) for z in zip(*old, strict=True)) if old else (*[np.zeros(0, np.int64)] * 4, np.zeros((0, x.shape[1])))
        order = np.argsort(i)
        i, slot, version, no, xo = i[order], slot[order], version[order], no[order], xo[order]
        a = len(i)
        i, slot, version, cols = np.concatenate([i, ids]), np.concatenate([slot, ids]), np.concatenate([version, np.ones(m, np.int64)]), np.concatenate([xo, x])
        closed, line = np.zeros(a + m), np.empty(a + m)  # minus infinity where a vector is taken
        taken: dict[int, int] = {}
        need, end = 2 if margin > 0 else 1, m
        for j in range(m):
            if j % step == 0:
                s = np.round(x[j : j + step] @ cols[: a + min(j + step, m)].T, 9)
            w, found = a + j, []
            if w:
                np.add(s[j % step, :w], closed[:w], out=line[:w])
                for _ in range(need):
                    k = w - 1 - int(line[:w][::-1].argmax())
                    if line[k] < tau - margin:
                        break
                    found.append((float(line[k]), int(i[k]), int(slot[k]), int(version[k]), k))
                    line[k] = -np.inf
            known = sorted(lists.get(int(ids[j]), ()), reverse=True)
            free = [c for c in known if c[1] not in taken][:need]
            if len(known) >= n and len(free) < need:  # others may be as near as the last of the list
                if len(free) + sum(f[0] >= known[-1][0] for f in found) < need:
                    end = j
                    break
            best = sorted([(*f, None) for f in found] + [(*c[:4], -1, c[4]) for c in free], key=lambda c: c[:2], reverse=True)[:need]
            if best and best[0][0] >= tau and (len(best) < 2 or round(best[0][0] - best[1][0], 9) >= margin):
                _, i_, slot_, version_, k, block_ = best[0]
                slot[w], version[w] = slot_, version_ + 1
                if k < 0:
                    taken[i_] = block_
                else:
                    closed[k] = -np.inf
                    if k < a:
                        taken[i_] = int(no[k])
        put = lambda kind, no, n, *z: (kind, tau, key, last, no, n, *[None if c is None else np.ascontiguousarray(c).tobytes() for c in z])
        if end:
            yield put("done", int(ids[0]), end, ids[:end], slot[a : a + end], version[a : a + end], None)
        kept = a + np.flatnonzero(closed[a : a + end] == 0)
        for lo in range(0, len(kept), block):
            k = kept[lo : lo + block]
            yield put("live", int(i[k[0]]), len(k), i[k], slot[k], version[k], cols[k])
        by_block: dict[int, list[int]] = {}
        for one, where in taken.items():
            by_block.setdefault(where, []).append(one)
        for where, gone in by_block.items():
            yield put("gone", where, len(gone), np.array(gone, np.int64), None, None, None)
        for lo in range(end, m, block):
            yield put("rest", int(ids[lo]), len(ids[lo : lo + block]), ids[lo : lo + block], None, None, x[lo : lo + block])
        yield put("size", 0, size + len(kept) - len(taken), None, None, None, None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (tau, key), own in groupby(rows, lambda r: r[:2]):
            for out in fold(tau, key, own):
                yield _table(f"kind string, {_STATE}", [out])

    together = rows.repartition("tau", "key").sortWithinPartitions("tau", "key", "part")
    return written(together.mapInArrow(each, f"kind string, {_STATE}"), "folded", by=["kind"])


def _compacted(live: DataFrame) -> DataFrame:
    """Blocks without what is gone, small ones of a key put together."""
    most = BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}

        def row(key: tuple) -> pa.RecordBatch:
            z = [np.concatenate(c) for c in zip(*held.pop(key), strict=True)]
            return _table(_STATE, [(*key[:3], int(z[0][0]), len(z[0]), *[c.tobytes() for c in z])])

        for b in batches:
            for r in range(b.num_rows):
                tau, key, last, gone, ids, slots, versions, x = (b.column(c)[r].as_py() for c in range(8))
                ids, slots, versions = (np.frombuffer(z, np.int64) for z in (ids, slots, versions))
                free = ~np.isin(ids, _ids(gone))
                if free.any():
                    own = held.setdefault((tau, key, last), [])
                    if own and sum(len(o[0]) for o in own) + free.sum() > most:
                        yield row((tau, key, last))
                        own = held.setdefault((tau, key, last), [])
                    own.append((ids[free], slots[free], versions[free], np.frombuffer(x).reshape(len(ids), -1)[free]))
        for key in list(held):
            yield row(key)

    return written(live.select("tau", "key", "last", "gone", "ids", "slots", "versions", "x").mapInArrow(pack, _STATE), "live")


def _folds(blocks: DataFrame, taus: list[float], near: int, margin: float) -> DataFrame:
    """``tau, id, slot, version`` of every write in ``blocks``."""
    spark = blocks.sparkSession
    batches = _batches(blocks)
    counts = {r["batch"]: r["n"] for r in batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a batch
    each = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    kept, recent, done, sizes = None, [], [], None
    for t in sorted(counts):
        want, few, n, now = batches.where(F.col("batch") == t).select(each, "key", "last", "no", "n", "ids", "x"), counts[t] * len(taus) <= MAX_BROADCAST_BLOCKS, near, []
        while True:
            small, found, before = spark.createDataFrame([], f"{_STATE}, gone array<binary>"), None, sizes
            if sizes is not None:
                parts = [d.where("kind = 'live'").drop("kind") for d in recent] + ([kept] if kept is not None else [])
                live = parts[0]
                for p in parts[1:]:
                    live = live.unionByName(p)
                gone = recent[0].where("kind = 'gone'")
                for d in recent[1:]:
                    gone = gone.unionByName(d.where("kind = 'gone'"))
                live = live.where(F.col("last") >= t).join(gone.groupBy("tau", "key", "no").agg(F.collect_list("ids").alias("gone")), ["tau", "key", "no"], "left")
                if len(recent) > COMPACT:
                    kept = _compacted(live)
                    recent = [spark.createDataFrame([], recent[0].schema)]
                    live = kept.withColumn("gone", F.lit(None).cast("array<binary>"))
                large = F.broadcast(sizes.where(F.col("n") > DENSE).select("tau", "key"))  # at most writes / DENSE rows
                small = live.join(large, ["tau", "key"], "left_anti")
                if sizes.where(F.col("n") > DENSE).limit(1).count():
                    found = _nearest(live.join(large, ["tau", "key"], "left_semi"), want.join(large, ["tau", "key"], "left_semi"), n, margin, few)
            out = _folded(want, small, found, before, n, margin)
            recent.append(out)
            done.append(out)
            now.append(out)
            size = now[0].where("kind = 'size'").select("tau", "key", "n", F.lit(0).alias("at"))
            for at, d in enumerate(now[1:], 1):
                size = size.unionByName(d.where("kind = 'size'").select("tau", "key", "n", F.lit(at).alias("at")))
            sizes = size.groupBy("tau", "key").agg(F.max_by("n", "at").alias("n")) if len(now) > 1 else size.drop("at")
            want, n = out.where("kind = 'rest'").select("tau", "key", "last", "no", "n", "ids", "x"), n * 2
            if not want.limit(1).count():
                break

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in range(b.num_rows):
                tau, *z = (b.column(c)[r].as_py() for c in range(4))
                arrays = [np.frombuffer(c, np.int64) for c in z]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), tau)), *map(pa.array, arrays)], ["tau", "id", "slot", "version"])

    told = spark.createDataFrame([], "tau double, ids binary, slots binary, versions binary")
    for d in done:
        told = told.unionByName(d.where("kind = 'done'").select("tau", "ids", "slots", "versions"))
    return told.mapInArrow(rows, "tau double, id long, slot long, version long")


def supersede_fold(ops: DataFrame, taus: list[float], near: int = NEAR, margin: float = 0.0) -> DataFrame:
    """``tau, space, id, action, slot, version, source_count`` of writes ``space, id, v`` for each of ``taus``.

    ``slot`` is the first write of the fact, ``version`` its place in the fact's chain. With a ``margin``, the nearest current
    vector must also be nearer than the second nearest by so much.
    """
    rows = ops.select("space", F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    key = F.concat_ws("/", F.size("v").cast("string"), F.concat(F.lit("="), F.col("space").cast("string")))
    blocks = _blocks(rows.where(F.size("v") > 0).select(key.alias("key"), "id", "v"))
    found = _folds(blocks, taus, max(near, 2 if margin > 0 else 1), margin)
    each = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    out = rows.select("space", "id", each).join(found, ["tau", "id"], "left")
    version = F.coalesce("version", F.lit(1)).cast("int")
    action = F.when(version > 1, "superseded").otherwise("created")
    return written(out.select("tau", "space", "id", action.alias("action"), F.coalesce("slot", "id").alias("slot"), version.alias("version"), version.alias("source_count")), "superseded")


def study(writes: DataFrame, taus: list[float], margin: float = 0.0) -> DataFrame:
    """What a threshold does to labelled writes (``space, id, grp, role, kind, v``), a row for each of ``taus``.

    Writes of a ``correction`` group are one fact, every other write is a fact of its own. A write that takes a write of its own
    fact is ``correct``, of another ``false``; an ``update`` of a correction that takes nothing is ``missed``. ``lost``: facts that
    ended in a slot with others, beyond one a slot. ``split``: slots of correction facts beyond one a fact.
    """
    fact = F.when(F.col("kind") == "correction", F.concat(F.lit("correction:"), "grp")).otherwise(F.concat("kind", F.lit(":"), "grp", F.lit("#"), F.col("id").cast("string")))
    facts = written(writes.select("id", "role", "kind", "grp", fact.alias("fact")), "facts")
    out = written(supersede_fold(writes, taus, margin=margin).select("tau", "id", "action", "slot", "version").join(facts, "id"), "studied")
    before = out.select("tau", "slot", (F.col("version") + 1).alias("version"), F.col("fact").alias("was"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    merged, same = F.col("action") == "superseded", F.col("fact") == F.col("was")
    events = out.join(before, ["tau", "slot", "version"], "left").groupBy("tau").agg(
        F.count(F.lit(1)).alias("writes"), n(merged & same).alias("correct"), n(merged & ~same).alias("false"),
        n((F.col("action") == "created") & (F.col("kind") == "correction") & (F.col("role") == "update")).alias("missed"), F.count_distinct("slot").alias("survivors"), F.count_distinct("fact").alias("ideal"),
    )
    pairs = out.select("tau", "slot", "fact", "kind").distinct()
    lost = pairs.groupBy("tau").agg((F.count(F.lit(1)) - F.count_distinct("slot")).alias("lost"))
    split = pairs.where("kind = 'correction'").groupBy("tau").agg((F.count(F.lit(1)) - F.count_distinct("fact")).alias("split"))
    return events.join(lost, "tau").join(split, "tau", "left").select("tau", "writes", "correct", "false", "missed", "lost", F.coalesce("split", F.lit(0)).alias("split"), "survivors", "ideal")
