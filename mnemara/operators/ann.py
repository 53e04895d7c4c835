"""Approximate filtered vector search: inverted lists around centroids.

``Lists.build`` fits centroids on a bounded sample (``SAMPLE`` rows by hash; what is indexed is every row), puts every row into the
list of its nearest centroid and writes a table partitioned by list, so a probe reads the files of its lists only and a filter on other columns
is part of that scan. A list with many rows has several files and meets its queries block by block in several tasks.

How many lists a query reads first is measured: on the sample, so many that at least ``TARGET`` of the nearest neighbours of ``TRIED``
of its rows by brute force lie in them (in all rows neighbours are nearer, so the lists hold no smaller share of them).

A filtered search gives as many rows as the limit asks for, if there are as many: a query whose lists hold too few rows that
pass the filter goes on to twice as many lists, until all are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemara.functions import vectors as vec
from mnemara.operators import retrieval
from mnemara.streaming.scratch import written

SAMPLE = 20_000
MAX_LISTS = 4096
ROUNDS = 8
TARGET = 0.95
TRIED = 200
NEIGHBOURS = 10
MAX_BROADCAST_ASKED = 50_000
TOGETHER = 1024  # queries that a task compares at a time
MANY = 0.1  # a share of lists beyond which one product over all rows, masked, is faster than one a list


def centroids(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Unit centres of unit vectors, by ``ROUNDS`` turns of spherical k-means; a centre that loses all its rows takes the worst placed one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        s = x @ c.T
        own, near = s.argmax(axis=1), s.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        for empty in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            worst = int(near.argmin())
            total[empty], near[worst] = x[worst], 2.0
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def needed(x: np.ndarray, c: np.ndarray, target: float) -> int:
    """How many of the nearest lists hold a share ``target`` of the nearest neighbours of the first rows of ``x``."""
    q, own = x[:TRIED], (x @ c.T).argmax(axis=1)
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(NEIGHBOURS, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(place[np.arange(len(q))[:, None], own[near]].ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass(frozen=True)
class Lists:
    table: DataFrame  # list, id, v and the columns kept for filters
    centres: np.ndarray
    probes: int  # lists that a query reads first

    @classmethod
    def build(cls, data: DataFrame, lists: int | None = None, target: float = TARGET) -> Lists:
        """From rows ``id, v`` and other columns. Rows without a usable vector of the commonest length are left out, as they are no neighbours."""
        dim = data.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        size = dim["d"] if dim else 1
        good = data.where(vec.is_valid(F.col("v"), size))
        n = good.count()
        few = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
        x = _units(few if isinstance(few, pa.Array) else pa.concat_arrays(few.chunks), size) if n else np.ones((1, size))
        k = max(1, min(MAX_LISTS, len(x), lists or round(n**0.5)))
        c = centroids(x, k)
        shared = data.sparkSession.sparkContext.broadcast(c)  # lists x dimensions

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = (_units(b.column(b.schema.get_field_index("v")), size) @ shared.value.T).argmax(axis=1) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], [*b.schema.names, "list"])

        placed = good.mapInArrow(place, f"{_ddl(good)}, list int").repartitionByRange("list", "id").sortWithinPartitions("list", "id")
        return cls(written(placed, "lists", ["list"]), c, needed(x, c, target))

    def search(self, queries: DataFrame, n: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """``query_id, id, similarity, rank`` for ``queries`` (``query_id, q``): nearly the ``n`` nearest rows that pass ``where``."""
        k, dim = self.centres.shape
        shared = queries.sparkSession.sparkContext.broadcast(self.centres)

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _small(batches):
                near = np.argsort(-(_units(b.column(1), dim) @ shared.value.T), axis=1, kind="stable").astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * k, near.ravel())], ["query_id", "q", "near"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).where(vec.is_valid(F.col("q"), dim))
        asked = written(asked.mapInArrow(order, "query_id long, q array<double>, near array<int>"), "asked")
        found, done, more = None, 0, min(k, probes or self.probes)
        while True:
            part = written(self._probe(asked, n, where, done, more), "probed")
            found = part if found is None else found.unionByName(part)
            done += more
            if done >= k:
                break
            short = asked.join(found.groupBy("query_id").count().where(F.col("count") >= n), "query_id", "left_anti")
            asked = written(short, "asked")
            if not asked.limit(1).count():
                break
            more = min(done, k - done)
        return retrieval.ranked(found, ["query_id"], [F.desc("similarity"), F.col("id")], n)

    def _probe(self, asked: DataFrame, n: int, where: Column | None, done: int, more: int) -> DataFrame:
        """Candidates from lists number ``done`` to ``done + more`` in the order of each query."""
        n_asked = asked.count()
        if n_asked * more > MAX_BROADCAST_ASKED:
            found = self._in_cells(asked, n_asked, n, where, done, more)
            return retrieval.ranked(found, ["query_id"], [F.desc("similarity"), F.col("id")], n).drop("rank")
        pairs = asked.select(F.explode(F.slice("near", done + 1, more)).alias("list"), "query_id", "q")
        lists = [r["list"] for r in pairs.select("list").distinct().collect()]  # at most as many as there are lists
        rows = self.table.where(F.col("list").isin(lists))
        rows = rows if where is None else rows.where(where)
        packed = retrieval._packed(rows.select(F.col("list").alias("block"), F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), "v"), retrieval.ROWS_A_BLOCK)
        keyed = pairs.select(F.col("list").alias("block"), F.col("query_id").alias("id"), F.lit(0).cast("long").alias("tag"), F.col("q").alias("v"))
        sent = retrieval._packed(keyed.repartition("block"), retrieval.QUERIES_A_BLOCK).select("block", F.col("ids").alias("q_ids"), F.col("tags").alias("q_tags"), F.col("x").alias("q"))
        met = packed.join(F.broadcast(sent), "block").drop("block")
        return retrieval.ranked(retrieval.scored(met, n), ["query_id"], [F.desc("similarity"), F.col("id")], n).drop("rank")

    def _in_cells(self, asked: DataFrame, n_asked: int, n: int, where: Column | None, done: int, more: int) -> DataFrame:
        """Many queries: parts of them meet parts of the rows, a list at a time. A query is sent once a part, with a bit a list, not once a list."""
        k, dim = self.centres.shape
        lists = [r["list"] for r in asked.select(F.explode(F.slice("near", done + 1, more)).alias("list")).distinct().collect()]  # at most as many as there are lists
        rows = self.table.where(F.col("list").isin(lists))
        rows = rows if where is None else rows.where(where)
        parts = retrieval.sides(rows.count(), n_asked)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _small(batches):
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x, near = _units(b.column(1), dim), b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                reads, part = np.zeros((len(ids), k), bool), b.column(3).to_numpy(zero_copy_only=False)
                np.put_along_axis(reads, near.astype(np.int64), True, axis=1)
                for p in np.unique(part):
                    own = part == p
                    values = [ids[own].tobytes(), np.packbits(reads[own], axis=1).tobytes(), x[own].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], ["block", "ids", "reads", "x"])

        part = F.pmod(F.xxhash64("query_id"), F.lit(parts[1])).cast("int").alias("part")
        sent = asked.select("query_id", "q", F.slice("near", done + 1, more).alias("near"), part).mapInArrow(pack, "block int, ids binary, reads binary, x binary")
        packed = retrieval._part(rows.select("id", F.col("list").alias("tag"), "v"), parts[0], retrieval.ROWS_A_BLOCK)
        return retrieval.cells_met(packed, sent, parts, lambda r, q: _probed(r, q, k, n), retrieval.FOUND)


def _probed(rows: pa.Table, asked: pa.Table, k: int, n: int) -> pa.Table:
    """Of a part of the rows the ``n`` nearest to each query of a part, in the lists that it reads."""
    q_ids, best, own = [], [], []
    for ids, reads, x in zip(*(asked[c].to_pylist() for c in ("ids", "reads", "x")), strict=True):
        ids = np.frombuffer(ids, np.int64)
        own.append((ids, np.frombuffer(reads, np.uint8).reshape(len(ids), -1), np.frombuffer(x).reshape(len(ids), -1)))
    sides = list(retrieval.held(rows).values())
    if own and sides:
        (ids, lists, x), (asked_ids, reads, q) = sides[0], (np.concatenate(c) for c in zip(*own, strict=True))
        order = np.argsort(lists, kind="stable")  # of a list in the order of the ids
        ids, lists, x = ids[order], lists[order], x[order]
        names, first = np.unique(lists, return_index=True)
        ends = np.append(first[1:], len(lists))
        for at in range(0, len(q), TOGETHER):
            bits = np.unpackbits(reads[at : at + TOGETHER], axis=1, count=k).astype(bool)
            top, some = retrieval.Best(len(bits), n), q[at : at + TOGETHER]
            if bits.mean() > MANY:
                for r in range(0, len(x), retrieval.ROWS_A_BLOCK):
                    s = some @ x[r : r + retrieval.ROWS_A_BLOCK].T
                    s[~bits[:, lists[r : r + retrieval.ROWS_A_BLOCK]]] = -np.inf
                    top.meet(s, ids[r : r + retrieval.ROWS_A_BLOCK])
            else:
                for name, begin, end in zip(names.tolist(), first.tolist(), ends.tolist(), strict=True):
                    who = np.flatnonzero(bits[:, name])
                    for r in range(begin, end if len(who) else begin, retrieval.ROWS_A_BLOCK):
                        stop = min(end, r + retrieval.ROWS_A_BLOCK)
                        top.meet(some[who] @ x[r:stop].T, ids[r:stop], who)
            q_ids.append(asked_ids[at : at + TOGETHER])
            best.append(top)
    return retrieval.found_table(q_ids, best)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as each row becomes a number a list."""
    for b in batches:
        for at in range(0, b.num_rows, TOGETHER):
            yield b.slice(at, TOGETHER)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def recalled(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of an exact search's rows that another search found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
