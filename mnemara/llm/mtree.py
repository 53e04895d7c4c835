"""Exact top-k by inner product with M-trees searched best first.

Inner products are made a metric: with ``R`` the largest norm, a vector ``x`` stands as ``(x, sqrt(R^2 - |x|^2))`` and a
query as ``(q, 0)``; then the squared distance is ``|q|^2 + R^2 - 2 q.x`` and the nearest vectors are those of highest score.

Build: a bounded sample of vectors are pivots; every vector goes to its nearest pivot, and what a pivot gathers is
dealt by id over trees of about ``TREE`` vectors (a hot vector over many). A tree has a root and pages of up to ``PAGE``
entries; root and pages keep a routing vector and a covering radius, and every page and entry its distance to its
parent's routing vector.

Search: blocks of queries meet groups of trees on a grid (each block is sent to each group, each tree to each block). A
task keeps the block's k best so far. Trees and pages whose covering ball lies beyond a query's k-th distance are
passed over; whether that is so is first read from stored parent distances, without computing one. Pages are visited
best first for each query, entries outside the band that their parent distance allows are skipped, and what remains is
scored as one product of integers. The k best of all groups are ranked again. Ties go to the smaller id throughout.

Bounds hold with a slack above rounding, so results are exact; scores are integers.

Edge cases: vectors that are null or hold null or non-finite components take no part (nor do empty ones); vectors of
different lengths never meet; a query sees every row but those with its own id; ids repeated among queries search
once (with the smallest vector); null ids take no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import materialise, ship, table

K = 20
SCALE = 64
EVERY = 20
PIVOTS = 128
TREE = 4096
PAGE = 64
TREES_A_GROUP = 4
MIN_BLOCK, MAX_BLOCK = 256, 8192
SLACK = 1e-6


def integer_vector(v: Column) -> Column:
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return F.when(good, F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two integer arrays."""
    if np.sqrt((a.astype(float) ** 2).sum(axis=1).max()) * np.sqrt((b.astype(float) ** 2).sum(axis=1).max()) < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors in the metric space; ``top`` is the largest squared norm."""
    f = x.astype(float)
    return np.concatenate([f, np.sqrt(np.maximum(0.0, top - (f * f).sum(axis=1)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d))


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them all."""
    most = max(int(x.max()), -int(x.min()) - 1) if x.size else 0
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def widen(raw: bytes, n: int, dim: int) -> np.ndarray:
    """The integers of ``narrow``, whose type shows in their size."""
    return np.frombuffer(raw, f"i{len(raw) // max(1, n * dim)}").astype(np.int64).reshape(n, dim)


class Tree:
    """An M-tree of one level of pages below the root, in arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float) -> None:
        lifted = lift(x, top)
        centre = lifted.mean(axis=0, keepdims=True)
        root = int(np.argmin(distances(lifted, centre)[:, 0]))
        n_pages = -(-len(x) // PAGE)
        rng = np.random.default_rng(len(x))
        routes = rng.choice(len(x), min(n_pages, len(x)), replace=False)
        to_route = distances(lifted, lifted[routes])
        nearest = to_route.argmin(axis=1)
        own = to_route[np.arange(len(x)), nearest]
        order = np.lexsort((ids, own, nearest))
        page_start, page_route = [], []
        for r in range(len(routes)):
            members = np.searchsorted(nearest[order], [r, r + 1])
            for at in range(members[0], members[1], PAGE):  # a page that is too full is cut by distance
                page_start.append(at)
                page_route.append(routes[r])
        self.starts = np.array([*page_start, len(x)])
        self.ids, self.x, self.parent = ids[order], x[order], own[order]
        self.route = lifted[page_route]
        self.radius = np.array([self.parent[a:b].max() for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)])
        self.root = lifted[root]
        to_root = distances(lifted, lifted[root][None])[:, 0]
        self.root_radius = float(to_root.max())
        self.page_parent = distances(self.route, self.root[None])[:, 0]

    _KINDS = (("starts", np.int64), ("ids", np.int64), ("x", np.int64), ("parent", float), ("route", float), ("radius", float), ("root", float), ("page_parent", float))

    def pack(self) -> list[bytes]:
        """Bytes of every part; vectors in the smallest integers that hold them."""
        parts = [narrow(self.x).tobytes() if k == "x" else getattr(self, k).astype(t).tobytes() for k, t in self._KINDS]
        return [*parts, np.array([self.root_radius]).tobytes()]

    @classmethod
    def unpack(cls, values: list[bytes]) -> Tree:
        t = cls.__new__(cls)
        for (k, kind), v in zip(cls._KINDS, values, strict=False):
            if k != "x":
                setattr(t, k, np.frombuffer(v, kind))
        t.x, t.route = widen(values[[k for k, _ in cls._KINDS].index("x")], len(t.ids), len(t.root) - 1), t.route.reshape(len(t.radius), -1)
        t.root_radius = float(np.frombuffer(values[-1])[0])
        return t


class BlockSearch:
    """The ``k`` best so far of a block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, top: float, k: int) -> None:
        self.ids, self.q, self.k, self.top = ids, q, k, top
        self.lifted = np.concatenate([q.astype(float), np.zeros((len(q), 1))], axis=1)
        self.norms = (self.lifted**2).sum(axis=1)
        self.scores = np.full((len(q), k), np.iinfo(np.int64).min)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.computed = self.skipped = 0

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """Distances beyond which nothing can be among the k best."""
        worst = self.scores[rows, -1]
        full = self.found[rows, -1] != np.iinfo(np.int64).max
        d2 = self.norms[rows] + self.top - 2.0 * worst
        return np.where(full, np.sqrt(np.maximum(0.0, d2)) + SLACK * (1 + np.sqrt(self.norms[rows] + self.top)), np.inf)

    def _offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = self.ids[rows][:, None] == ids
        good = (scores >= self.scores[rows, -1][:, None]) & ~own
        some = good.any(axis=1)
        if not some.any():
            return
        rows, scores, good = rows[some], scores[some], good[some]
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        s = np.concatenate([self.scores[rows], np.where(good, scores, low)], axis=1)
        i = np.concatenate([self.found[rows], np.where(good, ids[None, :], high)], axis=1)
        best = np.lexsort((i, -np.maximum(s, low + 1)), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)

    def visit(self, tree: Tree) -> None:
        if tree.x.shape[1] != self.q.shape[1]:
            return
        rows = np.arange(len(self.q))
        to_root = distances(self.lifted, tree.root[None])[:, 0]
        rows = rows[to_root - tree.root_radius <= self.reach(rows)]
        if not len(rows):
            return
        # Pages that the stored distance to the root rules out need no distance of their own.
        stored = np.abs(to_root[rows][:, None] - tree.page_parent) - tree.radius
        open_pages = np.flatnonzero((stored <= self.reach(rows)[:, None]).any(axis=0))
        if not len(open_pages):
            return
        to_page = distances(self.lifted[rows], tree.route[open_pages])
        bound = np.maximum(to_page - tree.radius[open_pages], stored[:, open_pages])
        turn = np.argsort(bound, axis=1, kind="stable")  # best first for each query
        alive = np.arange(len(rows))
        for step in range(len(open_pages)):
            page = turn[alive, step]
            near = bound[alive, page] <= self.reach(rows[alive])
            alive, page = alive[near], page[near]  # later pages of a query are no nearer
            if not len(alive):
                break
            for p in np.unique(page):
                at = alive[page == p]
                self._page(tree, int(open_pages[p]), rows[at], to_page[at, p])

    def _page(self, tree: Tree, page: int, rows: np.ndarray, to_route: np.ndarray) -> None:
        a, b = tree.starts[page], tree.starts[page + 1]
        parent, reach = tree.parent[a:b], self.reach(rows)
        # Entries stand by parent distance; those outside every query's band are passed over.
        low = a + np.searchsorted(parent, (to_route - reach).min(), side="left")
        high = a + np.searchsorted(parent, (to_route + reach).max(), side="right")
        self.computed += int(high - low) * len(rows)
        self.skipped += int(b - a - (high - low)) * len(rows)
        if low < high:
            self._offer(rows, tree.ids[low:high], products(self.q[rows], tree.x[low:high]))

    def results(self) -> pa.RecordBatch:
        real = self.found != np.iinfo(np.int64).max
        rows, _ = np.nonzero(real)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.array(self.found[real]), pa.array(self.scores[real])], ["query_id", "vec_id", "score"])


_TREE_COLUMNS = [k for k, _ in Tree._KINDS] + ["root_radius"]
_TREE_SCHEMA = "size long, " + ", ".join(f"{c} binary" for c in _TREE_COLUMNS)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def build_trees(vectors: DataFrame, top: int, pivots: int = PIVOTS, tree: int = TREE) -> DataFrame:
    """A written table of trees over ``id, v, dim``."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("dim", "v").collect()  # bounded by ``pivots``
    by_dim: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in sample}:
        by_dim[dim] = lift(np.array([r["v"] for r in sample if r["dim"] == dim], np.int64), top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            pivot = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) in by_dim:
                    pivot[rows] = distances(lift(_matrix(b.column(1).take(pa.array(rows)), len(rows)), top), by_dim[int(dim)]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(pivot)], ["id", "v", "dim", "pivot"])

    dealt = materialise(vectors.select("id", "v", "dim").mapInArrow(assign, "id long, v array<long>, dim int, pivot int"), "dealt")
    salts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("salts"))
    keyed = dealt.join(F.broadcast(salts), ["dim", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.col("salts")))
    # Rows alike in id and vector share a salt; they only repeat results of that id.

    def build(key: tuple, group: pa.Table) -> pa.Table:
        b = group.combine_chunks()
        n = b.num_rows
        x = _matrix(b.column("v").combine_chunks() if isinstance(b.column("v"), pa.ChunkedArray) else b.column("v"), n)
        packed = Tree(b.column("id").to_numpy(), x, top).pack()
        return pa.table([pa.array([n], pa.int64()), *[pa.array([v], pa.binary()) for v in packed]], names=["size", *_TREE_COLUMNS])

    return materialise(keyed.groupBy("dim", "pivot", "salt").applyInArrow(build, _TREE_SCHEMA), "trees")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query (``id, v``) over ``vectors`` (``id, v``)."""
    spark = vectors.sparkSession
    ship(spark)
    sized = [d.select("id", "v", F.size("v").alias("dim")) for d in (vectors, queries)]
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = sized[0].agg(F.max(square)).first()[0] or 0.0
    trees = build_trees(sized[0], top)
    n_trees = trees.select(F.count(F.lit(1))).first()[0]
    single = sized[1].groupBy("id").agg(F.min(F.struct("dim", "v")).alias("s")).select("id", "s.dim", "s.v")
    n_queries = single.select(F.count(F.lit(1))).first()[0]
    size = min(MAX_BLOCK, max(MIN_BLOCK, math.ceil(n_queries / 8)))
    blocks, groups = max(1, math.ceil(n_queries / size)), max(1, math.ceil(n_trees / TREES_A_GROUP))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(3).to_numpy()], axis=1)
            for block, dim in np.unique(key, axis=0):
                rows = np.flatnonzero((key == (block, dim)).all(axis=1))
                x = _matrix(b.column(2).take(pa.array(rows)), len(rows))
                values = [b.column(1).to_numpy()[rows].tobytes(), narrow(x).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([v], pa.binary()) for v in values], pa.array([dim], pa.int32())], ["block", "q_ids", "q", "dim"])

    dealt = single.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v", "dim")
    asked = dealt.repartition(blocks, "block").mapInArrow(pack, "block int, q_ids binary, q binary, dim int")
    empty = [F.lit(None).cast("binary").alias(c) for c in _TREE_COLUMNS]
    q_rows = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("block", "group", F.lit(0).alias("kind"), "q_ids", "q", "dim", *empty)
    t_rows = (
        trees.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("block", "group", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q"), F.lit(None).cast("int").alias("dim"), *_TREE_COLUMNS)
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r].as_py() for i, c in enumerate(b.schema.names)}
                if (row["block"], row["group"]) != at:
                    yield from (s.results() for s in waiting)
                    at, waiting = (row["block"], row["group"]), []
                if row["kind"] == 0:
                    ids = np.frombuffer(row["q_ids"], np.int64)
                    waiting.append(BlockSearch(ids, widen(row["q"], len(ids), row["dim"]), top, k))
                else:
                    tree = Tree.unpack([row[c] for c in _TREE_COLUMNS])
                    for s in waiting:
                        s.visit(tree)
        yield from (s.results() for s in waiting)

    grid = q_rows.unionByName(t_rows).repartition(max(blocks * groups, 1), "block", "group").sortWithinPartitions("block", "group", "kind")
    part = grid.mapInArrow(scan, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), integer_vector(F.col("embedding")).alias("v"))
    rows = rows.where("v is not null and id is not null")
    return search(rows, rows.where(F.col("id") % EVERY == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
