"""Embedding near-duplicates from int8 tile products with rigorous error bounds.

Equal vectors are one class (a grouped count), so copies never meet as pairs. Classes are packed into tiles of unit
vectors quantised to int8: ``u = s q + e`` with ``|e|`` kept for each vector. For two unit vectors

    | u.v - s_u s_v q_u.q_v |  <=  |e_u| + |e_v| + |e_u| |e_v|

so a pair whose integer product stays below the threshold by more than this bound is certainly no link, one that stays
above it by more certainly is; only the others are computed from the original vectors in double precision. Every pair of
tiles meets in one task, strip by strip, which passes on link counts by class and the links that join two groups not yet
joined in it: never all pairs of a dense group, nor a list of them.

Tile pairs come from a join on tile numbers; a task holds two tiles and a strip of their product, whatever the data's
size. Tiles carry vectors in the precision of the table. Rows find their class again by two hashes of the vector; the
labels of the at most ``HOT`` classes with more than 1 / ``HOT`` of all rows are broadcast.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths don't link; repeated rows are vectors of their own; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import materialise, ship, table, worker_state
from mnemara.llm.graph import components
from mnemara.llm.simhash import _Forest, _Rows

THRESHOLD = 0.95
TILE = 4096
STRIP = 256
HOT = 1000
RECHECK = 1 << 16
SLACK = 1e-5  # for single-precision rounding of exact integer products times scales


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error norms of the unit vectors of ``x``'s rows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # no overflow in the norm
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1, keepdims=True) / 127
    q = np.rint(u / scale)
    return q.astype(np.int8), scale[:, 0], np.linalg.norm(u - q * scale, axis=1)


def possible(qa, sa, ea, qb, sb, eb, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may reach the threshold, and which of them certainly do."""
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integer products stay exact
    g = qa.astype(kind) @ qb.astype(kind).T
    g *= sb.astype(kind)
    worst = eb.max()
    i, j = np.nonzero(g >= ((threshold - ea - worst - ea * worst - SLACK) / sa).astype(kind)[:, None])
    bound, product = ea[i] + eb[j] + ea[i] * eb[j] + SLACK, g[i, j] * sa[i]
    keep = product >= threshold - bound
    return i[keep], j[keep], (product - bound >= threshold)[keep]


def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), RECHECK):
        a, b = x[i[at : at + RECHECK]].astype(np.float64), y[j[at : at + RECHECK]].astype(np.float64)
        out[at : at + RECHECK] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    return out


_TILE_SCHEMA = "tile long, cids binary, counts binary, vectors binary, codes binary, scales binary, errors binary"
_TILE_COLUMNS = ["cids", "counts", "vectors", "codes", "scales", "errors"]


def make_tiles(classes: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows of up to ``tile`` classes, numbered from 0; ``classes`` is a written table of ``cid, n, v`` with vectors of one length a tile."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of a tile's rows at least, but for the last."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= tile:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if any(x.num_rows for x in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            cid, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            length = np.asarray(b.column(2).value_lengths())
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(length)])
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                for at in range(0, len(rows), tile):
                    r = rows[at : at + tile]
                    x = flat[start[r][:, None] + np.arange(size)]
                    q, s, e = quantise(x.astype(np.float64))
                    values = [cid[r].tobytes(), n[r].tobytes(), x.tobytes(), q.tobytes(), s.tobytes(), e.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], ["tile", *_TILE_COLUMNS])

    packed = materialise(classes.select("cid", "n", "v").mapInArrow(run, _TILE_SCHEMA), "tiles").withColumn("tile", F.monotonically_increasing_id())
    number = packed.select("tile").withColumn("no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tile")).cast("long") - 1)
    return packed.join(number, "tile").drop("tile")


_FOUND_SCHEMA = "a long, b long, links long"


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    worker_state("vectors")
    forest = _Forest()
    for batch in batches:
        for r in range(batch.num_rows):
            row = dict(zip(batch.schema.names, (c[r].as_py() for c in batch.columns), strict=True))

            def side(p: str, row=row):
                cid, n = np.frombuffer(row[p + "cids"], np.int64), np.frombuffer(row[p + "counts"], np.int64)
                x, q = np.frombuffer(row[p + "vectors"], dtype), np.frombuffer(row[p + "codes"], np.int8)
                return cid, n, x.reshape(len(cid), -1), q.reshape(len(cid), -1), np.frombuffer(row[p + "scales"]), np.frombuffer(row[p + "errors"])

            ca, na, xa, qa, sa, ea = side("l_")
            cb, nb, xb, qb, sb, eb = side("r_")
            if xa.shape[1] != xb.shape[1]:
                continue
            rows, edges = _Rows(forest, np.concatenate([ca, cb])), []
            of_a, of_b = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
            for at in range(0, len(ca), STRIP):
                part = slice(at, at + STRIP)
                i, j, sure = possible(qa[part], sa[part], ea[part], qb, sb, eb, threshold)
                i += at
                if row["i"] == row["j"]:
                    once = i < j
                    i, j, sure = i[once], j[once], sure[once]
                doubt = np.flatnonzero(~sure)
                sure[doubt] = cosines(xa, xb, i[doubt], j[doubt]) >= threshold
                i, j = i[sure], j[sure]
                of_a += np.bincount(i, weights=nb[j], minlength=len(ca)).astype(np.int64)
                of_b += np.bincount(j, weights=na[i], minlength=len(cb)).astype(np.int64)
                edges += rows.join(i, len(ca) + j)
            a, b = np.flatnonzero(of_a), np.flatnonzero(of_b)
            e, m = len(edges), len(a) + len(b)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*[x for x, _ in edges], *ca[a].tolist(), *cb[b].tolist()], pa.int64()),
                    pa.array([y for _, y in edges] + [None] * m, pa.int64()),
                    pa.array([None] * e + [*of_a[a].tolist(), *of_b[b].tolist()], pa.int64()),
                ],
                ["a", "b", "links"],
            )


def class_links(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``a, b`` (links that carry the components) and ``a, links`` (vectors of other classes that class ``a`` links with)."""
    dtype = "f4" if classes.schema["v"].dataType.elementType.typeName() == "float" else "f8"
    tiles = materialise(make_tiles(classes, tile), "numbered")
    n = tiles.agg(F.count(F.lit(1))).first()[0]
    # Each pair once, every tile about as often on either side; only the left one travels with the pair.
    other = F.explode(F.sequence(F.col("no"), F.lit(max(0, n - 1)))).alias("other")
    turned = (F.col("no") + F.col("other")) % 2 == 1
    pairs = tiles.select("no", other).select(F.when(turned, F.col("other")).otherwise(F.col("no")).alias("i"), F.when(turned, F.col("no")).otherwise(F.col("other")).alias("j"))
    left = tiles.select(F.col("no").alias("i"), *[F.col(c).alias("l_" + c) for c in _TILE_COLUMNS])
    right = tiles.select(F.col("no").alias("j"), *[F.col(c).alias("r_" + c) for c in _TILE_COLUMNS])
    met = pairs.join(left, "i").join(right, "j")
    return met.mapInArrow(lambda it: _compare(it, threshold, dtype), _FOUND_SCHEMA)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``)."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("embedding")), F.col("embedding")).alias("v"))
    grouped = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialise(grouped, "classes").withColumn("cid", F.monotonically_increasing_id())
    classes = materialise(classes, "numbered_classes")
    found = materialise(class_links(classes, threshold, tile), "found")
    others = found.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))
    comp = components(found.where("b is not null"))
    ids = comp.join(classes.select("cid", "rep"), F.col("node") == F.col("cid")).select("cid", "component", "rep")
    least = ids.groupBy("component").agg(F.min("rep").alias("least"))
    named = ids.join(least, "component").select("cid", "least")
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("v"), "v").alias("h2")]
    label = (
        classes.select("cid", "rep", "n", *hashes)
        .join(others, "cid", "left")
        .join(named, "cid", "left")
        .select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("_links"), F.coalesce("least", "rep").alias("_component"))
    )
    label = materialise(label, "label", narrow=True)
    keyed = rows.select("vec_id", F.col("v").isNotNull().alias("_some"), *hashes)
    most = max(HOT, (classes.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(label.where(F.col("n") > most).drop("n"))
    cold = label.where(F.col("n") <= most).drop("n")
    some = keyed.where("_some").drop("_some")
    met = some.join(hot, ["h1", "h2"]).unionByName(some.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]))
    none = keyed.where("not _some").select("vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_component"))
    out = met.select("vec_id", "_links", "_component").unionByName(none).select(
        "vec_id", F.col("_links").cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM link WHERE link.a = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
