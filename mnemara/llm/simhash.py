"""SimHash near-duplicates found by Golay-code keys.

Fingerprints: majority of the bits of XXH64 (seed 42) over all 4-word shingles of the ASCII-lower-cased text.
Links: fingerprints that differ in at most 4 bits, found exactly:

* Equal fingerprints are one node (a grouped minimum), so copies never meet as pairs.
* A fingerprint is cut into segments of 22, 21 and 21 bits. Of 4 errors over three segments, at least two segments
  hold no more than 2 each, and a Golay hash of such a segment keeps a common index. The keys are all index pairs of
  two segments: about 85 a fingerprint, and every link shares at least one.
* Keys are shuffled and sorted; runs of one key are compared and verified by Hamming distance. A task knows which
  fingerprints it has joined: only rows of different groups are compared, and only links that join two groups are passed
  on, at most one less than its fingerprints. So dense groups neither become pairs nor cost their square. A run longer than
  a block is joined by pivots, sorted by group and written as blocks; pairs of blocks that aren't of one group are compared
  in a second shuffle, so a hot key is spread over tasks.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts under four words
are one shingle; rows repeated with one id are one document to ``component_id``; null ids never name a component unless
it has no other; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm import golay
from mnemara.llm.common import materialise, rows_of, ship, table, without_rows, worker_state
from mnemara.llm.graph import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCK = 2048
GATHER = 200_000
SLICE = 4096
PIVOTS = 64
STRIP = 128
HOT = 1000
#: Segments of a fingerprint as (shift, bits).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    stops = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), stops, strict=True))
    for at in range(0, n, _WORDS_AT_ONCE):
        part = spans[at : at + _WORDS_AT_ONCE]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), ">u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, digests: bool = False) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) and, if asked for, ``text_hash``, one row a row of ``docs``."""
    more = ["text_hash"] if digests else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("fingerprints")
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *[b.column(2) for _ in more]], ["doc_id", "fp", *more])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias(c) for c in more])
    return rows.mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{c} long" for c in more]]))


def _golay_key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(whole), 4096):
            fp = whole[at : at + 4096]
            u = fp.view(np.uint64)
            idx = [golay.indices((u >> np.uint64(s)) & np.uint64((1 << n) - 1)) for s, n in SEGMENTS]
            for kind, (x, y) in enumerate(PAIRS):
                both = (idx[x][:, :, None] << 12) | idx[y][:, None, :]
                good = (idx[x][:, :, None] >= 0) & (idx[y][:, None, :] >= 0)
                rows = np.broadcast_to(fp[:, None, None], good.shape)[good]
                yield pa.RecordBatch.from_arrays([pa.array(both[good] | (kind << 24)), pa.array(rows)], ["key", "fp"])


def golay_keys(fps: DataFrame) -> DataFrame:
    """``key, fp``: all index pairs of two segments for each fingerprint."""
    return fps.select("fp").mapInArrow(_golay_key_batches, "key long, fp long")


class _Forest:
    """Groups of joined numbers; an unknown number is its own group."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = x = p.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        """Join the groups of two numbers; False if they are one already."""
        rx, ry = self.root(x), self.root(y)
        if rx != ry:
            self.parent[rx] = ry
        return rx != ry

    def labels(self, values: np.ndarray) -> np.ndarray:
        """The root of each value."""
        if not self.parent:
            return values
        root = self.root
        return np.fromiter((root(x) for x in values.tolist()), values.dtype, len(values))


class _Rows:
    """Rows of a task with the labels of their groups, which follow as links join groups of the task's forest."""

    def __init__(self, forest: _Forest, fp: np.ndarray) -> None:
        nodes, self.node = np.unique(fp, return_inverse=True)
        _, self.group = np.unique(forest.labels(nodes), return_inverse=True)
        self.forest, self.fp = forest, fp
        self.label = self.group[self.node]

    def join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """The links among pairs of near rows that join two groups; the pairs of joined groups go unseen."""
        edges = []
        while len(left):
            apart = self.label[left] != self.label[right]
            left, right = left[apart], right[apart]
            up = np.arange(self.group.max() + 1)
            for i, j in zip(left[:SLICE].tolist(), right[:SLICE].tolist(), strict=True):
                x, y = int(self.fp[i]), int(self.fp[j])
                if self.forest.join(x, y):
                    edges.append((x, y))
                    a, b = self.label[i], self.label[j]
                    while up[a] != a:
                        a = up[a]
                    while up[b] != b:
                        b = up[b]
                    up[max(a, b)] = min(a, b)
            while (up != (above := up[up])).any():
                up = above
            self.group = up[self.group]
            self.label = self.group[self.node]
            left, right = left[SLICE:], right[SLICE:]
        return edges


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(start, append=len(key))


def _join_runs(forest: _Forest, key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Links within runs of equal keys (sorted) that join groups; a run whose rows are one group isn't compared further."""
    _, length = _runs(key)
    some = np.repeat(length > 1, length)
    key, fp = key[some], fp[some]
    if not len(key):
        return []
    start, length = _runs(key)
    end, rows, edges = np.repeat(start + length, length), _Rows(forest, fp), []
    at, step = np.arange(len(key)), 1
    while len(at := at[at + step < end[at]]):
        pair = at[rows.label[at] != rows.label[at + step]]
        hit = pair[_near(fp[pair], fp[pair + step])]
        edges += rows.join(hit, hit + step)
        if step & (step - 1) == 0:
            apart = np.minimum.reduceat(rows.label, start) != np.maximum.reduceat(rows.label, start)
            at = at[np.repeat(apart, length)[at]]
        step += 1
    return edges


_LINK_SCHEMA = "a long, b long, key long, place int, root long, block binary"


def _edges_batch(edges: list[tuple[int, int]], blocks: list[tuple[int, int, int | None, bytes]] = ()) -> pa.RecordBatch:
    e, kinds = len(edges), (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array([x[c] for x in edges] + [None] * len(blocks), pa.int64()) for c in (0, 1)],
            *[pa.array([None] * e + [x[c] for x in blocks], kind) for c, kind in enumerate(kinds)],
        ],
        ["a", "b", "key", "place", "root", "block"],
    )


class _LongRun:
    """A run longer than a block: what stands near in it is joined as far as blocks go, then it is cut by groups into blocks."""

    def __init__(self, key: int) -> None:
        self.key, self.place, self.pivots = key, 0, np.zeros(0, np.int64)

    def take(self, forest: _Forest, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = _join_runs(forest, np.arange(len(fp)) // BLOCK, fp)
        # Pivots of the largest groups, also of those before, join what one block could not see.
        both = np.concatenate([self.pivots, fp])
        rows = _Rows(forest, both)
        groups, first, size = np.unique(rows.label, return_index=True, return_counts=True)
        for p in first[np.argsort(-size, kind="stable")[:PIVOTS]].tolist():
            hit = np.flatnonzero(rows.label != rows.label[p])
            hit = hit[_near(both[hit], both[p])]
            edges += rows.join(np.full(len(hit), p), hit)
        _, first, size = np.unique(rows.label, return_index=True, return_counts=True)
        self.pivots = both[first[np.argsort(-size, kind="stable")[:PIVOTS]]]
        label = rows.label[len(both) - len(fp) :]
        order, blocks = np.argsort(label, kind="stable"), []
        for at in range(0, len(fp), BLOCK):
            part = order[at : at + BLOCK]
            root = forest.root(int(fp[part[0]])) if label[part[0]] == label[part[-1]] else None
            blocks.append((self.key, self.place, root, fp[part].tobytes()))
            self.place += 1
        yield _edges_batch(edges, blocks)


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key, and the blocks of runs that are longer than one block."""
    forest, key, fp, gathered = _Forest(), [], [], 0
    going: _LongRun | None = None  # a long run whose first part has gone out

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal key, fp, gathered, going
        k, f = np.concatenate(key), np.concatenate(fp)
        start, length = _runs(k)
        whole = len(start) if last else len(start) - 1  # the last run may go on
        long = length > BLOCK
        if going is not None and len(k) and k[0] == going.key:
            long[0] = True
        short = np.repeat(~long & (np.arange(len(start)) < whole), length)
        yield _edges_batch(_join_runs(forest, k[short], f[short]))
        for i in np.flatnonzero(long).tolist():
            if i >= whole and length[i] <= BLOCK:
                continue  # too little of a run that goes on
            if going is None or going.key != k[start[i]]:
                going = _LongRun(int(k[start[i]]))
            yield from going.take(forest, f[start[i] : start[i] + length[i]])
        rest = start[-1] if not last and len(start) and length[-1] <= BLOCK else len(k)
        key, fp, gathered = [k[rest:]], [f[rest:]], len(k) - rest

    for b in batches:
        key.append(b.column(0).to_numpy(zero_copy_only=False))
        fp.append(b.column(1).to_numpy(zero_copy_only=False))
        gathered += b.num_rows
        if gathered >= GATHER:
            yield from settle(False)
    if gathered:
        yield from settle(True)


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of each row (within one, if they are the same) that join groups."""
    forest = _Forest()
    for b in batches:
        for x, y in zip(b.column(0), b.column(1), strict=True):
            left, right = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
            rows, edges, n = _Rows(forest, np.concatenate([left, right])), [], len(left)
            for at in range(0, n, STRIP):
                part = rows.label[at : min(n, at + STRIP)]
                if rows.label.min() == rows.label.max():
                    break
                far = n + np.flatnonzero((part[:, None] != rows.label[n:]).any(axis=0))
                i, j = np.nonzero(_near(left[at : at + STRIP, None], right[far - n]))
                edges += rows.join(i + at, far[j])
            yield _edges_batch(edges).select(["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between different fingerprints whose closure is that of all pairs within ``MAX_BITS``."""
    ship(fps.sparkSession)
    keyed = golay_keys(fps).repartition("key").sortWithinPartitions("key")
    found = materialise(keyed.mapInArrow(_link_runs, _LINK_SCHEMA), "links")
    blocks = found.where("block is not null")
    # Which blocks of a key must meet is settled without their rows; blocks of one and the same group need not.
    head = blocks.select("key", "place", "root")
    apart = "place <= other and not (root is not null and root <=> other_root)"
    pairs = head.join(head.select("key", F.col("place").alias("other"), F.col("root").alias("other_root")), "key").where(apart).select("key", "place", "other")
    crossed = (
        pairs.join(blocks.select("key", "place", "block"), ["key", "place"])
        .join(blocks.select("key", F.col("place").alias("other"), F.col("block").alias("right")), ["key", "other"])
        .repartition("key", "place", "other")
        .select("block", "right")
        .mapInArrow(_link_blocks, "a long, b long")
    )
    return found.where("a is not null").select("a", "b").unionByName(crossed)


def _with_least(prints: DataFrame, row: Column) -> DataFrame:
    """``prints`` with ``component_id``, the least ``row`` of each one's component."""
    nodes = prints.groupBy("fp").agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("n"))
    linked = components(links(nodes)).join(nodes, F.col("node") == F.col("fp"))
    smallest = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = materialise(linked.join(smallest, "component").select(F.col("fp").alias("_fp"), "least"), "named", narrow=True)
    label = nodes.join(named, F.col("fp") == F.col("_fp"), "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id"))
    # At most HOT fingerprints have more than 1 / HOT of all rows; their labels are broadcast, so no copy group meets in one task.
    most = max(HOT, rows_of(prints) // HOT)
    hot = F.broadcast(label.where(F.col("n") > most).select("fp", "component_id"))
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(label.where(F.col("n") <= most).drop("n"), "fp")
    return prints.join(hot, "fp").unionByName(rest).select(*prints.columns, "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    return _with_least(materialise(fingerprints(docs), "prints"), F.col("doc_id"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Documents less those that another one of their group stands for: one row a group, that of the least id and text.

    A row is known by its id and its text, so rows that share an id, or have none, are decided each by its own group.
    """
    prints = materialise(fingerprints(docs, digests=True), "prints")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    groups = materialise(_with_least(prints, least).withColumn("stays", least == F.col("component_id")), "groups", narrow=True)
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = without_rows(d, groups.where("not stays"), ["doc_id", "text_hash"])
    repeated = groups.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if repeated:  # rows alike in id and text: that of the least hash stays
        first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(F.to_json("doc"))))
        kept = kept.withColumn("no", first).where("no = 1")
    return kept.select("doc.*")
