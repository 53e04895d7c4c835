"""Benchmark decontamination by a prefix-filtered set join of item windows and documents.

A record is a window of ``words`` consecutive words of an item, or the whole of a shorter item. Its tokens are shingles of
up to ``SHINGLE`` words, ordered by rarity: their occurrences in all documents are counted first. If at least a share ``t`` of a
record's n shingles lies in a document window of the record's size, one of the n - ceil(t n) + 1 rarest does (its prefix), so
records meet documents by prefix shingles only. What meets is bounded by position (the shingle's place in the record says
where the window can begin) and by length (the window lies within the document), and is then verified: word by word for
t = 1, by its set of shingles for less.

Distinct pairs of record and item are dealt into blocks of ``MAX_RECORDS`` and ``MAX_BYTES`` at most. A block's index is broadcast
and meets every document in its task, so no text is shuffled; several blocks are merged by document. Documents hold the shingles' words as
numbers of the block's own vocabulary, so all that isn't the splitting of a text is array work.

Edge cases: null and empty texts have no words and no windows; an item without an id marks words as hit but is not listed; items of one id
are one item; repeated document rows have the same result each; a very long text is split piece by piece; other
columns, whatever their names, aren't looked at; an empty table gives an empty one, no items leave every document clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.llm.common import materialise, ship, table, worker_state

WORDS = 10
SHINGLE = 3
MAX_RECORDS = 200_000
MAX_BYTES = 32 << 20
PIECE = 1 << 20
AT_ONCE = 1 << 16

_END = b"A"  # no word has a capital
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def records_of(items: DataFrame, words: int = WORDS) -> DataFrame:
    """``record, item``: the different windows of every item, words joined by a space, with the item's id as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records, names = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = split_words(text.as_py() or "")
                for at in range(max(0, len(w) - words) + 1 if w else 0):
                    records.append(b" ".join(w[at : at + words]).decode())
                    names.append(name)
                    if len(records) >= AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(names, pa.string())], ["record", "item"])
                        records, names = [], []
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(names, pa.string())], ["record", "item"])

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "record string, item string").distinct()


def keys_of(ids: np.ndarray, size: int, base: int) -> np.ndarray:
    """The shingles of ``size`` words at every place of ``ids``; negative where a word is unknown or a text ends."""
    key, good = ids[: len(ids) - size + 1].astype(np.int64), ids[: len(ids) - size + 1] >= 0
    for k in range(1, size):
        part = ids[k : len(ids) - size + 1 + k]
        key, good = key * base + part, good & (part >= 0)
    return np.where(good, key, -1)


def texts_as_ids(column: pa.Array, vocabulary: dict[bytes, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first row, rows, ids)`` of groups of texts: words in the vocabulary as numbers, others as -1, -2 after each text."""
    column = column.fill_null("") if column.null_count else column
    get = {**vocabulary, _END: -2}.get
    size = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    start = size[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    row = 0
    while row < len(column):
        last = row + 1
        while last < len(column) and start[last + 1] - start[row] <= PIECE:
            last += 1
        whole = bytes(data[start[row] : start[last]]).translate(_FOLD)
        off = start[row]
        joined = b" A ".join([whole[start[i] - off : start[i + 1] - off] for i in range(row, last)]) + b" A"
        at, ids = 0, []
        while at < len(joined):
            end = joined.find(b" ", at + 4 * PIECE)
            end = len(joined) if end < 0 else end
            words = joined[at:end].split()
            ids.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
            at = end
        yield row, last - row, np.concatenate(ids)
        row = last


@dataclass
class Records:
    """Distinct records of a block as numbers of its vocabulary, and the items of each."""

    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    items: list[list[str]]
    names: int = 0
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # by size: the different shingles, rising

    @classmethod
    def build(cls, pairs: list[tuple[str, str | None]]) -> Records:
        by_record: dict[str, list[str]] = {}
        for record, item in pairs:
            by_record.setdefault(record, []).extend([item] if item is not None else [])
        vocabulary: dict[bytes, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in r.encode().split()], np.int32) for r in by_record]
        out = cls(vocabulary, words, list(by_record.values()))
        for size in sorted({min(SHINGLE, len(w)) for w in words}):
            found = [out.keys(w) for w in words if min(SHINGLE, len(w)) == size]
            out.shingles[size] = np.unique(np.concatenate(found))
        return out

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1

    def keys(self, words: np.ndarray) -> np.ndarray:
        return keys_of(words, min(SHINGLE, len(words)), self.base)


def count_shingles(docs: DataFrame, records: Records) -> dict[int, np.ndarray]:
    """Occurrences in all documents of a block's shingles, by size in the order of ``records.shingles``; a task adds up its own."""
    shared = docs.sparkSession.sparkContext.broadcast(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("decontam")
        r = shared.value
        seen = {size: np.zeros(len(k), np.int64) for size, k in r.shingles.items()}
        for b in batches:
            for _, _, ids in texts_as_ids(b.column(0), r.vocabulary):
                for size, known in r.shingles.items():
                    keys = keys_of(ids, size, r.base)
                    keys = keys[keys >= 0]
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    seen[size] += np.bincount(at[known[at] == keys], minlength=len(known))
        for size, n in seen.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(some), pa.array(n[some])], ["size", "at", "n"])

    counts = {size: np.zeros(len(k), np.int64) for size, k in records.shingles.items()}
    rows = docs.select("text").mapInArrow(run, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most the block's shingles
        counts[r["size"]][r["at"]] = r["n"]
    return counts


@dataclass
class PrefixIndex:
    """By shingle size: prefix shingles, rising, with the record and the place in it of each."""

    records: Records
    containment: float
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, records: Records, counts: dict[int, np.ndarray], containment: float) -> PrefixIndex:
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r, words in enumerate(records.words):
            keys, size = records.keys(words), min(SHINGLE, len(words))
            n = counts[size][np.searchsorted(records.shingles[size], keys)]
            first: dict[int, int] = {}
            for at in np.lexsort((keys, n)).tolist():  # the rarest first; of equal ones the first place
                first.setdefault(int(keys[at]), at)
            need = math.ceil(containment * len(first) - 1e-9)
            for key, at in list(first.items())[: len(first) - max(1, need) + 1]:
                found.setdefault(size, []).append((key, r, at))
        out = {}
        for size, entries in found.items():
            entries.sort()
            out[size] = tuple(np.array(c, np.int64) for c in zip(*entries, strict=True))
        return cls(records, containment, out)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, record)`` of every document window that holds a record."""
        places, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (keys, record, offset) in self.prefixes.items():
            there = keys_of(ids, size, self.records.base)
            low, high = np.searchsorted(keys, there, "left"), np.searchsorted(keys, there, "right")
            some = np.flatnonzero((there >= 0) & (high > low))
            for at in range(0, len(some), AT_ONCE):  # what meets is expanded piece by piece
                s = some[at : at + AT_ONCE]
                n = high[s] - low[s]
                p = np.repeat(s, n)
                e = np.repeat(low[s], n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
                verify = self.exact if self.containment >= 1 else self.partly
                x, y = verify(ids, p, record[e], offset[e])
                places.append(x)
                hits.append(y)
        return np.concatenate(places), np.concatenate(hits)

    def exact(self, ids: np.ndarray, p: np.ndarray, record: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The record's words themselves, at the one place where its shingle can stand."""
        lengths = np.array([len(w) for w in self.records.words])[record] if len(record) else record
        start, good = p - offset, np.zeros(len(p), bool)
        for m in np.unique(lengths):
            c = np.flatnonzero((lengths == m) & (start >= 0) & (start + m <= len(ids)))
            for at in range(0, len(c), AT_ONCE):
                part = c[at : at + AT_ONCE]
                wanted = np.array([self.records.words[r] for r in record[part]])
                good[part] = (ids[start[part][:, None] + np.arange(m)] == wanted).all(axis=1)
        return start[good], record[good]

    def partly(self, ids: np.ndarray, p: np.ndarray, record: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the record's size around the shingle that hold enough of its shingles."""
        found = set()
        for at, r in zip(p.tolist(), record.tolist(), strict=True):
            words = self.records.words[r]
            m, size = len(words), min(SHINGLE, len(words))
            wanted = set(self.records.keys(words).tolist())
            low, high = max(0, at - (m - size)), min(len(ids), at + m)
            near = keys_of(ids[low:high], size, self.records.base).tolist()
            for start in range(low, min(at, high - m) + 1):
                if -2 in ids[start : start + m]:
                    continue
                have = wanted & set(near[start - low : start - low + m - size + 1])
                if len(have) >= self.containment * len(wanted) - 1e-9:
                    found.add((start, r))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _scan(docs: DataFrame, keep: list[str], index: PrefixIndex | None) -> DataFrame:
    """The columns ``keep`` of every document, its number of words, the spans of hit words (merged, rising) and the items found."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    nothing = PrefixIndex(Records({}, [], []), 1.0, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("decontam")
        index = shared.value or nothing
        length = np.array([len(w) for w in index.records.words], np.int64)
        for b in batches:
            n_words, spans, items = [], [], []
            for _, rows, ids in texts_as_ids(b.column(len(keep)), index.records.vocabulary):
                ends = np.flatnonzero(ids == -2)
                begins = np.concatenate([[0], ends[:-1] + 1])
                n_words += (ends - begins).tolist()
                own: list[list] = [[] for _ in range(rows)]
                names: list[set] = [set() for _ in range(rows)]
                place, record = index.find(ids)
                if len(place):
                    change = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(change, place, 1)
                    np.add.at(change, place + length[record], -1)
                    hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                    edge = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
                    for (a, z), d in zip(edge.tolist(), np.searchsorted(ends, edge[:, 0]).tolist(), strict=True):
                        own[d].append({"start": a - int(begins[d]), "end": z - int(begins[d])})
                    for d, r in np.unique(np.stack([np.searchsorted(ends, place), record], axis=1), axis=0).tolist():
                        names[d].update(index.records.items[r])
                spans += own
                items += [sorted(x) for x in names]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [*[b.column(i) for i in range(len(keep))], pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "spans", "items"])

    kept = docs.select(*keep, "text")
    schema = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keep)
    return kept.mapInArrow(run, f"{schema}, {_FOUND}")


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans as one."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def add(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last.isNotNull() & (s["start"] <= last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, add)


def find(docs: DataFrame, items: DataFrame, words: int = WORDS, containment: float = 1.0, max_records: int = MAX_RECORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row of ``docs`` (``doc_id, text``): words inside windows that hold a record of
    ``items`` (``item_id, text``), and the ids of these items, sorted as strings."""
    ship(docs.sparkSession)
    records = materialise(records_of(items, words), "records")
    total = records.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("record")).alias("bytes")).first()
    blocks = max(1, math.ceil(total["n"] / max_records), math.ceil((total["bytes"] or 0) / max_bytes))

    def block(k: int) -> PrefixIndex:
        own = records.where(F.pmod(F.xxhash64("record", "item"), F.lit(blocks)) == k)
        r = Records.build([(x["record"], x["item"]) for x in own.collect()])
        return PrefixIndex.build(r, count_shingles(docs, r), containment)

    if not total["n"]:
        return _scan(docs, ["doc_id"], None)
    if blocks == 1:
        return _scan(docs, ["doc_id"], block(0))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit("text"), "text").alias("_h2"), "text")
    keys = ["doc_id", "_h1", "_h2"]
    parts = [materialise(_scan(keyed, keys, block(k)).where(F.size("spans") > 0).dropDuplicates(keys), "hits") for k in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    merged = found.groupBy(*keys).agg(_merged(F.flatten(F.collect_list("spans"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    out = _scan(keyed, keys, None).alias("a").join(merged.alias("b"), same, "left")
    return out.select("a.doc_id", "a.n_words", F.coalesce("_spans", "spans").alias("spans"), F.coalesce("_items", "items").alias("items"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents
), b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark
), b1 AS (SELECT item_id, w, least(len(w), {WORDS}) AS m, unnest(range(1, greatest(len(w) - {WORDS}, 0) + 2)) AS i FROM b WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM b1
), g AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN (SELECT DISTINCT m FROM win) l ON len(w) >= m)
), hit AS (SELECT DISTINCT r, i, m, item_id FROM g JOIN win USING (m, gram)
), n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r
), t AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
