"""Phrase collocations from weighted acyclic automata.

Texts are encoded once as shards: the sorted words of some million occurrences of one language, and their places in this
list. A shard's n-grams, sorted, are added one after another to an automaton: a state is opened where an n-gram parts from the
one before, so common beginnings are shared, and the last arc carries the count (``Automaton``: arrays of arcs by depth).
Automata are cut at the bounds of prefix ranges, which are quantiles of n-grams from all shards, and those of one range and language
are united, weights summed. n-grams of one more word are counted only where both parts of one word less are frequent enough; this is
looked up in a bitmap of fixed size over hashes, which can let n-grams pass that are then counted in vain, but loses none.

Parts of candidates are composed with the automaton of their range: all queries of a group walk through it at once, depth by
depth. A range with many queries is dealt over several tasks, so a word that begins or ends a third of all phrases is
no hot key. Only one-longer phrases are needed to see whether a candidate lies within a longer one: if a longer one has enough
occurrences, so has every phrase between.

What reaches the driver has a fixed bound: bounds of ranges (from ``SAMPLE`` n-grams, which affect balance only), bitmaps
(``MAX_BITS``), one number a range and one a language and batch.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count each time; a very long text is encoded
piece by piece; languages without candidates give no rows; other columns, whatever their names, aren't looked at; an empty
table gives an empty one. Scores are exact integers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import ARROW_ROWS, materialise, ship, table, worker_state

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
ABSORBED = 80  # percent
SHARD = 1 << 20  # word occurrences
PIECE = 1 << 20  # bytes
UNITE = 1 << 20  # n-grams held before they are united
MAX_BITS = 1 << 26
SAMPLE = 1 << 13
MARKS = 64  # n-grams a shard gives to the sample
QUERIES = 200_000  # a task of the composition
RANGE = 1 << 22  # word occurrences a range at most, about

_END = b"A"  # no word has a capital
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 32) else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


# Automata ------------------------------------------------------------------------------------------------------------


def _keys(columns: list[np.ndarray], base: int) -> np.ndarray:
    """Numbers in the order of the rows: equal for equal rows."""
    if len(columns) == 1:
        return columns[0].astype(np.int64)
    if len(columns) == 2:
        return columns[0].astype(np.int64) * base + columns[1]
    pair = columns[0].astype(np.int64) * base + columns[1]
    if len(columns) == 3:
        return np.unique(pair, return_inverse=True)[1].astype(np.int64) * base + columns[2]
    u, at = np.unique(np.concatenate([pair, columns[2].astype(np.int64) * base + columns[3]]), return_inverse=True)
    return at[: len(pair)].astype(np.int64) * len(u) + at[len(pair) :]


def summed(columns: list[np.ndarray], base: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, and the sum of their weights (without weights: their number)."""
    if not len(columns[0]):
        return np.zeros((0, len(columns)), np.int32), np.zeros(0, np.int64)
    keys = _keys(columns, base)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    rows = np.stack([c[order[first]] for c in columns], axis=1).astype(np.int32)
    sums = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights[order], first)
    return rows, sums.astype(np.int64)


@dataclass
class Automaton:
    """Weighted acyclic automaton of n-grams of one length: by depth, arcs in the order of the states they leave, and how many
    leave each state; the last arcs carry counts and all lead to the one final state."""

    words: list[bytes]  # rising
    labels: list[np.ndarray]
    leaving: list[np.ndarray]
    weights: np.ndarray

    @classmethod
    def from_sorted(cls, rows: np.ndarray, weights: np.ndarray, words: list[bytes]) -> Automaton:
        """From n-grams in order; words that none of them has are left out."""
        used = np.unique(rows)
        rows = np.searchsorted(used, rows)
        labels, leaving, state = [], [], np.zeros(len(rows), np.int64)
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for depth in range(rows.shape[1]):
            new[1:] |= rows[1:, depth] != rows[:-1, depth]  # a state is opened where an n-gram parts from the one before
            arcs = np.flatnonzero(new)
            labels.append(rows[arcs, depth].astype(np.int32))
            leaving.append(np.bincount(state[arcs], minlength=1 if not depth else len(labels[-2])).astype(np.int32))
            state = np.cumsum(new) - 1
        return cls([words[i] for i in used.tolist()], labels, leaving, weights)

    def rows(self) -> np.ndarray:
        depth = len(self.labels)
        out = np.empty((len(self.weights), depth), np.int32)
        at = np.arange(len(self.weights))
        for d in range(depth - 1, -1, -1):
            out[:, d] = self.labels[d][at]
            at = np.repeat(np.arange(len(self.leaving[d])), self.leaving[d])[at]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.labels), len(self.words), *map(len, self.labels)], np.int64)
        words = b"\n".join(self.words)
        arrays = [np.array([len(words)], np.int64).tobytes(), words, *[x.tobytes() for x in self.labels], *[x.tobytes() for x in self.leaving[1:]], self.weights.tobytes()]
        return head.tobytes() + b"".join(arrays)

    @classmethod
    def unpack(cls, blob: bytes) -> Automaton:
        depth = int(np.frombuffer(blob, np.int64, 1)[0])
        head = np.frombuffer(blob, np.int64, depth + 3)
        sizes, at = head[2 : 2 + depth].tolist(), 8 * (depth + 3)
        words = blob[at : at + int(head[-1])].split(b"\n") if head[1] else []
        at += int(head[-1])
        labels, leaving = [], [np.array([sizes[0]], np.int32)]
        for n in sizes:
            labels.append(np.frombuffer(blob, np.int32, n, at))
            at += 4 * n
        for n in sizes[:-1]:
            leaving.append(np.frombuffer(blob, np.int32, n, at))
            at += 4 * n
        return cls(words, labels, leaving, np.frombuffer(blob, np.int64, sizes[-1], at))

    @classmethod
    def union(cls, parts: list[Automaton]) -> Automaton:
        words = sorted(set().union(*(p.words for p in parts)))
        place = {w: i for i, w in enumerate(words)}
        moved = [np.array([place[w] for w in p.words], np.int32)[p.rows()] for p in parts]
        rows = np.concatenate(moved)
        return cls.from_sorted(*summed(list(rows.T), len(words) + 1, np.concatenate([p.weights for p in parts])), words)

    def at_least(self, least: int) -> Automaton:
        keep = self.weights >= least
        return Automaton.from_sorted(self.rows()[keep], self.weights[keep], self.words)

    def cut(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Automaton]]:
        """The parts between bounds that aren't empty, with their numbers: n-grams below ``bounds[0]``, those from it on, ..."""
        rows, last = self.rows(), 0
        spell = lambda r: tuple(self.words[i] for i in r)
        ends = [bisect_left(rows, b, key=spell) for b in bounds] + [len(rows)]
        for i, end in enumerate(ends):
            if end > last:
                yield i, Automaton.from_sorted(rows[last:end], self.weights[last:end], self.words)
                last = end

    def find(self, queries: list[list[bytes]]) -> np.ndarray:
        """The weights of n-grams: all queries walk from state to state together. 0 where an arc is missing."""
        place, base = {w: i for i, w in enumerate(self.words)}, len(self.words) + 1
        state = np.zeros(len(queries), np.int64)
        for d, labels in enumerate(self.labels):
            leaves = np.repeat(np.arange(len(self.leaving[d])), self.leaving[d]) * base + labels  # rising
            wanted = state * base + np.array([place.get(q[d], base - 1) for q in queries], np.int64)
            wanted[state < 0] = -1
            at = np.minimum(np.searchsorted(leaves, wanted), max(0, len(leaves) - 1))
            state = np.where(leaves[at] == wanted, at, -1) if len(leaves) else np.full(len(queries), -1)
        return np.where(state >= 0, self.weights[state], 0) if len(self.weights) else np.zeros(len(queries), np.int64)


# Shards --------------------------------------------------------------------------------------------------------------

_SHARD = "lang string, words binary, ids binary, n long, marks array<string>"


def shards_of(docs: DataFrame) -> DataFrame:
    """Rows of a language's words, sorted, and the places of all occurrences in this list (-1: a piece of text ends)."""

    def flush(lang: str, vocabulary: dict[bytes, int], parts: list[np.ndarray]) -> pa.RecordBatch:
        words = sorted(w for w in vocabulary if w != _END)
        rank = np.empty(len(vocabulary), np.int32)
        rank[[vocabulary[w] for w in words]] = np.arange(len(words), dtype=np.int32)
        rank[vocabulary[_END]] = -1
        ids = rank[np.concatenate(parts)]
        some = np.flatnonzero(ids >= 0)
        marks = []
        for at in some[:: max(1, len(some) // MARKS)].tolist():
            run = ids[at : at + LONGEST].tolist()
            marks.append(b" ".join(words[i] for i in (run[: run.index(-1)] if -1 in run else run)).decode())
        row = [[lang], [b"\n".join(words)], [ids.tobytes()], [len(some)], [marks]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string())), strict=True)], ["lang", "words", "ids", "n", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("colloc")
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        size: dict[str, int] = {}
        for b in batches:
            text = b.column(1).fill_null("")
            at = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset :]
            data = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(b.column(0).to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                group, length = [], 0
                for i in [*rows, None]:
                    if i is not None:
                        group.append(data[at[i] : at[i + 1]])
                        length += len(group[-1])
                    if not group or i is not None and length < PIECE:
                        continue
                    if lang not in held:
                        numbered: dict[bytes, int] = defaultdict(count().__next__)
                        held[lang], size[lang] = (numbered, []), numbered[_END]
                    vocabulary, parts = held[lang]
                    joined = (b"\n".join(group).translate(_FOLD) + b"\n").replace(b"\n", b" A ")
                    group, length, start = [], 0, 0
                    while start < len(joined):
                        end = joined.find(b" ", start + 4 * PIECE)
                        end = len(joined) if end < 0 else end
                        words = joined[start:end].split()
                        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                        size[lang] += len(words)
                        start = end
                    if size[lang] >= SHARD:
                        yield flush(lang, *held.pop(lang))
                        del size[lang]
                    elif sum(size.values()) >= 4 * SHARD:  # many languages
                        most = max(size, key=size.get)
                        yield flush(most, *held.pop(most))
                        del size[most]
        for lang, own in held.items():
            yield flush(lang, *own)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _SHARD)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(lang: str, columns: list[np.ndarray]) -> np.ndarray:
    """A hash of n-grams from the hashes of their words."""
    h = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _row_hashes(lang: str, automaton: Automaton) -> np.ndarray:
    words = _hashes(automaton.words)
    return _mixed(lang, [words[c] for c in automaton.rows().T])


def shard_ngrams(lang: str, words: list[bytes], ids: np.ndarray, k: int, frequent: np.ndarray | None) -> Automaton:
    """The automaton of a shard's n-grams of ``k`` words whose two parts of one word less are in the bitmap."""
    n = len(ids) - k + 1
    good = np.ones(max(0, n), bool)
    for j in range(k):
        good &= ids[j : n + j] >= 0 if n > 0 else good
    if frequent is not None and n > 0:
        at = np.flatnonzero(good)
        hashes, bits = _hashes(words), np.uint64(len(frequent) * 64 - 1)

        def known(first: int) -> np.ndarray:
            h = _mixed(lang, [hashes[ids[at + first + j]] for j in range(k - 1)]) & bits
            return (frequent[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1

        at = at[known(0)]
        at = at[known(1)]
    else:
        at = np.flatnonzero(good)
    rows, counts = summed([ids[at + j] for j in range(k)], len(words) + 1)
    return Automaton.from_sorted(rows, counts, words)


# Counting ------------------------------------------------------------------------------------------------------------

_PART = "part int, lang string, k int, blob binary"


def _parts(bounds: list[tuple[str, tuple[bytes, ...]]], lang: str) -> tuple[int, list[tuple[bytes, ...]]]:
    """The first range that holds n-grams of a language, and the bounds within the language."""
    return bisect_right(bounds, (lang, ())), [b for x, b in bounds if x == lang and b]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


_NAMES, _KINDS = ["part", "lang", "k", "blob"], [pa.int32(), pa.string(), pa.int32(), pa.binary()]


def _count(shards: DataFrame, k: int, frequent: Broadcast | None, bounds: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("colloc")
        for b in batches:
            for lang, words, ids in zip(*(b.column(i) for i in range(3)), strict=True):
                lang, words = lang.as_py(), words.as_py()
                words = words.split(b"\n") if words else []
                found = shard_ngrams(lang, words, np.frombuffer(ids.as_buffer(), np.int32), k, frequent.value if frequent else None)
                first, own = _parts(bounds.value, lang)
                rows = [(first + i, lang, k, a.pack()) for i, a in found.cut(own)]
                for at in range(0, len(rows), 64):
                    yield _batch(rows[at : at + 64], _NAMES, _KINDS)

    return shards.select("lang", "words", "ids").mapInArrow(run, _PART)


def _united(parts: DataFrame, ranges: int, least: int) -> DataFrame:
    """One automaton a range and language: the union of its parts, less what is rarer than ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("colloc")
        key, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            whole = Automaton.union(held).at_least(least)
            rows = [(*key, whole.pack(), len(whole.weights))] if len(whole.weights) else []
            return _batch(rows, [*_NAMES, "kept"], [*_KINDS, pa.int64()])

        for b in batches:
            for part, lang, k, blob in zip(*(b.column(i) for i in range(4)), strict=True):
                own = (part.as_py(), lang.as_py(), k.as_py())
                if key is not None and own != key:
                    yield done()
                    held, size = [], 0
                key = own
                held.append(Automaton.unpack(blob.as_py()))
                size += len(held[-1].weights)
                if size >= UNITE and len(held) > 1:
                    held = [Automaton.union(held)]
                    size = max(0, len(held[0].weights) - UNITE // 2)  # so a large union isn't made anew with every part
        if key is not None:
            yield done()

    dealt = parts.repartition(ranges, "part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(run, _PART + ", kept long")


def _bitmap(level: DataFrame) -> np.ndarray:
    """The hashes of all n-grams of a level as bits; bits are set by number, so tasks' maps are joined by a grouped or."""
    kept = level.agg(F.sum("kept")).first()[0] or 0
    bits = 1 << 16
    while bits < min(16 * kept, MAX_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, blob in zip(b.column(0), b.column(1), strict=True):
                h = np.unique(_row_hashes(lang.as_py(), Automaton.unpack(blob.as_py())) & np.uint64(bits - 1))
                word, first = np.unique(h >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), first) if len(h) else h
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    found = level.select("lang", "blob").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def _bounds(shards: DataFrame, ranges: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """Quantiles of n-grams, and the beginning of every language."""
    marks = shards.select("lang", F.explode("marks").alias("mark"))
    few = marks.orderBy(F.xxhash64("lang", "mark"), "lang", "mark").limit(SAMPLE).collect()
    grams = sorted((r["lang"], tuple(r["mark"].encode().split(b" "))) for r in few)
    found = {grams[len(grams) * i // ranges] for i in range(1, ranges)} if grams else set()
    return sorted(found | {(r["lang"], ()) for r in shards.select("lang").distinct().collect()})


@dataclass
class Counted:
    """Automata of all n-grams of up to ``LONGEST`` words that occur often enough, by prefix range and language."""

    table: DataFrame  # part, lang, k, blob, kept
    totals: DataFrame  # lang, n: all word occurrences
    bounds: Broadcast


def count_ngrams(docs: DataFrame, least: int = MIN_COUNT) -> Counted:
    spark = docs.sparkSession
    ship(spark)
    usual = spark.conf.get(ARROW_ROWS)
    shards = materialise(shards_of(docs), "shards")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    occurrences = shards.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-occurrences // RANGE))
    bounds = spark.sparkContext.broadcast(_bounds(shards, ranges))
    levels, frequent = None, None
    try:
        spark.conf.set(ARROW_ROWS, "32")  # rows are automata
        for k in range(1, LONGEST + 1):
            level = materialise(_united(_count(shards, k, frequent, bounds), ranges, least), f"ngrams{k}")
            levels = level if levels is None else levels.unionByName(level)
            if k < LONGEST:
                frequent = spark.sparkContext.broadcast(_bitmap(level))
    finally:
        spark.conf.set(ARROW_ROWS, usual)
    return Counted(levels, totals, bounds)


# Collocations --------------------------------------------------------------------------------------------------------

_QUERY = "part int, lang string, phrase string, a long, place int, query string"
_QUERY_NAMES = ["part", "lang", "phrase", "a", "place", "query"]
_QUERY_KINDS = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]


def _queries(counted: Counted) -> DataFrame:
    """A row for each part of each candidate: ``place`` 2 j - 2 is its first j words, 2 j - 1 the rest; the range that knows the part.

    Rows of part -1 tell a phrase of one word less how often its extension occurs.
    """
    bounds = counted.bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("colloc")
        for b in batches:
            for lang, blob in zip(b.column(0), b.column(1), strict=True):
                lang, automaton = lang.as_py(), Automaton.unpack(blob.as_py())
                first, own = _parts(bounds.value, lang)
                where: dict[tuple, int] = {}
                rows = []

                def part_of(words: tuple, where=where, first=first, own=own) -> int:
                    if words not in where:
                        where[words] = first + bisect_right(own, words)
                    return where[words]

                for row, a in zip(automaton.rows().tolist(), automaton.weights.tolist(), strict=True):
                    words = tuple(automaton.words[i] for i in row)
                    phrase = b" ".join(words).decode()
                    for j in range(1, len(words)):
                        for side, w in enumerate((words[:j], words[j:])):
                            rows.append((part_of(w), lang, phrase, a, 2 * j - 2 + side, b" ".join(w).decode()))
                    if len(words) > 2:
                        rows += [(-1, lang, b" ".join(w).decode(), a, -1, None) for w in (words[:-1], words[1:])]
                    if len(rows) >= 1 << 14:
                        yield _batch(rows, _QUERY_NAMES, _QUERY_KINDS)
                        rows = []
                yield _batch(rows, _QUERY_NAMES, _QUERY_KINDS)

    return counted.table.where("k > 1").select("lang", "blob").mapInArrow(run, _QUERY)


_ANSWER = "lang string, phrase string, a long, place int, f long"


def _answer(queries: pa.Table, automata: pa.Table) -> pa.Table:
    worker_state("colloc")
    known = {(lang, k): blob for lang, k, blob in zip(*(automata.column(c).to_pylist() for c in ("lang", "k", "blob")), strict=True)}
    langs, texts = queries.column("lang").to_pylist(), queries.column("query").to_pylist()
    split = [t.encode().split(b" ") for t in texts]
    by: dict[tuple[str, int], list[int]] = {}
    for i, (lang, words) in enumerate(zip(langs, split, strict=True)):
        by.setdefault((lang, len(words)), []).append(i)
    f = np.zeros(len(langs), np.int64)
    for key, rows in by.items():
        if key in known:
            f[rows] = Automaton.unpack(known[key]).find([split[i] for i in rows])
    return queries.select(["lang", "phrase", "a", "place"]).append_column("f", pa.array(f))


def composed(queries: DataFrame, automata: DataFrame) -> DataFrame:
    """Every query's count from the automata of its range; ``QUERIES`` or so a task, whatever the range."""
    asked = queries.groupBy("part").agg(F.count(F.lit(1)).alias("asked"))
    tasks = F.broadcast(asked.select("part", F.ceil(F.col("asked") / QUERIES).cast("int").alias("tasks")))  # a row a range
    left = queries.join(tasks, "part").withColumn("salt", F.pmod(F.xxhash64("phrase", "place"), F.col("tasks")).cast("int")).drop("tasks")
    right = automata.join(tasks, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInArrow(_answer, _ANSWER)


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``LONGEST`` words."""
    counted = count_ngrams(docs, least)
    queries = materialise(_queries(counted), "queries")
    asked = composed(queries.where("part >= 0"), counted.table.select("part", "lang", "k", "blob"))
    longer = queries.where("part < 0").select("lang", "phrase", F.lit(None).cast("long").alias("a"), "place", F.col("a").alias("f"))
    at = lambda p: F.max(F.when(F.col("place") == p, F.col("f")))
    wide = asked.unionByName(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), at(-1).alias("longer"), *[at(p).alias(f"p{p}") for p in range(2 * LONGEST - 2)])
    cuts = []
    for j in range(1, LONGEST):
        first, rest = F.col(f"p{2 * j - 2}"), F.col(f"p{2 * j - 1}")
        score = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(p{2 * j - 2} as decimal(20,0)) + p{2 * j - 1})")
        cuts.append(F.when(first.isNotNull(), F.struct(score.cast("long").alias("score"), F.lit(j).alias("j"), first.alias("l"), rest.alias("r"))))
    wide = wide.where("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * " + str(absorbed))
    best = wide.select("lang", "phrase", "a", F.least(*cuts, F.lit(None)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's first ones of each of 64 shares, then of these: no task sorts a language.
    best = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = best.withColumn("no", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("no") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = ranked.join(F.broadcast(counted.totals), "lang")  # a row a language
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k
), g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM g WHERE k > 1 AND f >= {MIN_COUNT}
), cut AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, {SCALE}::HUGEINT * c.a // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.s[1:j], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.s[j + 1:], ' ')
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), sub AS (
  SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) t(m) WHERE m < k) GROUP BY ALL
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank
  FROM best LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {ABSORBED} * best.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
