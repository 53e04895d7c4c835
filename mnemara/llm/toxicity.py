"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Training looks at every labelled document that is not held out, one of each group of near copies (rows of one label with
the same ``SKETCH`` least hashes over 3-word shingles are one group: copies with few changes, while texts that share
half their shingles are apart but for one pair in hundreds). Terms are words and word beginnings of ``PREFIXES`` letters
(``stem*``), so inflected words share a term. Term frequency counts by levels: a text has the term of a level if the word
occurs as often as ``LEVELS`` says or oftener, and every level has its own inverse document frequency, so weights grow
with the frequency, about as its logarithm. The space holds all terms that make label 1 likelier than not: at
least ``MIN_RATE`` of their examples have it, in ``MIN_SUPPORT`` examples or more, with a log-likelihood ratio (G2) of at
least ``MIN_G2`` plus twice the logarithm of the number of terms tried. Of words and beginnings that stand for each
other one is kept. Label counts are grouped over all these examples, document frequencies over all documents. The index
holds ``max_examples`` examples with a term and besides, of every term, its first ``K``, so no term is without examples.

Up to ``max_terms`` terms, vocabulary and index (``max_examples + K * max_terms`` examples at most) go to the tasks as one
broadcast. Beyond that both stay tables (``Spread``): texts meet the terms in blocks of about half ``max_terms``, one
broadcast at a time, and every query goes from shard to shard of the examples with its ``K`` nearest so far, whose last is
the bound for the next shard. Both ways find the same neighbours.

Search is a block-max inverted index: examples stand in blocks, each term has postings by block and its largest weight
in each block. A query's upper bounds for all blocks are one small product; blocks are scored from the largest bound
down and the search ends when no bound reaches the k-th score, so the result is exact. Neighbours vote with weight
``1 / (0.05 + 1 - cosine)``, smoothed towards the base rate by ``SMOOTHING`` votes. A text that holds no term of the space
gets the rate of label 1 among training examples without any term.

Edge cases: null and empty texts are texts without terms; labels that are null are left out and several labels of one
id count as their maximum; no labels at all give score 0; null ids count as not held out; repeated rows get the same score
each; texts are read whole; ties go to the smaller example id; other columns are kept by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import MAX_BROADCAST_KEYS, materialise, rows_of, ship, table, without_rows, worker_state

MAX_EXAMPLES = 10_000
MAX_TERMS = 4096
MIN_G2 = 10.0
MIN_SUPPORT = 5
MIN_RATE = 0.5
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 3, 4, 6, 8, 16, 32)
SKETCH = 8
K = 15
BLOCK = 64
SMOOTHING = 0.5
THRESHOLD = 0.7
TALLY = 150_000
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sketch(text: str | None) -> int:
    """A hash of the ``SKETCH`` least hashes over the 3-word shingles of a text in lower case (fewer words: of the words)."""
    words = _WORD.findall((text or "").lower())
    if len(words) < 3:
        return xxhash.xxh64_intdigest(" ".join(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = h[:-2] * np.uint64(0x9E3779B185EBCA87) ^ h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.unique(np.partition(h, min(len(h) - 1, 64 * SKETCH))[: 64 * SKETCH])[:SKETCH]  # repeats of a shingle count once
    if len(least) < SKETCH:
        least = np.unique(h)[:SKETCH]
    return xxhash.xxh64_intdigest(least.tobytes())


def _with_labels(docs: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Texts that may be examples, with the columns of ``labelled`` (a written table), which is broadcast if it is small."""
    few = rows_of(labelled) <= MAX_BROADCAST_KEYS
    return _texts(docs).join(F.broadcast(labelled) if few else labelled, keys)


def training_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``ex_id, text_hash, toxic``: the labelled documents that are not held out, one of each group of copies."""
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("ex_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        for b in batches:
            group = np.fromiter((sketch(t.as_py()) for t in b.column(3)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(group.view(np.int64))], ["ex_id", "text_hash", "toxic", "_group"])

    rows = _with_labels(docs, materialise(ids, "labelled", narrow=True), ["ex_id"]).select("ex_id", "text_hash", "toxic", "text")
    marks = rows.mapInArrow(mark, "ex_id long, text_hash long, toxic int, _group long")
    return marks.groupBy("_group", "toxic").agg(F.min(F.struct("ex_id", "text_hash")).alias("e")).select("e.ex_id", "e.text_hash", "toxic")


def _texts(docs: DataFrame) -> DataFrame:
    """``ex_id, text_hash, text`` of what may be an example."""
    d = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return d.select(F.col("doc_id").cast("long").alias("ex_id"), F.xxhash64("text").alias("text_hash"), "text")


def terms_of(text: str | None) -> dict[str, int]:
    """Words and beginnings of a text with their occurrences."""
    terms: dict[str, int] = {}
    for word, c in Counter(_WORD.findall((text or "").lower())).items():
        terms[word] = terms.get(word, 0) + c
        for k in PREFIXES:
            if len(word) < k:
                break
            head = word[:k] + "*"
            terms[head] = terms.get(head, 0) + c
    return terms


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, level, df, hit`` of texts with labels, summed up as far as ``TALLY`` terms go."""
    worker_state("toxicity")
    n = len(LEVELS)
    tally: dict[str, list[int]] = {}  # by highest level reached: texts of label 0, then of label 1

    def flush() -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for term, seen in tally.items():
            df = hit = 0
            for level in range(n - 1, -1, -1):
                hit += seen[n + level]
                df += seen[level] + seen[n + level]
                if df:
                    for column, x in zip(out, (term, LEVELS[level], df, hit), strict=True):
                        column.append(x)
        tally.clear()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["term", "level", "df", "hit"])

    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for term, c in terms_of(text.as_py()).items():
                seen = tally.get(term)
                if seen is None:
                    seen = tally[term] = [0] * (2 * n)
                seen[(n if toxic else 0) + (0 if c == 1 else bisect_right(LEVELS, c) - 1)] += 1
            if len(tally) >= TALLY:
                yield flush()
    yield flush()


def features(docs: DataFrame, ids: DataFrame) -> DataFrame | None:
    """``term, level, g2`` of all that speaks for label 1 in the examples ``ids``; None if they have one label only."""
    n = ids.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    total, toxic = n["n"], n["t"] or 0
    if not toxic or toxic == total:
        return None
    examples = _with_labels(docs, ids, ["ex_id", "text_hash"])
    if _texts(docs).groupBy("ex_id", "text_hash").count().where("count > 1").limit(1).count():  # rows repeated with one id
        examples = examples.dropDuplicates(["ex_id", "text_hash"])
    counts = (
        examples.select("toxic", "text")
        .mapInArrow(_tallies, "term string, level int, df long, hit long")
        .groupBy("term", "level")
        .agg(F.sum("df").alias("df"), F.sum("hit").alias("hit"))
        .where(f"df >= {MIN_SUPPORT}")
    )
    counts = materialise(counts, "terms", narrow=True)
    least = MIN_G2 + 2 * math.log(max(1, rows_of(counts)))
    p, hit, df = toxic / total, F.col("hit"), F.col("df")

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (
        term(hit, df * p) + term(df - hit, df * (1 - p)) + term(toxic - hit, (total - df) * p) + term(total - toxic - df + hit, (total - df) * (1 - p))
    )
    best = counts.withColumn("g2", g2).where((F.col("hit") > df * p) & (F.col("hit") >= df * MIN_RATE) & (F.col("g2") >= least))

    def choose(alike: pd.DataFrame) -> pd.DataFrame:
        kept = apart(list(alike[["term", "level", "hit", "df"]].itertuples(index=False, name=None)))
        return alike.loc[[k in kept for k in zip(alike["term"], alike["level"], strict=True)], ["term", "level", "g2"]]

    # Only terms of one level that begin alike can stand for each other.
    head = F.substring(F.regexp_replace("term", r"\*$", ""), 1, PREFIXES[0])
    chosen = best.withColumn("head", head).groupBy("head", "level").applyInPandas(choose, "term string, level int, g2 double")
    return materialise(chosen, "vocabulary", narrow=True)


def apart(found: list[tuple[str, int, int, int]]) -> set[tuple[str, int]]:
    """Of terms of one level that begin alike, those to keep: a longer one in place of a beginning whose hits it nearly
    all has, else the beginning in place of longer ones that are no surer."""
    kept: dict[tuple[str, int], tuple[int, float]] = {}
    alike: dict[tuple[str, int], list[tuple[str, int]]] = {}  # kept and dropped again, by their first letters and level
    for term, level, hit, df in sorted(found, key=lambda r: (-len(r[0].rstrip("*")), r[0].endswith("*"), r)):
        head, rate = term.rstrip("*"), hit / df
        near = alike.setdefault((head[: PREFIXES[0]], level), [])
        longer = [k for k in near if k in kept and term.endswith("*") and k[0].startswith(head)]
        if any(kept[k][0] >= 0.9 * hit and kept[k][1] >= rate - 0.02 for k in longer):
            continue
        for k in longer:
            if kept[k][1] <= rate + 0.02:
                del kept[k]
        kept[term, level] = (hit, rate)
        near.append((term, level))
    return set(kept)


class Terms:
    """Finds in whole texts the terms of a vocabulary: words, and words that begin with ``stem*``, by their occurrences."""

    def __init__(self, terms: list[tuple[str, int]]) -> None:
        self.automaton, self.levels = ahocorasick.Automaton(), {}
        for i, (t, level) in enumerate(terms):
            self.levels.setdefault(t, []).append((level, i))
        by_letters: dict[str, list[tuple[str, bool]]] = {}
        for t in self.levels:
            by_letters.setdefault(t.rstrip("*"), []).append((t, not t.endswith("*")))
        for letters, meant in by_letters.items():
            self.automaton.add_word(letters, (len(letters), meant))
        if terms:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> tuple[int, ...]:
        """Places in the vocabulary of the terms that a text has."""
        if not text or not self.levels:
            return ()
        low, found = text.lower(), Counter()
        for end, (n, meant) in self.automaton.iter(low):
            if end >= n and low[end - n].isalnum():
                continue
            whole = end + 1 == len(low) or not low[end + 1].isalnum()
            for t, needs_end in meant:
                if whole or not needs_end:
                    found[t] += 1
        return tuple(sorted(i for t, c in found.items() for level, i in self.levels[t] if level <= c))


def unit_vector(terms: tuple[int, ...], idf: list[float]) -> list[tuple[int, float]]:
    norm = math.sqrt(sum(idf[i] ** 2 for i in terms))
    return [(i, idf[i] / norm) for i in terms]


@dataclass
class BlockMaxIndex:
    """Inverted index over unit vectors; ``postings[term][block]`` holds places in the block and weights."""

    ids: np.ndarray
    labels: np.ndarray
    most: list[tuple[np.ndarray, np.ndarray]]  # by term: its blocks and the largest weight in each
    postings: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    block: int

    @classmethod
    def build(cls, examples: list[tuple[int, int, list[tuple[int, float]]]], n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        # Like examples stand together, which keeps the blocks' maxima apart.
        order = sorted(examples, key=lambda e: (sorted(e[2], key=lambda x: (-x[1], x[0])), e[0]))
        lists: list[dict[int, tuple[list, list]]] = [{} for _ in range(n_terms)]
        for at, (_, _, vector) in enumerate(order):
            b, place = divmod(at, block)
            for t, w in vector:
                places, weights = lists[t].setdefault(b, ([], []))
                places.append(place)
                weights.append(w)
        postings = [{b: (np.array(p), np.array(w)) for b, (p, w) in d.items()} for d in lists]
        most = [(np.array(list(d), np.int64), np.array([w.max() for _, w in d.values()])) for d in postings]
        return cls(np.array([e[0] for e in order], np.int64), np.array([e[1] for e in order], np.int64), most, postings, block)

    def nearest(self, query: list[tuple[int, float]], k: int = K, known: Iterable[tuple[float, int, int]] = ()) -> list[tuple[float, int, int]]:
        """``(cosine, example id, label)`` of the ``k`` nearest with a common term, those ``known`` of other shards among
        them; ties go to the smaller id."""
        bounds = np.zeros(-(-len(self.ids) // self.block))
        for t, w in query:
            blocks, weights = self.most[t]
            bounds[blocks] += w * weights
        top = [(s, -i, y) for s, i, y in known]  # (cosine, -id, label): the smallest is the worst
        heapq.heapify(top)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(top) == k and bounds[b] < top[0][0] - 1e-9:
                break
            scores = np.zeros(self.block)
            for t, w in query:
                if b in self.postings[t]:
                    places, weights = self.postings[t][b]
                    scores[places] += w * weights
            for place in np.flatnonzero(scores).tolist():
                at = b * self.block + place
                entry = (round(float(scores[place]), 9), -int(self.ids[at]), int(self.labels[at]))
                if len(top) < k:
                    heapq.heappush(top, entry)
                elif entry > top[0]:
                    heapq.heapreplace(top, entry)
        return [(s, -i, y) for s, i, y in sorted(top, reverse=True)]


@dataclass
class Model:
    terms: list[tuple[str, int]]
    idf: list[float]
    index: BlockMaxIndex | None
    base: float  # rate of label 1 among all examples
    blank: float  # and among those without any term
    spread: Spread | None = None  # in place of terms, idf and index

    def score(self, terms: tuple[int, ...], k: int = K) -> tuple[float, list[tuple[float, int, int]]]:
        near = self.index.nearest(unit_vector(terms, self.idf), k) if terms and self.index else []
        if not near:
            return self.blank, []
        weights = [1 / (0.05 + max(0.0, 1 - s)) for s, _, _ in near]
        return (sum(w for w, (_, _, y) in zip(weights, near, strict=True) if y) + SMOOTHING * self.base) / (sum(weights) + SMOOTHING), near


@dataclass
class Spread:
    """A vocabulary and examples too many for one broadcast, as written tables that are used a part at a time."""

    terms: DataFrame  # block, place, term, level, idf
    examples: DataFrame  # shard, ex_id, toxic, terms, weights
    blocks: int
    shards: int

    def block(self, b: int) -> tuple[list[tuple[str, int]], np.ndarray]:
        rows = self.terms.where(F.col("block") == b).orderBy("place").collect()
        return [(r["term"], r["level"]) for r in rows], np.array([r["idf"] for r in rows], float)

    def shard(self, s: int) -> tuple[dict[int, int], BlockMaxIndex]:
        """Places of a shard's terms, and its index."""
        rows = self.examples.where(F.col("shard") == s).collect()
        places: dict[int, int] = {}
        for r in rows:
            for t in r["terms"]:
                places.setdefault(t, len(places))
        vectors = [(r["ex_id"], r["toxic"], [(places[t], w) for t, w in zip(r["terms"], r["weights"], strict=True)]) for r in rows]
        return places, BlockMaxIndex.build(vectors, len(places))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("ex_id"), F.xxhash64("text").alias("text_hash"), "text")


def _find(rows: DataFrame, vocabulary: list[tuple[str, int]]) -> DataFrame:
    """``ex_id, text_hash, terms`` of the rows of ``_keyed`` that have terms of the vocabulary, by their places in it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        terms = Terms(vocabulary)
        for b in batches:
            found = [list(terms.find(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["ex_id", "text_hash", "terms"])

    return rows.mapInArrow(find, "ex_id long, text_hash long, terms array<int>").where("size(terms) > 0")


def _idf(whole: int, df: Column) -> Column:
    return F.log(F.lit(1.0 + whole) / (1 + F.coalesce(df, F.lit(0)))) + 1


def _chosen(with_terms: DataFrame, max_examples: int) -> tuple[DataFrame, DataFrame]:
    """The examples of the index: ``max_examples`` of all, and the first ``K`` of every term."""
    some = with_terms.orderBy("hash", "ex_id", "text_hash").limit(max_examples)
    of_term = Window.partitionBy("term").orderBy("hash", "ex_id", "text_hash")
    return some, with_terms.withColumn("term", F.explode("terms")).withColumn("no", F.row_number().over(of_term)).where(F.col("no") <= K)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    """The model; at most ``max_terms`` terms and ``max_examples + K * max_terms`` sparse vectors are in the driver at a time."""
    ship(docs.sparkSession)
    ids = materialise(training_ids(docs, labels), "examples", narrow=True)
    vocabulary = features(docs, ids)
    n_terms = rows_of(vocabulary) if vocabulary is not None else 0
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = total["n"], total["t"] or 0
    base = toxic / n if n else 0.0
    model = Model([], [], None, base, (toxic + SMOOTHING * base) / (n + SMOOTHING))
    if not n_terms:
        return model
    if n_terms > max_terms:
        with_terms = _fit_spread(docs, ids, vocabulary, -(-2 * n_terms // max_terms), model, max_examples, max_examples + K * max_terms)
    else:
        model.terms = [(r["term"], r["level"]) for r in vocabulary.orderBy(F.desc("g2"), "term", "level").collect()]
        found = materialise(_find(_keyed(docs), model.terms), "found")
        df = {r["term"]: r["n"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        whole = rows_of(docs)
        model.idf = [math.log((1 + whole) / (1 + df.get(i, 0))) + 1 for i in range(n_terms)]
        with_terms = found.join(ids, ["ex_id", "text_hash"]).dropDuplicates(["ex_id", "text_hash"]).withColumn("hash", F.xxhash64("ex_id"))
        with_terms = materialise(with_terms, "with_terms", narrow=True)
        examples = {(r["ex_id"], r["text_hash"]): r for part in _chosen(with_terms, max_examples) for r in part.collect()}
        vectors = [(r["ex_id"], r["toxic"], unit_vector(tuple(r["terms"]), model.idf)) for r in examples.values()]
        model.index = BlockMaxIndex.build(vectors, n_terms) if vectors else None
    seen = with_terms.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    blank, blank_toxic = n - seen["n"], toxic - (seen["t"] or 0)
    model.blank = (blank_toxic + SMOOTHING * base) / (blank + SMOOTHING)
    return model


def _fit_spread(docs: DataFrame, ids: DataFrame, vocabulary: DataFrame, blocks: int, model: Model, max_examples: int, shard: int) -> DataFrame:
    """Gives ``model`` its tables; returns all examples with terms."""
    at = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    place = F.row_number().over(Window.partitionBy("block").orderBy("term", "level")) - 1
    # Without frequencies yet every term weighs 1.
    terms = materialise(vocabulary.select(at.alias("block"), "term", "level").withColumn("place", place).withColumn("idf", F.lit(1.0)), "blocks", narrow=True)
    model.spread = spread = Spread(terms, terms, blocks, 0)
    found = [materialise(_find(_keyed(docs), spread.block(b)[0]), "found") for b in range(blocks)]
    parts = [f.select(F.lit(b).alias("block"), F.explode("terms").alias("place")) for b, f in enumerate(found)]
    df = _union(parts).groupBy("block", "place").agg(F.count(F.lit(1)).alias("n"))
    spread.terms = materialise(terms.drop("idf").join(df, ["block", "place"], "left").withColumn("idf", _idf(rows_of(docs), F.col("n"))).drop("n"), "idf", narrow=True)
    labelled = [f.join(ids, ["ex_id", "text_hash"], "left_semi") for f in found]
    with_terms = materialise(_vectors(labelled, spread).join(ids, ["ex_id", "text_hash"]).withColumn("hash", F.xxhash64("ex_id")), "with_terms", narrow=True)
    columns = ["ex_id", "text_hash", "toxic", "terms", "weights"]
    examples = _union([part.select(*columns) for part in _chosen(with_terms, max_examples)]).dropDuplicates(["ex_id", "text_hash"])
    examples = materialise(examples, "index", narrow=True)
    spread.shards = -(-2 * rows_of(examples) // shard)
    spread.examples = materialise(examples.withColumn("shard", F.pmod(F.xxhash64("ex_id", "text_hash"), F.lit(max(1, spread.shards))).cast("int")), "shards", narrow=True)
    return with_terms


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _vectors(found: list[DataFrame], spread: Spread) -> DataFrame:
    """``ex_id, text_hash, terms, weights`` of what ``_find`` found block by block: one unit vector a text, repeats once."""

    def weighed(b: int) -> DataFrame:
        idf = spread.block(b)[1]

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                lists = rows.column(2)
                places = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
                own = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (places.astype(np.int64) + (b << 32), idf[places])]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *own], ["ex_id", "text_hash", "terms", "weights"])

        kind = "ex_id long, text_hash long, terms array<long>, weights array<double>"
        return found[b].mapInArrow(weigh, kind).withColumn("block", F.lit(b))

    once = _union([weighed(b) for b in range(len(found))]).dropDuplicates(["ex_id", "text_hash", "block"])
    whole = once.groupBy("ex_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("terms", "weights")))).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["weights"] * x["weights"]))
    return whole.select("ex_id", "text_hash", F.transform("v", lambda x: x["terms"]).alias("terms"), F.transform("v", lambda x: x["weights"] / size).alias("weights"))


def _search(docs: DataFrame, model: Model) -> DataFrame:
    """``ex_id, text_hash, score, neighbours`` of every text with a term, shard after shard of the examples."""
    spread, near = model.spread, "array<struct<cosine:double,id:long,toxic:int>>"
    found = [materialise(_find(_keyed(docs), spread.block(b)[0]), "found") for b in range(spread.blocks)]
    rows = materialise(_vectors(found, spread).withColumn("near", F.array().cast(near)), "queries")

    def step(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state("toxicity")
            places, index = shared.value
            for b in batches:
                out = []
                for terms, weights, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    query = [(places[t], w) for t, w in zip(terms, weights, strict=True) if t in places]
                    top = index.nearest(query, known=[(x["cosine"], x["id"], x["toxic"]) for x in known])
                    out.append([{"cosine": s, "id": i, "toxic": y} for s, i, y in top])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, b.column(4).type)], b.schema.names)

        return run

    for s in range(spread.shards):
        shared = docs.sparkSession.sparkContext.broadcast(spread.shard(s))
        rows = materialise(rows.mapInArrow(step(shared), rows.schema), "near")
        shared.unpersist()
    weight = lambda x: 1 / (0.05 + F.greatest(F.lit(0.0), 1 - x["cosine"]))
    votes = F.aggregate("near", F.lit(0.0), lambda a, x: a + weight(x) * x["toxic"])
    score = (votes + SMOOTHING * model.base) / (F.aggregate("near", F.lit(0.0), lambda a, x: a + weight(x)) + SMOOTHING)
    return rows.where("size(near) > 0").select("ex_id", "text_hash", score.alias("score"), F.transform("near", lambda x: x["id"]).alias("neighbours"))


def _spread_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_hash, score, neighbours`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("ex_id")) & (F.col("r.text_hash") == F.col("s.text_hash"))
    score, neighbours = F.coalesce("score", F.lit(model.blank)), F.coalesce("neighbours", F.array().cast("array<long>"))
    return rows.alias("r").join(_search(docs, model).alias("s"), same, "left").select("doc_id", "r.text_hash", score.alias("score"), neighbours.alias("neighbours"))


class Scorer:
    """Scores texts in a task; equal sets of terms are searched once."""

    def __init__(self, model: Model) -> None:
        self.model, self.terms, self.known = model, Terms(model.terms), {}

    def __call__(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        terms = self.terms.find(text)
        if terms not in self.known:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[terms] = self.model.score(terms)
        return self.known[terms]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, neighbours`` (ids of the examples that voted, nearest first) of every row."""
    if model.spread:
        return _spread_scores(docs, model).drop("text_hash")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        scorer = Scorer(shared.value)
        for b in batches:
            out = [scorer(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([[i for _, i, _ in near] for _, near in out], pa.list_(pa.int64()))],
                ["doc_id", "score", "neighbours"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, neighbours array<long>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Documents with a score below the threshold, with their columns as they are."""
    model = fit(docs, labels, max_terms=max_terms)
    if model.spread:
        long = "_" * max(map(len, docs.columns))  # no column of docs has a longer name
        keys = [f"{long}_id", f"{long}_hash"]
        gone = _spread_scores(docs, model).where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias(keys[0]), F.col("text_hash").alias(keys[1]))
        keyed = docs.select("*", F.col("doc_id").cast("long").alias(keys[0]), F.xxhash64("text").alias(keys[1]))
        return without_rows(keyed, gone, keys).select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([scorer(t.as_py())[0] < THRESHOLD for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
