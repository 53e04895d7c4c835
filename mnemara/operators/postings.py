"""Keyword search from a positional inverted index.

The index is two tables in a folder: ``postings`` (term, id, number of tokens of the text, places of the term), in buckets of
terms and sorted, and ``terms`` (rows with it, its largest share of a text's tokens). A search reads the buckets of its
words only. Candidates of a set are the rows with its rarest wanted word; a row's score is at most this word's share there plus
the largest shares of the query's other words, so the best candidates are verified first and the others only as far as this
bound reaches the n-th score found. Phrases are verified by their words' places.

A word that a third of all rows have is one term of many rows: postings are dealt by term and id, and candidates meet words by
both, so it is spread over tasks. Empty texts have no postings; they match sets that only forbid. Null texts match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemara.functions import text as tx
from mnemara.operators.retrieval import keyword_sets, ranked
from mnemara.streaming.scratch import written

BUCKETS = 64
TOKENS = 200_000  # that a task turns into postings at a time
FIRST = 4  # times the limit: candidates that are verified before others are left out
MAX_BROADCAST_WORDS = 100_000
SPLIT = 16


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``TOKENS`` tokens or one row: a token becomes several numbers."""
    for b in batches:
        upto = np.cumsum(np.asarray(b.column(1).value_lengths().fill_null(0), np.int64))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKENS, "right")))
            yield b.slice(at, stop - at)
            at = stop


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, id, n, positions`` from rows of tokens."""
    for b in _bounded(batches):
        tokens = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
        length = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
        words = tokens.flatten().dictionary_encode()
        if not len(words):
            continue
        row = np.repeat(np.arange(b.num_rows), length)
        place = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
        key = row * np.int64(len(words.dictionary)) + words.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at = order[first]
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([words.dictionary.take(words.indices.take(pa.array(at))), b.column(0).take(pa.array(row[at])), pa.array(length[row[at]].astype(np.int32)), positions], ["term", "id", "n", "positions"])


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # bucket, term, id, n, positions
    terms: DataFrame  # term, df, share
    rows: DataFrame  # id, n

    @classmethod
    def build(cls, data: DataFrame) -> Index:
        """From rows ``id, text``, of distinct ids."""
        tokens = written(data.where("text is not null").select(F.col("id").cast("long").alias("id"), tx.tokens("text").alias("t")), "tokens")
        found = tokens.mapInArrow(_positions, "term string, id long, n int, positions array<int>").withColumn("bucket", bucket(F.col("term")))
        dealt = found.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        postings = written(dealt, "postings", ["bucket"])
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(F.size("positions") / F.col("n")).alias("share"))
        return cls(postings, written(terms, "terms"), written(tokens.select("id", F.size("t").alias("n")), "lengths"))

    def _of(self, words: DataFrame, few: bool) -> DataFrame:
        """The postings of ``words`` (``term``, distinct)."""
        if not few:
            return self.postings.join(words, "term", "left_semi")
        buckets = [r["b"] for r in words.select(bucket(F.col("term")).alias("b")).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(buckets)).join(F.broadcast(words), "term", "left_semi")

    def search(self, queries: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
        """``query_id, id, score, rank`` as ``retrieval.keyword_hits`` gives them, of all rows or those whose ``id`` is in ``seen``."""
        sets = written(keyword_sets(queries), "sets")
        item = sets.select("query_id", "no", F.posexplode("items").alias("item", "i"))
        words = item.select("query_id", "no", "item", F.col("i.wanted").alias("wanted"), F.posexplode(F.split(F.trim(F.col("i.phrase")), " ")).alias("off", "term"))
        every = words.select("term").distinct()
        few = every.limit(MAX_BROADCAST_WORDS + 1).count() <= MAX_BROADCAST_WORDS
        stats = written((F.broadcast(every) if few else every).join(self.terms, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("share", F.lit(0.0)).alias("share")), "stats")
        words = written(words.join(F.broadcast(stats) if few else stats, "term"), "words")
        own = written(self._of(every, few).drop("bucket"), "own")
        most = words.where("wanted").select("query_id", "term", "share").distinct().groupBy("query_id").agg(F.sum("share").alias("most"))
        rare = words.where("wanted").groupBy("query_id", "no").agg(F.min(F.struct("df", "term", "share")).alias("r")).where("r.df > 0")
        rare = written(rare.join(most, "query_id").select("query_id", "no", "r.term", (F.col("most") - F.col("r.share")).alias("rest")), "rare")
        bound = lambda tf: F.ceil((tf + F.col("rest")) * 1_000_000) / 1_000_000 + 1e-6
        if rare.count() <= MAX_BROADCAST_WORDS:
            met = own.join(F.broadcast(rare), "term")
        else:
            split = rare.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long"))))
            met = own.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPLIT))).join(split, ["term", "part"])
        found = met.select("query_id", "no", "id", "n", bound(F.size("positions") / F.col("n")).alias("bound"))
        forbid = sets.join(words.where("wanted").select("query_id", "no").distinct(), ["query_id", "no"], "left_anti").join(most, "query_id", "left")
        forbid = forbid.select("query_id", "no", F.coalesce("most", F.lit(0.0)).alias("rest"))
        n_forbid = forbid.count()
        if n_forbid:
            against = self.rows.join(F.broadcast(forbid) if n_forbid <= MAX_BROADCAST_WORDS else forbid)
            found = found.unionByName(against.select("query_id", "no", "id", "n", bound(F.lit(0.0)).alias("bound")))
        if seen is not None:
            found = found.join(seen, "id", "left_semi")
        found = written(found, "found")
        first = written(ranked(found, ["query_id"], [F.desc("bound"), F.col("id"), F.col("no")], FIRST * n).drop("rank"), "first")
        top = written(ranked(self._verified(first, words, own), ["query_id"], [F.desc("score"), F.col("id")], n), "top")
        last = top.where(F.col("rank") == n).select("query_id", F.col("score").alias("least"), F.col("id").alias("last"))
        rest = found.join(first.select("query_id", "no", "id"), ["query_id", "no", "id"], "left_anti").join(last, "query_id", "left")
        rest = rest.where("least is null or bound > least + 2e-6 or (bound >= least and id < last)").drop("least", "last")
        both = top.drop("rank").unionByName(self._verified(rest, words, own)).groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return ranked(both, ["query_id"], [F.desc("score"), F.col("id")], n)

    def _verified(self, candidates: DataFrame, words: DataFrame, own: DataFrame) -> DataFrame:
        """``query_id, id, score`` of candidates that a set holds for; their words' places come by term and id."""
        asked = candidates.join(words.select("query_id", "no", "item", "wanted", "off", "term"), ["query_id", "no"])
        placed = asked.join(own.select("term", "id", "positions"), ["term", "id"], "left")
        starts = F.transform(F.coalesce("positions", F.array().cast("array<int>")), lambda p: p - F.col("off"))
        phrase = placed.groupBy("query_id", "no", "id", "n", "item", "wanted").agg(F.collect_list(starts).alias("s"))
        common = F.aggregate(F.slice("s", 2, 1_000_000), F.get("s", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        holds = phrase.groupBy("query_id", "no", "id", "n").agg(F.bool_and((F.size(common) > 0) == F.col("wanted")).alias("holds"))
        hits = holds.where("holds").select("query_id", "id", "n").distinct()
        mine = words.where("wanted").select("query_id", "term").distinct()
        score = hits.join(mine, "query_id", "left").join(own.select("term", "id", F.size("positions").alias("tf")), ["term", "id"], "left")
        share = F.coalesce(F.sum("tf"), F.lit(0)) / F.greatest(F.lit(1), F.max("n"))
        return score.groupBy("query_id", "id").agg(F.round(share, 6).alias("score"))
