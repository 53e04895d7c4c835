"""Language identification by fusing evidence as Bayes has it.

The posterior of a language is the product of

* text: a character-trigram model (hashed to ``BUCKETS``, letters only), trained on a bounded sample of labelled
  documents (``per_lang`` rows a language, of every language that a label names; the model takes 128 KB a language).
  Trigrams overlap, so their log-likelihood counts at ``TEMPER``;
* the language that the markup declares: P(declared | language);
* the address suffix: P(suffix | language);
* a host prior P(language | host), smoothed towards the host's domain, which is smoothed towards all rows.

The tables of the last three are grouped counts over all rows, by the language that the text alone gives; a row's own
count is taken out of its host's and domain's before it is used. Counting is partial before the shuffle, and what is
joined back is one row a host, domain, suffix or declaration; the counts of those that hold more than 1 / ``HOT`` of all
rows (so at most ``HOT``) are broadcast, and their rows are spread over all tasks.

Besides the languages there is an unknown one, of probability ``UNKNOWN``, whose trigrams are all as likely: texts in a
language without labels and random letters go there. A row is rejected if it has no letters or the posterior of its best
language is below ``min_confidence``; its language is then ``und``.

Edge cases: null and empty texts have no text evidence and are rejected; a null or empty host, suffix or
declaration is no evidence (a null host's prior is that of all rows); repeated rows count as rows; no labelled documents
at all reject everything; an empty table gives an empty one. Texts are read whole, in slices of ``SLICE`` characters, so a
text's length doesn't count for memory; ties go to the language that comes first by code point.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import materialise, ship, table, without_rows, worker_state

PER_LANG = 1000
BUCKETS = 1 << 15
TEMPER = 1 / 3
KAPPA = 5.0
MIN_CONFIDENCE = 0.5
UNKNOWN = 0.01
HOT = 1000
SLICE = 1 << 16
DOCS_AT_ONCE = 256

_ASCII = np.array([ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)], np.uint32)
#: Signs and spaces above ASCII that are no letters.
_SIGNS = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x3000, 0x3004))


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's letter trigrams, slice by slice; runs of anything but letters are one space."""
    low, before, seen = (text or "").lower(), np.array([32], np.uint32), 0
    for at in range(0, len(low), SLICE):
        part = low[at : at + SLICE]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        if part.isascii():
            c = _ASCII[c]
        else:
            ascii_ = c < 128
            c = np.where(ascii_, _ASCII[np.where(ascii_, c, 0)], c)
            for a, b in _SIGNS:
                c = np.where((c >= a) & (c <= b), np.uint32(32), c)
        space = c == 32
        keep = np.ones(len(c), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[0] = not (seen and space[0] and before[-1] == 32)
        before = np.concatenate([before[-2:], c[keep]])
        seen += int(keep.sum())
        yield _buckets(before)
    if seen > 1 or seen and before[-1] != 32:
        yield _buckets(np.concatenate([before[-2:], [32]]).astype(np.uint32))


def _buckets(c: np.ndarray) -> np.ndarray:
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ h >> np.uint32(15)) % np.uint32(BUCKETS)).astype(np.int64)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(bucket | language) as an array ``buckets x languages``, from ``doc_id, text, lang``."""
    known = docs.where("lang is not null").select(F.col("doc_id").cast("long").alias("_id"), "text", F.col("lang").alias("_lang"))
    found = known.groupBy("_lang").count().collect()  # one row a language
    langs = sorted(r["_lang"] for r in found)
    # The smallest hashes of each language; a first cut at somewhat more leaves little to sort.
    hashed = known.withColumn("_hash", F.xxhash64("_id"))
    shares = {r["_lang"]: (1.25 * per_lang + 100) / r["count"] for r in found}
    large = F.create_map(*[F.lit(x) for k, v in shares.items() if v < 1 for x in (k, v)]) if min(shares.values(), default=1) < 1 else None
    share = F.coalesce(large[F.col("_lang")], F.lit(1.0)) if large is not None else F.lit(1.0)
    some = hashed.where((share >= 1) | (F.col("_hash").cast("double") < (2 * share - 1) * float(1 << 63)))
    by_hash = Window.partitionBy("_lang").orderBy("_hash", "_id", "text")
    sample = some.withColumn("_no", F.row_number().over(by_hash)).where(F.col("_no") <= per_lang)
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums = total.setdefault(place[lang], np.zeros(BUCKETS, np.int64))
                for g in trigrams(text.as_py()):
                    sums += np.bincount(g, minlength=BUCKETS)
        for lang, sums in total.items():
            bucket = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang), pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[bucket])], ["lang", "bucket", "n"])

    counts = np.full((BUCKETS, max(1, len(langs))), 0.5)
    if langs:
        sums = sample.select("_lang", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        t = sums.toArrow()  # at most languages x buckets rows
        counts[t["bucket"].to_numpy(), t["lang"].to_numpy()] += t["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_evidence(rows: DataFrame, n_langs: int, logp: np.ndarray, clean=None) -> DataFrame:
    """``rows`` with ``text`` replaced by ``ll`` (tempered log-likelihoods), ``letters`` (trigrams seen) and ``guess`` (place of the best, or null)."""
    shared = rows.sparkSession.sparkContext.broadcast(logp)
    at = rows.columns.index("text")
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language")
        table_ = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(first, DOCS_AT_ONCE)
                ll, seen, guess = [], [], []
                for t in b.column(at):
                    t = t.as_py()
                    s, n = np.zeros(table_.shape[1]), 0
                    for g in trigrams(clean(t) if clean and t else t):
                        s += table_[g].sum(axis=0, dtype=np.float64)
                        n += len(g)
                    ll.append(s * TEMPER)
                    seen.append(n)
                    guess.append(int(s.argmax()) if n and n_langs else None)
                flat = pa.array(np.concatenate(ll) if ll else np.zeros(0))
                offsets = pa.array(np.arange(len(ll) + 1, dtype=np.int32) * table_.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in names], pa.ListArray.from_arrays(offsets, flat), pa.array(seen, pa.int64()), pa.array(guess, pa.int32())],
                    [*names, "ll", "letters", "guess"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, ll array<double>, letters long, guess int")


def _with_counts(d: DataFrame, evidence: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """``d`` with ``_n_<key>``: how many rows of its key's value the text gives each language; null without any."""
    value, total, hot, salt = f"_{key}", f"_n_{key}", f"_hot_{key}", F.lit(0).alias("_salt")
    each = evidence.where(F.col(key).isNotNull() & F.col("guess").isNotNull()).groupBy(F.col(key).alias(value), "guess").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_lang = each.groupBy(value).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"), F.sum("n").alias("rows"))
    counts = by_lang.select(value, "rows", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias(total))
    most = max(HOT, rows // HOT)
    d = d.join(F.broadcast(counts.where(F.col("rows") > most).select(value, F.col(total).alias(hot))), F.col(key) == F.col(value), "left").drop(value)
    spread = F.when(F.col(key).isNull() | F.col(hot).isNotNull(), 1 + F.pmod(F.xxhash64("ll"), F.lit(4096))).otherwise(0)
    rest = counts.where(F.col("rows") <= most).select(value, total, salt)
    d = d.withColumn("_spread", spread).join(rest, (F.col(key) == F.col(value)) & (F.col("_spread") == F.col("_salt")), "left")
    return d.withColumn(total, F.coalesce(total, hot)).drop(value, hot, "_spread", "_salt")


def fuse(evidence: DataFrame, langs: list[str], kappa: float = KAPPA, min_confidence: float = MIN_CONFIDENCE, unknown: float = UNKNOWN) -> DataFrame:
    """Add ``lang, confidence, rejected`` to rows (a written table) with text evidence and those of ``host, domain, suffix, declared`` that there are."""
    n = len(langs)
    if not n:
        return evidence.select("*", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"))
    totals = {r["guess"]: r["n"] for r in evidence.groupBy("guess").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    seen = [float(totals.get(i, 0)) for i in range(n)]
    whole, rows = sum(seen), sum(totals.values())
    overall = F.array(*[F.lit((x + kappa / n) / (whole + kappa)) for x in seen])
    per_lang = F.array(*[F.lit(x) for x in seen])
    d = evidence
    for key in ("host", "domain", "suffix", "declared"):
        if key in evidence.columns:
            d = _with_counts(d, evidence, key, n, rows)
        else:
            d = d.withColumn(f"_n_{key}", F.lit(None).cast("array<double>"))
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.col("guess") == i, 1.0).otherwise(0.0))
    d = d.withColumn("_own", own)

    def others(key: str) -> Column:
        return F.zip_with(f"_n_{key}", "_own", lambda a, b: a - b)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def smoothed(counts: Column, towards: Column) -> Column:
        return F.zip_with(counts, towards, lambda c, p: (c + kappa * p) / (total(counts) + kappa))

    def share(key: str) -> Column:
        return total(F.col(f"_n_{key}")) / whole if whole else F.lit(1.0)

    def likelihood(key: str) -> Column:
        """log P(value | language), smoothed towards P(value); no evidence if there is no value."""
        p = F.zip_with(others(key), per_lang, lambda c, m: F.log((c + kappa * share(key)) / (m + kappa)))
        return F.coalesce(p, F.array(*[F.lit(0.0)] * n))

    d = d.withColumn("_domain_prior", F.coalesce(smoothed(others("domain"), overall), overall))
    d = d.withColumn("_prior", F.coalesce(smoothed(others("host"), F.col("_domain_prior")), F.col("_domain_prior")))
    joined = F.transform(F.arrays_zip("ll", "_prior", "_l_suffix", "_l_declared"), lambda z: z["ll"] + F.log(z["_prior"]) + z["_l_suffix"] + z["_l_declared"])
    d = d.withColumn("_l_suffix", likelihood("suffix")).withColumn("_l_declared", likelihood("declared")).withColumn("_score", joined)
    none = sum((F.coalesce(F.log(share(key)), F.lit(0.0)) for key in ("suffix", "declared")), F.lit(math.log(unknown)))
    d = d.withColumn("_top", F.array_max("_score")).withColumn("_none", none - F.col("letters") * (math.log(BUCKETS) * TEMPER))
    confidence = 1 / (F.aggregate("_score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))) + F.exp(F.least(F.lit(700.0), F.col("_none") - F.col("_top"))))
    names = F.array(*[F.lit(x) for x in langs])
    rejected = (F.col("letters") == 0) | (F.col("confidence") < min_confidence)
    return (
        d.withColumn("confidence", confidence)
        .withColumn("rejected", rejected)
        .withColumn("lang", F.when(rejected, F.lit("und")).otherwise(F.element_at(names, F.array_position("_score", F.col("_top")).cast("int"))))
        .select(*evidence.columns, "lang", F.round("confidence", 6).alias("confidence"), "rejected")
    )


_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def page_text(html: str) -> str:
    return unescape(_DROP.sub(" ", html))


def page_rows(pages: DataFrame) -> DataFrame:
    """``page_id, text`` (the markup) ``, host, domain, suffix, declared`` of web pages."""

    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    host = filled(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)))
    labels = F.split("host", r"\.")
    return (
        pages.select("page_id", F.col("html").alias("text"), host.alias("host"), filled(F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))).alias("declared"))
        .withColumn("domain", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")))
        .withColumn("suffix", F.element_at(labels, -1))
    )


def identify_pages(pages: DataFrame, training: DataFrame) -> DataFrame:
    ship(pages.sparkSession)
    langs, logp = train(training)
    evidence = materialise(text_evidence(page_rows(pages), len(langs), logp, page_text), "evidence")
    return fuse(evidence, langs).withColumn("text_lang", F.element_at(F.array(*[F.lit(x) for x in langs or ["und"]]), F.col("guess") + 1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return out.select("page_id", "lang", "confidence", "rejected", "text_lang", "declared", "host", "suffix", "letters")


def identify_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Documents have no markup or address; their source stands for the host."""
    ship(docs.sparkSession)
    langs, logp = train(training)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("host"))
    return fuse(materialise(text_evidence(rows, len(langs), logp), "evidence"), langs)


def drop_unidentified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Documents whose language is found, with their columns as they are.

    The verdict depends on id, text and source, so rows are dropped by these three.
    """
    out = identify_documents(docs, training).where("rejected")
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("host"))
    return without_rows(d, out, ["doc_id", "text_hash", "host"]).select("doc.*")
