"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: weighted shares of ``share`` times all words, stopped at ``max_epochs`` times each source's
   own words; what is cut off is shared again by weight (a water level over sources sorted by cap / weight).
2. A target is whole passes over the source plus a rest. The rests, measured in blocks of ``block_words``
   words, are apportioned to sources by the highest quotients ``rest / (2k + 1)``, and each source's blocks to
   its shards by the same rule, so every (source, shard) holds an integer quota.
3. A shard's documents stand in seeded order (md5 of seed and id) and are cut into blocks as one stream; the
   quota's blocks are taken from its start, so the selection is random by document and documents stay whole
   but for one at the edge.

Everything is DataFrame expressions. Text is read once, for its word count; what is shuffled afterwards is an id,
a source number and a size. A hot source is dealt over as many shards as its documents need.

Edge cases: null and empty texts have size 0 and take 0 words; null sources form one source that comes last;
repeated rows are rows of their own (each takes its share); an empty table gives an empty result; other columns
do not matter. Null ids are ordered as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import WORD, materialise, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 32
DOCS_PER_SHARD = 8192
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(df: DataFrame, by: list[str], ids: list[str], votes: str, limit: str, seats: str) -> DataFrame:
    """Add ``quota``: ``seats`` (one number per group ``by``) given by highest quotients ``votes / (2k + 1)``.

    No row gets more than ``limit``. Seats that rounding alone settles are given at once; only the
    quotients near the cut-off (about five a row) are ranked.
    """
    group = Window.partitionBy(*by)
    base = F.when(F.col("_v") > 0, F.floor(F.col(seats) * F.col(votes) / F.col("_v") + 0.5)).otherwise(0)
    margin = F.when(F.col("_v") > 0, F.ceil(F.col("_m") * F.col(votes) / F.col("_v"))).otherwise(0) + 2
    d = (
        df.withColumn("_v", F.sum(votes).over(group))
        .withColumn("_m", F.count(F.lit(1)).over(group))
        .withColumn("_base", base)
        .withColumn("_margin", margin)
        .withColumn("_lo", F.least(F.greatest(F.lit(0), F.col("_base") - F.col("_margin")), F.col(limit)))
        .withColumn("_hi", F.least(F.col(limit), F.col("_base") + F.col("_margin")))
        .withColumn("_open", F.col(seats) - F.sum("_lo").over(group))
    )
    candidates = F.when(F.col("_lo") < F.col("_hi"), F.sequence(F.col("_lo"), F.col("_hi") - 1))
    quotient = F.col(votes) / (2 * F.col("_k") + 1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc_nulls_last(), *ids, "_k"))
    ranked = d.withColumn("_k", F.explode_outer(candidates)).withColumn("_won", F.col("_k").isNotNull() & (rank <= F.col("_open")))
    keep = [c for c in df.columns if c not in ids]
    return ranked.groupBy(*ids).agg(
        *[F.first(c).alias(c) for c in keep],
        (F.first("_lo") + F.sum(F.col("_won").cast("long"))).cast("long").alias("quota"),
    )


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: ``sid`` (its place by code point, null last), ``source_size``, ``n_docs``, ``weight``, ``target``."""
    whole = Window.partitionBy(F.lit(0))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = (
        s.withColumn("sid", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("weight", F.element_at(ws, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * float(max_epochs))
        .withColumn("_total", F.sum("source_size").over(whole) * share)
    )
    order = whole.orderBy(F.col("_cap") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn(
        "_capped", F.col("_cap") * F.sum("weight").over(onwards) <= F.col("_left") * F.col("weight")
    )
    level = F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(whole)
    rest = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(whole), F.lit(0.0))
    return s.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(rest * F.col("weight") / level)).select(
        "sid", "source", "source_size", "n_docs", "weight", "target"
    )


def mix(
    sized: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS,
    docs_per_shard: int = DOCS_PER_SHARD,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows ``doc_id, source, size`` (and columns to ``carry``) in, the same rows with ``source_size, target, shard, quota, taken`` out."""
    sized = sized.select("doc_id", "source", "size", *carry)
    sources = (
        source_targets(sized, weights, share, max_epochs)
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
        .withColumn("_blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("_all", F.lit(0))
    )
    seats = F.floor(F.sum("_rest").over(Window.partitionBy("_all")) / block_words + 0.5)
    sources = apportion(sources.withColumn("_seats", seats), ["_all"], ["sid"], "_rest", "_blocks", "_seats")
    sources = sources.withColumn("_shards", F.floor(F.col("n_docs") / docs_per_shard) + 1)

    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = (
        sized.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.doc_id", "d.source", "d.size", "s.sid", "s.source_size", "s.target", "s._passes", F.col("s.quota").alias("_source_quota"), "s._shards", *[f"d.{c}" for c in carry])
        .withColumn("_key", key)
        .withColumn("shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    )
    shards = docs.groupBy("sid", "shard").agg(F.sum("size").alias("_words"), F.first("_source_quota").alias("_source_quota"))
    shards = shards.withColumn("_blocks", F.ceil(F.col("_words") / block_words))
    shards = apportion(shards, ["sid"], ["sid", "shard"], "_words", "_blocks", "_source_quota")

    order = Window.partitionBy("sid", "shard").orderBy("_key", "doc_id", "size")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("quota") * block_words
    part = F.greatest(F.lit(0), F.least(F.col("_end"), upto) - (F.col("_end") - F.col("size")))
    return (
        docs.withColumn("_end", end)
        .join(shards.select("sid", "shard", "quota"), ["sid", "shard"])
        .select("doc_id", "source", "size", *carry, "source_size", "target", "shard", "quota", (F.col("_passes") * F.col("size") + part).alias("taken"))
    )


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sized, **how)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n_docs FROM sized GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0
), s2 AS (
  SELECT *, ([5, 2, 1])[((sid - 1) % 3 + 1)]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s1
), s3 AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onwards FROM s2
), s4 AS (
  SELECT *, cap * onwards <= remaining * weight AS capped FROM s3
), s5 AS (
  SELECT *, CASE WHEN capped THEN cap ELSE
    (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () END AS target FROM s4
), s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS passes FROM s5
), s7 AS (
  SELECT *, target - passes * source_size AS rest, ceil(source_size / {BLOCK_WORDS})::BIGINT AS blocks, n_docs // {DOCS_PER_SHARD} + 1 AS shards FROM s6
), s8 AS (
  SELECT *, floor(sum(rest) OVER () / {BLOCK_WORDS} + 0.5)::BIGINT AS seats, sum(rest) OVER () AS v, count(*) OVER () AS m FROM s7
), s9 AS (
  SELECT *, CASE WHEN v > 0 THEN floor(seats * rest / v + 0.5)::BIGINT ELSE 0 END AS base,
    CASE WHEN v > 0 THEN ceil(m * rest / v)::BIGINT ELSE 0 END + 2 AS margin FROM s8
), s10 AS (
  SELECT *, least(greatest(0, base - margin), blocks) AS lo, least(blocks, base + margin) AS hi FROM s9
), s11 AS (SELECT *, seats - sum(lo) OVER () AS free FROM s10
), sk AS (
  SELECT sid, row_number() OVER (ORDER BY rest / (2 * k + 1) DESC, sid, k) <= free AS won
  FROM (SELECT *, unnest(range(lo, hi)) AS k FROM s11 WHERE lo < hi)
), src AS (
  SELECT s11.*, lo + coalesce((SELECT count(*) FROM sk WHERE sk.sid = s11.sid AND won), 0) AS squota FROM s11
), docs AS (
  SELECT d.doc_id, d.source, d.size, src.sid, src.source_size, src.target, src.passes, src.squota, src.shards,
    md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS key
  FROM sized d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), docs2 AS (
  SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM docs
), h0 AS (
  SELECT sid, shard, sum(size)::BIGINT AS words, any_value(squota) AS seats FROM docs2 GROUP BY sid, shard
), h1 AS (
  SELECT *, ceil(words / {BLOCK_WORDS})::BIGINT AS blocks, sum(words) OVER (PARTITION BY sid) AS v, count(*) OVER (PARTITION BY sid) AS m FROM h0
), h2 AS (
  SELECT *, CASE WHEN v > 0 THEN floor(seats * words / v + 0.5)::BIGINT ELSE 0 END AS base,
    CASE WHEN v > 0 THEN ceil(m * words / v)::BIGINT ELSE 0 END + 2 AS margin FROM h1
), h3 AS (
  SELECT *, least(greatest(0, base - margin), blocks) AS lo, least(blocks, base + margin) AS hi FROM h2
), h4 AS (SELECT *, seats - sum(lo) OVER (PARTITION BY sid) AS free FROM h3
), hk AS (
  SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY words / (2 * k + 1) DESC, shard, k) <= free AS won
  FROM (SELECT *, unnest(range(lo, hi)) AS k FROM h4 WHERE lo < hi)
), hq AS (
  SELECT h4.sid, h4.shard, lo + coalesce((SELECT count(*) FROM hk WHERE hk.sid = h4.sid AND hk.shard = h4.shard AND won), 0) AS quota FROM h4
), placed AS (
  SELECT docs2.*, quota, sum(size) OVER (PARTITION BY docs2.sid, docs2.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop
  FROM docs2 JOIN hq ON docs2.sid = hq.sid AND docs2.shard = hq.shard
)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(stop, quota * {BLOCK_WORDS}) - (stop - size)))::BIGINT AS taken, source
FROM placed
"""


def keep_mixed(docs: DataFrame, **how) -> DataFrame:
    """Documents as the mix takes them: each ``round(taken / size)`` times, with unchanged columns.

    Rows alike in id, source and text share what the mix takes of them. The join back to the texts is on these (the text by
    its hash, so words are counted once); rows of size 0 are kept once, as they hold no words to mix.
    """
    keys = ["doc_id", "source", "text_hash"]
    text_hash = F.xxhash64("text").alias("text_hash")
    sized = materialise(docs.select("doc_id", "source", text_hash, word_count(F.col("text")).alias("size")), "sizes")
    taken = (
        mix(sized, carry=("text_hash",), **how)
        .groupBy(*keys)
        .agg((F.sum("taken") / F.greatest(F.lit(1), F.sum("size"))).alias("times"), F.max("size").alias("size"))
        .withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("times") + 0.5)).cast("int"))
        .where("copies > 0")
    )
    d = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", text_hash)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    return (
        d.alias("d")
        .join(taken.alias("t"), same[0] & same[1] & same[2])
        .select("d.doc", F.explode(F.sequence(F.lit(1), F.col("t.copies"))))
        .select("doc.*")
    )
