"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.functions import vectors as vec
from mnemara.operators import ann, evaluate, logs, postings, retrieval, rounds, snapshots
from mnemara.sources.tables import label_queries, memories, memory_rows, table, turn_chunks, vectors
from mnemara.streaming import scratch

LIMIT = 10
FLOOR = 0.1
KEYWORDS = 'the -moron "of the" or der und or les des'
NEGATION = '-the -"of und" or les des'
KEYWORDS_A = 'the -moron "of the" or der und'
KEYWORDS_B = "les des or la"
NOW = "2026-01-01"
AS_OF = "2025-12-25 00:30:00"


def _one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of smallest id, as query 0."""
    first = vectors(spark, sf_dir).agg(F.min(F.struct("id", "v")).alias("q"))
    return first.select(F.lit(0).cast("long").alias("query_id"), F.col("q.id").alias("own_id"), F.col("q.v").alias("q"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_leg(vectors(spark, sf_dir), _one_query(spark, sf_dir), LIMIT).drop("query_id")


def vector_topk_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_leg(vectors(spark, sf_dir), _one_query(spark, sf_dir), 100, floor=FLOOR).drop("query_id")


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_leg(vectors(spark, sf_dir), label_queries(spark, sf_dir), LIMIT, skip_own=True)


def tag_scoped_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = memories(spark, sf_dir).where(F.col("tag") == "fr").select("id")
    scoped = vectors(spark, sf_dir).join(tagged, "id", "left_semi")
    return retrieval.vector_leg(scoped, _one_query(spark, sf_dir), LIMIT).drop("query_id")


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_leg(memories(spark, sf_dir), KEYWORDS, 50).drop("query_id")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = LIMIT * retrieval.OVERFETCH
    embedded = vectors(spark, sf_dir).join(memories(spark, sf_dir).select("id"), "id", "left_semi")
    legs = [(retrieval.vector_leg(embedded, _one_query(spark, sf_dir), n), 0), (retrieval.keyword_leg(memories(spark, sf_dir), KEYWORDS, n), 1)]
    return retrieval.rrf_fuse(legs, ["query_id"])


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_fused(_fused(spark, sf_dir), ["query_id"], LIMIT).select("id", "score", "priority", "rank")


def rrf_hybrid_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = memories(spark, sf_dir).select("id", "created_at")
    decay = retrieval.recency(F.col("created_at"), F.to_timestamp(F.lit(NOW)))
    d = _fused(spark, sf_dir).join(created, "id").withColumn("score", F.round(F.col("score") * decay, 9))
    return retrieval.top_fused(d, ["query_id"], LIMIT).select("id", "score", "priority", "rank")


def cross_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list from the lists of all label queries: fused by rank, with each id's best similarity."""
    leg = retrieval.vector_leg(vectors(spark, sf_dir), label_queries(spark, sf_dir), 25)
    best = leg.groupBy("id").agg(F.max("similarity").alias("similarity"))
    fused = retrieval.rrf_fuse([(leg.withColumn("all", F.lit(0)), 0)], ["all"])
    return retrieval.top_fused(fused, ["all"], 25).join(best, "id").select("id", "similarity", "score", "rank")


def hybrid_two_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and chat turns in one list: each leg keeps its own ranks, ids carry their type."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    legs = []
    for kind, data, prio in (("document", memories(spark, sf_dir), 0), ("turn", turns, 1)):
        leg = retrieval.keyword_leg(data, KEYWORDS, 25).withColumn("id", F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")))
        legs.append((leg, prio))
    return retrieval.top_fused(retrieval.rrf_fuse(legs, ["query_id"]), ["query_id"], 25).select("id", "score", "priority", "rank")


def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = retrieval.vector_leg(vectors(spark, sf_dir), label_queries(spark, sf_dir), 5 * LIMIT)
    pool = pool.withColumnRenamed("similarity", "score").join(vectors(spark, sf_dir).select("id", "v"), "id")
    return retrieval.mmr(pool.select("query_id", "id", "score", "rank", "v"), LIMIT)


def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's first vector asks for vectors of its label."""
    leg = retrieval.vector_leg(vectors(spark, sf_dir), label_queries(spark, sf_dir), LIMIT, skip_own=True)
    hits = leg.join(vectors(spark, sf_dir).select("id", "label"), "id").withColumn("gold", F.col("label") == F.col("query_id"))
    return evaluate.score_rankings(hits)


def _all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("tag"))


def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and largest cosine of all ordered pairs of one label, and of different ones, from counts of rounded cosines."""
    v = vectors(spark, sf_dir)
    counts = retrieval.cosine_counts(v, v.select(F.col("id").alias("own_id"), F.col("v").alias("q"), "label"), 4)
    by = Window.partitionBy("same")
    c = counts.withColumn("upto", F.sum("n").over(by.orderBy("s"))).withColumn("total", F.sum("n").over(by))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = [F.min(F.when(F.col("upto") >= k, F.col("s"))) for k in (low, high)]
    return c.groupBy(F.when(F.col("same"), "same").otherwise("other").alias("kind")).agg(
        F.max("total").alias("n"), F.min("s").alias("min_s"), F.round((middle[0] + middle[1]) / 2, 8).alias("median_s"), F.max("s").alias("max_s")
    )


def nearest_other_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector the nearest vector of another label, and the margin to the second nearest of these."""
    two = retrieval.nearest(vectors(spark, sf_dir).withColumn("tag", F.col("label")), _all_queries(spark, sf_dir), 2, apart=True)
    first, second = (F.max(F.when(F.col("rank") == i, F.col("similarity"))) for i in (1, 2))
    out = two.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("nearest"), first.alias("similarity"), F.round(first - second, 6).alias("margin"))
    return out.withColumnRenamed("query_id", "id")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest other vectors (five at most) with a cosine of 0.9 or more."""
    q = _all_queries(spark, sf_dir).withColumn("own_id", F.col("query_id")).drop("tag")
    return retrieval.vector_leg(vectors(spark, sf_dir), q, 5, floor=0.9, skip_own=True).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "similarity", "rank")


def exact_vs_pruned_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 by exact search over all vectors, and how a search of the approximate index compares: whether it finds nine of ten
    of the exact search's rows for all vectors as queries, and whether its recall at 10 is within 0.1."""
    v, q = vectors(spark, sf_dir), label_queries(spark, sf_dir)
    gold = v.select("id", "label")
    lists = ann.Lists.build(v)

    def recall(hits: DataFrame, name: str) -> DataFrame:
        hits = hits.join(gold, "id").withColumn("gold", F.col("label") == F.col("query_id"))
        return evaluate.score_rankings(hits).select(F.lit(1).alias("k"), F.col("recall_10").alias(name))

    own = q.select("query_id", F.col("own_id").alias("id"))
    pruned = lists.search(q, LIMIT + 1).join(own, ["query_id", "id"], "left_anti")
    pruned = retrieval.ranked(pruned.drop("rank"), ["query_id"], [F.desc("similarity"), F.col("id")], LIMIT)
    every = _all_queries(spark, sf_dir).select("query_id", "q")
    found = ann.recalled(lists.search(every, LIMIT), retrieval.nearest(v, every, LIMIT)).agg((F.avg("recall") >= 0.9).alias("recalled"))
    both = recall(retrieval.vector_leg(v, q, LIMIT, skip_own=True), "exact").join(recall(pruned, "pruned"), "k")
    return both.select("exact", (F.abs(F.col("exact") - F.col("pruned")) <= 0.1).alias("close")).join(found)


def approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label, the share of each vector's ten nearest that the approximate index finds."""
    v, every = vectors(spark, sf_dir), _all_queries(spark, sf_dir).select("query_id", "q")
    each = ann.recalled(ann.Lists.build(v).search(every, LIMIT), retrieval.nearest(v, every, LIMIT))
    return each.join(v.select(F.col("id").alias("query_id"), "label"), "query_id").groupBy("label").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def approximate_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered approximate searches that begin with one list: as many rows as the limit asks for, all of which pass the filter."""
    lists = ann.Lists.build(vectors(spark, sf_dir))
    passes = (F.col("label") % 5 == 0) & (F.col("id") % 3 == 0)
    found = lists.search(_all_queries(spark, sf_dir).select("query_id", "q"), LIMIT, passes, probes=1)
    met = found.join(vectors(spark, sf_dir).select("id", passes.alias("passes")), "id")
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("passes").alias("passes"))


def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyword_topk`` from postings alone."""
    one = spark.createDataFrame([(0, KEYWORDS)], "query_id long, text string")
    return postings.Index.build(memories(spark, sf_dir)).search(one, 50).drop("query_id")


def keyword_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds none of some words and phrases, or both of two others, by a scan."""
    return retrieval.keyword_leg(memories(spark, sf_dir), NEGATION, 50).drop("query_id")


def recall_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recall_memories`` with the keyword leg from an index of all versions."""
    rows = memory_rows(spark, sf_dir)
    options = retrieval.Recall.asked(4, threshold=FLOOR, tag="en")
    return retrieval.search_memories(rows, _recall_queries(spark, sf_dir), options, _now(), postings.Index.build(rows.select("id", "text"))).select(_COLUMNS)


def _recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("query_id") % 2 == 0, KEYWORDS_A).otherwise(KEYWORDS_B)
    return label_queries(spark, sf_dir).select("query_id", text.alias("text"), "q")


def _now():
    return F.to_timestamp(F.lit(NOW))


_COLUMNS = ["query_id", "rank", "id", "version", "similarity", "score"]


TOOL_WORDS = ("the", "der", "und", "les", "of", "la", "en")


def tool_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns as search calls of two or three words each, answered from the documents; searches for ``la`` fail."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    word = lambda k: F.element_at(F.array(*map(F.lit, TOOL_WORDS)), ((F.col("conv_id") + F.col("turn") * 2 + k) % len(TOOL_WORDS) + 1).cast("int"))
    queries = F.when(F.col("turn") % 2 == 0, F.array(word(0), word(3))).otherwise(F.array(word(0), word(1), word(2)))
    calls = c.select(F.col("conv_id").alias("round_id"), F.col("turn").alias("call_no"), queries.alias("queries"))
    out = rounds.tool_round(calls, lambda q: retrieval.keyword_hits(memories(spark, sf_dir), q, LIMIT), spark.createDataFrame([("la",)], "text string"))
    ids = F.array_join(F.transform("results", lambda r: r["id"].cast("string")), ",")
    return out.select("round_id", "call_no", F.array_join("used", ",").alias("used"), "error", ids.alias("ids"), F.round(F.array_max(F.transform("results", lambda r: r["score"])), 6).alias("best"))


def recall_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the label queries' searches over the embedded documents, as they are logged: clipped to 80 characters."""
    q = label_queries(spark, sf_dir)
    docs = memories(spark, sf_dir).select("id", "text", F.lit(1).alias("version"))
    data = vectors(spark, sf_dir).join(docs.select("id"), "id", "left_semi")
    found = retrieval.vector_leg(data, q, 5).join(docs, "id")
    asked = q.select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), F.concat(F.lit("label "), F.col("query_id").cast("string")).alias("text"))
    rows = logs.traces(asked, found, "search", "memory", F.lit(1.6), _now(), limit=80)
    return rows.select("id", "query", "result_count", "latency_ms", F.md5("retrieved").alias("digest"))


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces, written to the log in four batches in order of their ids; what is left when each batch cuts it to the newest 1000."""
    log = snapshots.Snapshots(spark, scratch.shared_folder(spark, "traces"), "id string, query string, created_at timestamp")
    e = table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("event_type").alias("query"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 4).alias("part"))
    for part in range(4):
        logs.record_traces(log, e.where(F.col("part") == part).drop("part"), keep=1000)
    return log.read().select("id", "query")


def recall_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search in pure order: latest visible versions of one tag, both legs, floor, fusion, decay."""
    options = retrieval.Recall.asked(4, threshold=FLOOR, tag="en")
    return retrieval.search_memories(memory_rows(spark, sf_dir), _recall_queries(spark, sf_dir), options, _now()).select(_COLUMNS)


def recall_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was believed at an instant, forgotten memories included, by vectors alone."""
    options = retrieval.Recall.asked(25, threshold=FLOOR, keyword=False, as_of=AS_OF, forgotten=True, diversify=False)
    return retrieval.search_memories(memory_rows(spark, sf_dir), _recall_queries(spark, sf_dir), options, _now()).select(_COLUMNS)


def recall_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default search of ten results, reordered for diversity."""
    options = retrieval.Recall.asked(threshold=FLOOR)
    return retrieval.search_memories(memory_rows(spark, sf_dir), _recall_queries(spark, sf_dir), options, _now()).select(_COLUMNS)


def recall_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, docs = turn_chunks(spark, sf_dir)
    options = retrieval.Recall.asked(10, threshold=FLOOR, tag="assistant")
    out = retrieval.search_chunks(chunks, docs, _recall_queries(spark, sf_dir), options)
    return out.select("query_id", "rank", "id", "document_id", "title", "heading_path", "similarity", "source", "score")


def recall_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = retrieval.Recall.asked(4, threshold=FLOOR)
    queries = _recall_queries(spark, sf_dir)
    m = retrieval.search_memories(memory_rows(spark, sf_dir), queries, options, _now())
    c = retrieval.search_chunks(*turn_chunks(spark, sf_dir), queries, options)
    return retrieval.search_hybrid(m, c, 6)


def model_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.groupBy(F.size("v").alias("dim"), vec.is_valid(F.col("v"), 64).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector cut to 32 components and scaled, written as text and read back."""
    v = vectors(spark, sf_dir).withColumn("cut", vec.truncated(F.col("v"), 32))
    back = vec.from_text(vec.to_text(F.col("cut")))
    return v.select("id", F.size(back).alias("dim"), F.round(vec.norm(back), 6).alias("length"), F.round(vec.cosine("cut", F.slice("v", 1, 32)), 6).alias("same"), F.round(F.element_at(back, 1), 6).alias("first"))


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_Q0 = "q AS (SELECT id AS own_id, e AS q FROM v ORDER BY id LIMIT 1)"
_QL = "q AS (SELECT label::BIGINT AS query_id, min(id) AS own_id, arg_min(e, id) AS q FROM v GROUP BY label)"
_SIM = "round(list_cosine_similarity(e, q), 6)"
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_MATCH = (
    "(contains(s, ' the ') AND NOT contains(s, ' moron ') AND contains(s, ' of the ')"
    " OR contains(s, ' der ') AND contains(s, ' und ') OR contains(s, ' les ') AND contains(s, ' des '))"
)
_WANTED = "('the', 'of', 'der', 'und', 'les', 'des')"


def _keyword_sql(source: str, n: int) -> str:
    return f"""(
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM (
    SELECT id, round(len(list_filter(t, lambda x: x IN {_WANTED}))::DOUBLE / len(t), 6) AS score
    FROM (SELECT id, t, ' ' || array_to_string(t, ' ') || ' ' AS s FROM (SELECT id, {_TOK} AS t FROM {source})) WHERE {_MATCH}
  ) QUALIFY rank <= {n})"""


_DOCS = "(SELECT doc_id AS id, text FROM documents)"
_LEGS = f"""{_V}, {_Q0}, leg AS (
  SELECT id, row_number() OVER (ORDER BY {_SIM} DESC, id) AS rank, 0 AS p FROM v, q WHERE id IN (SELECT doc_id FROM documents) QUALIFY rank <= 150
  UNION ALL SELECT id, rank, 1 AS p FROM {_keyword_sql(_DOCS, 150)}
), fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(p)::INTEGER AS priority FROM leg GROUP BY id)"""
_TOP = "row_number() OVER (ORDER BY score DESC, priority DESC, id)::INTEGER AS rank"

_MEMORIES = f"""{_V}, m0 AS (
  SELECT doc_id AS id, text, lang AS tag, doc_id // 3 AS chain, (doc_id % 3 + 1)::INTEGER AS version, TIMESTAMP '2026-01-01' - to_hours((doc_id // 3 * 6 - doc_id % 3 - 1)::INTEGER) AS created_at,
    doc_id % 11 = 0 AS is_forgotten FROM documents
), m AS (
  SELECT m0.*, e, CASE WHEN m0.id % 13 = 0 THEN created_at + INTERVAL 10 DAYS END AS forget_after, CASE WHEN version > 1 THEN created_at END AS valid_from,
    lead(created_at) OVER (PARTITION BY chain ORDER BY version) AS valid_to, valid_to IS NULL AS is_latest FROM m0 LEFT JOIN v ON m0.id = v.id
)"""
_TURNS = """c AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS document_id, text, role AS heading_path, e FROM conversations LEFT JOIN v ON conv_id * 7 + turn = v.id
), d AS (SELECT conv_id AS document_id, 'conversation ' || conv_id AS title, list(DISTINCT role) AS tags FROM conversations GROUP BY conv_id)"""
_ASKED = _QL


def _recall_legs(seen: str, n: int, suffix: str = "") -> str:
    """Both legs of each label's query over rows ``id, text, e``; queries of even and odd labels have other keywords."""
    return f"""vleg{suffix} AS (
  SELECT query_id, {seen}.id, {_SIM} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, {seen}.id) AS r FROM {seen}, q WHERE e IS NOT NULL AND {_SIM} >= {FLOOR} QUALIFY r <= {n}
), tok{suffix} AS (SELECT id, t, ' ' || array_to_string(t, ' ') || ' ' AS s FROM (SELECT id, {_TOK} AS t FROM {seen})
), hit{suffix} AS (
  SELECT 0 AS odd, id, round(len(list_filter(t, lambda x: x IN ('the', 'of', 'der', 'und')))::DOUBLE / len(t), 6) AS k FROM tok{suffix}
  WHERE contains(s, ' the ') AND NOT contains(s, ' moron ') AND contains(s, ' of the ') OR contains(s, ' der ') AND contains(s, ' und ')
  UNION ALL SELECT 1, id, round(len(list_filter(t, lambda x: x IN ('les', 'des', 'la')))::DOUBLE / len(t), 6) FROM tok{suffix} WHERE contains(s, ' les ') AND contains(s, ' des ') OR contains(s, ' la ')
), kleg{suffix} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, id) AS r FROM hit{suffix} JOIN q ON query_id % 2 = odd QUALIFY r <= {n})"""


def _recall_fused(seen: str) -> str:
    return f"""legs AS (SELECT query_id, id, similarity, 1.0::DOUBLE / (60 + r) AS s, 0 AS p FROM vleg UNION ALL SELECT query_id, id, NULL, 1.0::DOUBLE / (60 + r), 1 FROM kleg),
sums AS (SELECT query_id, id, sum(s) AS s, max(p) AS p, coalesce(max(similarity), 0.0::DOUBLE) AS similarity FROM legs GROUP BY query_id, id),
fused AS (
  SELECT query_id, sums.id, version, similarity, p, round(s * (1 - 0.15::DOUBLE * (1 - exp(-greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0::DOUBLE / 90.0::DOUBLE))), 9) AS score
  FROM sums JOIN {seen} ON sums.id = {seen}.id
)"""


_CHUNKS_FUSED = """fused AS (
  SELECT query_id, id, document_id, title, heading_path, coalesce(similarity, 0.0::DOUBLE) AS similarity, (b.kr IS NOT NULL)::INTEGER AS p,
    CASE WHEN vr IS NOT NULL AND kr IS NOT NULL THEN 'both' WHEN kr IS NOT NULL THEN 'keyword' ELSE 'vector' END AS source,
    round(coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + kr), 0), 9) AS score
  FROM (SELECT query_id, id, similarity, vleg.r AS vr, kleg.r AS kr FROM vleg FULL JOIN kleg USING (query_id, id)) b JOIN seen USING (id)
)"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_floor, vector_topk_batch, tag_scoped_vector, keyword_topk, rrf_hybrid, rrf_hybrid_decay, cross_query_merge,
        hybrid_two_types, mmr_rerank, eval_recall_mrr, similarity_stats, nearest_other_label, near_dup_pairs, exact_vs_pruned_delta, approximate_recall, approximate_filtered, keyword_index_topk, keyword_negation, recall_indexed, tool_rounds, recall_traces, trace_log, recall_memories,
        recall_as_of, recall_diverse, recall_chunks, recall_hybrid, model_guard, vector_round_trip,
    )
}

SQL = {
    "vector_topk": f"WITH {_V}, {_Q0} SELECT id, {_SIM} AS similarity, row_number() OVER (ORDER BY {_SIM} DESC, id)::INTEGER AS rank FROM v, q QUALIFY rank <= {LIMIT}",
    "vector_topk_floor": f"WITH {_V}, {_Q0} SELECT id, {_SIM} AS similarity, row_number() OVER (ORDER BY {_SIM} DESC, id)::INTEGER AS rank FROM v, q WHERE {_SIM} >= {FLOOR} QUALIFY rank <= 100",
    "vector_topk_batch": f"WITH {_V}, {_QL} SELECT query_id, id, {_SIM} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, id)::INTEGER AS rank FROM v, q WHERE id <> own_id QUALIFY rank <= {LIMIT}",
    "tag_scoped_vector": f"WITH {_V}, {_Q0} SELECT id, {_SIM} AS similarity, row_number() OVER (ORDER BY {_SIM} DESC, id)::INTEGER AS rank FROM v, q WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'fr') QUALIFY rank <= {LIMIT}",
    "keyword_topk": f"SELECT id, score, rank FROM {_keyword_sql(_DOCS, 50)}",
    "rrf_hybrid": f"WITH {_LEGS} SELECT id, score, priority, {_TOP} FROM fused QUALIFY rank <= {LIMIT}",
    "rrf_hybrid_decay": f"""WITH {_LEGS}, decayed AS (
  SELECT id, round(score * (1 - 0.15::DOUBLE * (1 - exp(-(id * 3600 / 86400.0::DOUBLE) / 90.0::DOUBLE))), 9) AS score, priority FROM fused
) SELECT id, score, priority, {_TOP} FROM decayed QUALIFY rank <= {LIMIT}""",
    "cross_query_merge": f"""WITH {_V}, {_QL}, leg AS (
  SELECT query_id, id, {_SIM} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, id) AS rank FROM v, q QUALIFY rank <= 25
), fused AS (SELECT id, max(similarity) AS similarity, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM leg GROUP BY id)
SELECT id, similarity, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM fused QUALIFY rank <= 25""",
    "hybrid_two_types": f"""WITH leg AS (
  SELECT 'document:' || id AS id, rank, 0 AS p FROM {_keyword_sql(_DOCS, 25)}
  UNION ALL SELECT 'turn:' || id AS id, rank, 1 AS p FROM {_keyword_sql("(SELECT conv_id * 1000 + turn AS id, text FROM conversations)", 25)}
), fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(p)::INTEGER AS priority FROM leg GROUP BY id)
SELECT id, score, priority, {_TOP} FROM fused QUALIFY rank <= 25""",
    "eval_recall_mrr": f"""WITH {_V}, {_QL}, leg AS (
  SELECT query_id, label = query_id AS gold, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, id) AS rank FROM v, q WHERE id <> own_id QUALIFY rank <= {LIMIT}
), r AS (SELECT query_id, min(rank) FILTER (gold) AS first FROM leg GROUP BY query_id)
SELECT count(*)::BIGINT AS n_queries, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5,
  round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM r""",
    "similarity_stats": f"""WITH {_V}, p AS (SELECT a.label = b.label AS same, round(list_cosine_similarity(a.e, b.e), 4) AS s FROM v a, v b WHERE a.id <> b.id)
SELECT CASE WHEN same THEN 'same' ELSE 'other' END AS kind, count(*)::BIGINT AS n, min(s) AS min_s, round(median(s), 8) AS median_s, max(s) AS max_s FROM p GROUP BY same""",
    "nearest_other_label": f"""WITH {_V}, p AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 6) AS s FROM v a, v b WHERE a.label <> b.label),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM p)
SELECT id, min(other) FILTER (r = 1) AS nearest, min(s) FILTER (r = 1) AS similarity, round(min(s) FILTER (r = 1) - min(s) FILTER (r = 2), 6) AS margin FROM r WHERE r <= 2 GROUP BY id""",
    "near_dup_pairs": f"""WITH {_V} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.id)::INTEGER AS rank FROM v a, v b
WHERE a.id <> b.id AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.9 QUALIFY rank <= 5""",
    "exact_vs_pruned_delta": f"""WITH {_V}, {_QL},
  x AS (SELECT query_id, label = query_id AS gold FROM v, q WHERE id <> own_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, id) <= 10)
SELECT round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact, true AS close, true AS recalled FROM (SELECT bool_or(gold) AS hit FROM x GROUP BY query_id)""",
    "approximate_filtered": f"""WITH {_V}, n AS (SELECT least({LIMIT}, count(*))::BIGINT AS n FROM v WHERE label % 5 = 0 AND id % 3 = 0) SELECT id AS query_id, n, true AS passes FROM v, n WHERE n > 0""",
    "keyword_index_topk": f"SELECT id, score, rank FROM {_keyword_sql(_DOCS, 50)}",
    "keyword_negation": f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM (
  SELECT id, CASE WHEN len(t) = 0 THEN 0 ELSE round(len(list_filter(t, lambda x: x IN ('les', 'des')))::DOUBLE / len(t), 6) END AS score
  FROM (SELECT id, t, ' ' || array_to_string(t, ' ') || ' ' AS s FROM (SELECT id, {_TOK} AS t FROM {_DOCS}))
  WHERE NOT contains(s, ' the ') AND NOT contains(s, ' of und ') OR contains(s, ' les ') AND contains(s, ' des ')) QUALIFY rank <= 50""",
    "tool_rounds": f"""WITH w AS (SELECT word, i FROM (VALUES {", ".join(f"('{w}', {i})" for i, w in enumerate(TOOL_WORDS))}) t(word, i)
), hit AS (
  SELECT word, id, score, row_number() OVER (PARTITION BY word ORDER BY score DESC, id) AS rank FROM (
    SELECT word, id, round(len(list_filter(t, lambda x: x = word))::DOUBLE / len(t), 6) AS score FROM (SELECT id, {_TOK} AS t FROM {_DOCS}), w WHERE list_contains(t, word)) QUALIFY rank <= {LIMIT}
), c AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN [0, 3] ELSE [0, 1, 2] END AS ks FROM conversations WHERE role = 'user'
), b AS (SELECT *, greatest(0, 5 - coalesce(sum(len(ks)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS left_over FROM c
), u AS (SELECT conv_id, turn, list_transform(ks[1:left_over], lambda k: (conv_id + turn * 2 + k) % {len(TOOL_WORDS)}) AS us FROM b
), q AS (SELECT conv_id, turn, word, p FROM (SELECT conv_id, turn, unnest(us) AS i, unnest(range(len(us))) AS p FROM u) JOIN w USING (i)
), f AS (SELECT conv_id, turn, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, max(score) AS best FROM q JOIN hit USING (word) GROUP BY ALL
), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY fused DESC, id) AS r FROM f QUALIFY r <= 25
), l AS (SELECT conv_id, turn, string_agg(id::VARCHAR, ',' ORDER BY r) AS ids, max(best) AS best FROM g GROUP BY ALL
), n AS (SELECT conv_id, turn, string_agg(word, ',' ORDER BY p) AS used, bool_or(word = 'la') AS bad FROM q GROUP BY ALL)
SELECT u.conv_id AS round_id, u.turn AS call_no, coalesce(used, '') AS used, CASE WHEN bad THEN 'memory_search_unavailable' END AS error,
  CASE WHEN bad THEN '' ELSE coalesce(ids, '') END AS ids, CASE WHEN bad THEN NULL ELSE best END AS best
FROM u LEFT JOIN n ON u.conv_id = n.conv_id AND u.turn = n.turn LEFT JOIN l ON u.conv_id = l.conv_id AND u.turn = l.turn""",
    "recall_traces": f"""WITH {_V}, {_QL}, d AS (SELECT v.id, e, coalesce(text, '') AS text FROM v JOIN documents ON doc_id = v.id), s AS (
  SELECT query_id, id, text, {_SIM} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, id) AS r FROM d, q QUALIFY r <= 5
), j AS (SELECT query_id, count(*)::INTEGER AS n, string_agg('{{"type":"memory","id":' || id || ',"version":1,"similarity":' || s || ',"content":'
  || to_json(CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END) || ',"contentLength":' || length(text) || ',"truncated":' || (length(text) > 80) || '}}', ',' ORDER BY r) AS items FROM s GROUP BY query_id)
SELECT 'q' || query_id AS id, 'label ' || query_id AS query, coalesce(n, 0) AS result_count, 2::BIGINT AS latency_ms, md5('[' || coalesce(items, '') || ']') AS digest FROM q LEFT JOIN j USING (query_id)""",
    "trace_log": "SELECT lpad(event_id::VARCHAR, 12, '0') AS id, event_type AS query FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "recall_memories": f"""WITH {_MEMORIES}, {_ASKED}, seen AS (SELECT * FROM m WHERE is_latest AND NOT is_forgotten AND (forget_after IS NULL OR forget_after > TIMESTAMP '{NOW}') AND tag = 'en'),
{_recall_legs("seen", 60)}, {_recall_fused("seen")}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p DESC, id)::INTEGER AS rank, id, version, similarity, score FROM fused QUALIFY rank <= 4""",
    "recall_as_of": f"""WITH {_MEMORIES}, {_ASKED}, seen AS (SELECT * FROM m WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{AS_OF}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}'))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, id)::INTEGER AS rank, id, version, {_SIM} AS similarity, {_SIM} AS score
FROM seen, q WHERE e IS NOT NULL AND {_SIM} >= {FLOOR} QUALIFY rank <= 25""",
    "recall_chunks": f"""WITH {_V}, {_TURNS}, {_ASKED}, seen AS (SELECT c.*, title FROM c JOIN d USING (document_id) WHERE list_contains(tags, 'assistant')),
{_recall_legs("seen", 150)}, {_CHUNKS_FUSED}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p DESC, id)::INTEGER AS rank, id, document_id, title, heading_path, similarity, source, score FROM fused QUALIFY rank <= 10""",
    "recall_hybrid": f"""WITH {_MEMORIES}, {_ASKED}, seen AS (SELECT * FROM m WHERE is_latest AND NOT is_forgotten AND (forget_after IS NULL OR forget_after > TIMESTAMP '{NOW}')),
{_recall_legs("seen", 60)}, {_recall_fused("seen")}, top_m AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p DESC, id) AS r, 'memory' AS type, id, similarity, score, 1 AS prio FROM fused QUALIFY r <= 4
), {_TURNS}, seen2 AS (SELECT c.*, title FROM c JOIN d USING (document_id)), {_recall_legs("seen2", 60, "2")}, {_CHUNKS_FUSED.replace("fused AS", "fused2 AS").replace("vleg", "vleg2").replace("kleg", "kleg2").replace("seen", "seen2")}, top_c AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p DESC, id) AS r, 'chunk' AS type, id, similarity, score, 0 AS prio FROM fused2 QUALIFY r <= 4
), u AS (SELECT *, round(1.0::DOUBLE / (60 + r), 9) AS f FROM (FROM top_m UNION ALL FROM top_c))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, prio DESC, type || ':' || id)::INTEGER AS rank, type, id::VARCHAR AS id, similarity, score FROM u QUALIFY rank <= 6""",
    "model_guard": "SELECT len(embedding)::INTEGER AS dim, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 AS valid, count(*)::BIGINT AS n FROM embeddings GROUP BY 1, 2",
    "vector_round_trip": f"""WITH {_V}, c AS (SELECT id, e[1:32] AS h FROM v), n AS (SELECT id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM c)
SELECT id, 32 AS dim, 1.0::DOUBLE AS length, 1.0::DOUBLE AS same, round(h[1] / n, 6) AS first FROM n""",
}
SQL["recall_indexed"] = SQL["recall_memories"]
